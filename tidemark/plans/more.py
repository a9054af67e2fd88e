"""Queries of readers and writers, composed jobs, labels, budgets and searches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import special as X
from tidemark.functions.labels import flat_metrics, quantile_label, recovered
from tidemark.operators import scoring
from tidemark.operators import simulation as Z
from tidemark.operators import vectors as V
from tidemark.operators.quantiles import exact_quantiles
from tidemark.plans import scores as R
from tidemark.plans import series as W
from tidemark.session import scratch, table
from tidemark.sources import files, readers, sinks

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# Readers and writers.
@query("SELECT count(*) AS n_rows, count(narrative) AS n_texts, CAST(sum(length(narrative)) AS BIGINT) AS n_chars FROM prepared")
def src02_batched_scan(spark, root):
    """Arrow batches of the scan, each by itself; one row per batch moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.column("narrative")
            yield pa.record_batch([[b.num_rows], [b.num_rows - t.null_count], [pc.sum(pc.utf8_length(t)).as_py() or 0]], names=["a", "b", "c"])

    got = table(spark, root, "prepared").select("narrative").mapInArrow(run, "a long, b long, c long")
    return got.agg(F.sum("a").alias("n_rows"), F.sum("b").alias("n_texts"), F.sum("c").alias("n_chars"))


@query("SELECT record_id, feed, payload FROM raw_records")
def src06_csv_as_text(spark, root):
    """Ids, quotes and line ends survive a CSV file."""
    at = scratch(spark) + ".csv"
    table(spark, root, "raw_records").select("record_id", "feed", "payload").write.option("header", True).option("escape", '"').option("nullValue", "\\N").option("emptyValue", "").csv(at)
    got = readers.read_table(spark, at)
    return got.select(*[F.when(F.col(c) != "\\N", F.col(c)).alias(c) for c in got.columns])


@query("SELECT CAST(score_run AS VARCHAR) AS score_run, week, CAST(cluster_id AS VARCHAR) AS cluster_id FROM weekly_panel")
def src07_csv_with_dates(spark, root):
    at = scratch(spark) + ".csv"
    sinks.write_csv(table(spark, root, "weekly_panel").drop("split"), at, one_file=False)
    return readers.read_dated(spark, at, ["score_run", "week", "cluster_id"], ["week"])


@query(None)
def src08_pinned(spark, root):
    """A pinned file is read; with another digest it is refused."""
    at = scratch(spark)
    files.write_text(at, "2026-01-01\n2026-12-25\n")
    digest, refused = readers.file_sha256(at), False
    lines = readers.pinned_lines(at, digest)
    try:
        readers.pinned_lines(at, "0" * 64)
    except ValueError:
        refused = True
    return spark.createDataFrame([(len(lines), refused)], "n_lines long, refused boolean")


@query("SELECT l_returnflag, count(*) AS n_rows, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM lineitem GROUP BY 1")
def snk01_written_and_read(spark, root):
    """Sharded zstd files, counted, published by renaming and read again."""
    rows, staging, final = table(spark, root, "lineitem"), scratch(spark), scratch(spark)
    n = sinks.write_parquet(rows, staging, rows.count(), rows_per_file=200_000)
    sinks.publish(staging, final, n)
    return spark.read.parquet(final).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("l_orderkey").alias("keys"))


_NEW_DAY = "DATE '2025-01-06' + CAST(vec_id % 28 AS INTEGER)"


def _model(spark, root) -> str:
    at = scratch(spark)
    scoring.fit(table(spark, root, "embeddings"), "label", at)
    return at


@query(R._CENTRES + f""", t AS (SELECT part, quantile_cont(distance, 0.99) AS p99 FROM a GROUP BY 1), s AS (SELECT date_trunc('week', {_NEW_DAY})::DATE AS period, part AS cluster_id, distance > p99 AS is_novel FROM a JOIN t USING (part)),
g AS (SELECT CAST(p AS DATE) AS period, cluster_id FROM (SELECT unnest(generate_series((SELECT min(period) FROM s)::TIMESTAMP, (SELECT max(period) FROM s)::TIMESTAMP, INTERVAL 7 DAY)) AS p) x, (SELECT DISTINCT cluster_id FROM s) y)
SELECT period, cluster_id, count(is_novel) AS n, count(*) FILTER (WHERE is_novel) AS n_novel FROM g LEFT JOIN s USING (period, cluster_id) GROUP BY ALL""")
def snk07_scored_panel(spark, root):
    """Fit, then score all rows; the weekly panel among the written results."""
    at = scratch(spark)
    new = table(spark, root, "embeddings").select("vec_id", "embedding", F.expr("date_add(DATE '2025-01-06', int(vec_id % 28))").alias("day"))
    scoring.score(new, _model(spark, root), at, "vec_id", "day")
    return spark.read.parquet(f"{at}/weekly").select("period", "cluster_id", "n", "n_novel")


@query("SELECT complaint_id, epoch_us(loaded_at) AS loaded_us, length(narrative) AS n_chars FROM prepared WHERE complaint_id IS NOT NULL")
def ml21_resumed(spark, root):
    """A transform that stops after some buckets and goes on: nothing is lost or done twice."""
    at, rows = scratch(spark), table(spark, root, "prepared").where("complaint_id IS NOT NULL").select("complaint_id", "loaded_at", "narrative")
    calls = []

    def measured(df):
        calls.append(1)
        if len(calls) == 2:
            raise InterruptedError
        return df.select("complaint_id", F.unix_micros("loaded_at").alias("loaded_us"), F.length("narrative").cast("long").alias("n_chars"))

    try:
        scoring.resumable(rows, "complaint_id", measured, at, {"v": 1}, buckets=8)
    except InterruptedError:
        pass
    return scoring.resumable(rows, "complaint_id", measured, at, {"v": 1}, buckets=8)


# Flags, labels, names.
@query("SELECT complaint_id, epoch_us(loaded_at) AS loaded_us, t1 IS NOT NULL AS known_t1, t2 IS NOT NULL AS known_t2, t3 IS NOT NULL AS known_t3, t4 IS NOT NULL AS known_t4 FROM prepared")
def prj10_known_flags(spark, root):
    return table(spark, root, "prepared").select("complaint_id", F.unix_micros("loaded_at").alias("loaded_us"), *[F.col(t).isNotNull().alias(f"known_{t}") for t in ("t1", "t2", "t3", "t4")])


@query("SELECT score_run, split, received_day AS week, cluster_id, complaint_count, novel_count, daily_total AS weekly_total FROM daily_panel")
def prj23_weekly_view(spark, root):
    """The daily panel under the names that weekly operators take."""
    return table(spark, root, "daily_panel").withColumnsRenamed({"received_day": "week", "daily_total": "weekly_total"}).drop("day_of_week", "loaded_at")


_LEVELS = (0.025, 0.1, 0.25, 0.5, 0.75, 0.9, 0.975)


@query(f"SELECT event_type, l.label, l.level, round(q[l.i], 6) AS value FROM (SELECT event_type, quantile_cont(value, [{', '.join(map(str, _LEVELS))}]) AS q FROM events GROUP BY 1), (VALUES " + ", ".join(f"({i + 1}, '{quantile_label(x)}', CAST({x} AS DOUBLE))" for i, x in enumerate(_LEVELS)) + ") l(i, label, level)")
def sc10_labelled_quantiles(spark, root):
    q = exact_quantiles(table(spark, root, "events"), ["event_type"], "value", _LEVELS)
    rows = F.explode(F.array(*[F.struct(F.lit(quantile_label(x)).alias("label"), F.lit(x).alias("level"), F.round(F.col("q")[i], 6).alias("value")) for i, x in enumerate(_LEVELS)])).alias("r")
    return q.select("event_type", rows).select("event_type", "r.*")


@query("SELECT event_type || '/' || k AS name, v AS value FROM (SELECT event_type, unnest(['count', 'value/max', 'value/min']) AS k, unnest([CAST(count(*) AS DOUBLE), max(value), min(value)]) AS v FROM events WHERE event_type IS NOT NULL GROUP BY 1)")
def sc11_flat_metrics(spark, root):
    """Nested metrics of a small report under flat names."""
    rows = table(spark, root, "events").where("event_type IS NOT NULL").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("a"), F.max("value").alias("b")).collect()  # a row per type
    report = {r.event_type: {"count": r.n, "value": {"min": r.a, "max": r.b}, "note": "text is left out"} for r in rows}
    return spark.createDataFrame(list(flat_metrics(report).items()), "name string, value double")


@query("SELECT record_id, epoch_us(received_at) AS received_us, CASE WHEN json_valid(payload) AND left(ltrim(payload), 1) = '{' THEN CAST(len(json_keys(payload)) AS INTEGER) END AS n_fields FROM raw_records")
def sc15_recovered(spark, root):
    """Records kept as JSON text become maps again; other styles stay null."""
    m = recovered(F.col("payload"), "map<string,string>")
    return table(spark, root, "raw_records").select("record_id", F.unix_micros("received_at").alias("received_us"), F.when(F.col("payload").rlike(r"^\s*\{"), F.size(F.map_keys(m))).alias("n_fields"))


_CATEGORIES = "SELECT list(DISTINCT product_canonical ORDER BY product_canonical) AS c FROM prepared WHERE period = 'train_2023_2024' AND product_canonical IS NOT NULL"


@query(f"SELECT complaint_id, epoch_us(loaded_at) AS loaded_us, array_to_string(list_transform((SELECT c FROM ({_CATEGORIES})), lambda x: CASE WHEN x = product_canonical THEN '1' ELSE '0' END), '') AS hot FROM prepared")
def tx02_one_hot(spark, root):
    """The product as a vector over the training period's categories; an unseen or null product is all zeros."""
    p = table(spark, root, "prepared")
    names = p.where("period = 'train_2023_2024' AND product_canonical IS NOT NULL").agg(F.array_sort(F.collect_set("product_canonical")).alias("c"))  # one row
    hot = F.transform("c", lambda x: F.coalesce((x == F.col("product_canonical")).cast("int"), F.lit(0)).cast("string"))
    return p.join(F.broadcast(names)).select("complaint_id", F.unix_micros("loaded_at").alias("loaded_us"), F.array_join(hot, "").alias("hot"))


# Budgets, thresholds, draws.
@query("SELECT score_run, count(DISTINCT cluster_id) AS n_series, round(1.0 / (365.25 / 12 / 7 * count(DISTINCT cluster_id)), 9) AS per_decision FROM weekly_panel GROUP BY 1")
def st07_alarm_budget(spark, root):
    """One false alarm a month over all series of a run, as a rate per decision."""
    n = table(spark, root, "weekly_panel").groupBy("score_run").agg(F.count_distinct("cluster_id").alias("n_series"))
    return n.select("score_run", "n_series", F.round(F.lit(Z.alarm_budget(1.0, 7, 1)) / F.col("n_series"), 9).alias("per_decision"))


@query(None)
def st08_cusum_limit(spark, root):
    """Limits of the cumulative sums for three false-alarm rates, by simulation and bisection, and from the observed scores."""
    scored = W._scored(spark, root).select("score_run", "cluster_id", "period", "z")
    rows = [(t, round(Z.cusum_limit(t, paths=500), 4), round(Z.empirical_limit(scored, ["score_run", "cluster_id"], "period", "z", t), 4)) for t in (0.01, 0.005, 0.001)]
    return spark.createDataFrame(rows, "target double, simulated_limit double, empirical_limit double")


@query(None)
def st14_draws(spark, root):
    """Twenty seeded draws of each scored week."""
    return Z.nb_draws(W._scored(spark, root).where("expected > 0"), ["score_run", "cluster_id", "period"], "expected", 8.0, 20)


@query(W.WK + W._Z_SQL + f", c AS (SELECT score_run, n, (SELECT sum(exp({R._LG})) FROM range(n + 1) r(i)) AS cdf FROM scored WHERE expected > 0) SELECT score_run, count(*) AS n_decisions, count(*) FILTER (WHERE cdf > 0.95) AS n_flags, round(count(*) * 0.05, 6) AS expected_flags, round(count(*) FILTER (WHERE cdf > 0.95) / (count(*) * 0.05), 6) AS ratio FROM c GROUP BY 1")
def st21_signal_summary(spark, root):
    """Flags at a level of 0.05 against as many as that level gives by chance."""
    rows = W._scored(spark, root).where("expected > 0").select("score_run", X.nb_cdf_udf(F.col("n").cast("double"), F.lit(8.0), F.col("expected")).alias("cdf"))
    n, flags = F.count(F.lit(1)), F.count_if(F.col("cdf") > 0.95)
    return rows.groupBy("score_run").agg(n.alias("n_decisions"), flags.alias("n_flags"), F.round(n * 0.05, 6).alias("expected_flags"), F.round(flags / (n * 0.05), 6).alias("ratio"))


@query(W.WK + W._Z_SQL + f" SELECT score_run, cluster_id, period, round(((SELECT COALESCE(sum(exp({R._LG})), 0) FROM range(n) r(i)) + (SELECT sum(exp({R._LG})) FROM range(n + 1) r(i))) / 2, 5) AS mid FROM scored WHERE expected > 0")
def st06_mid_probability(spark, root):
    """What ``st06`` sends through the normal quantile: half-way between the chances of fewer and of no more."""
    rows = W._scored(spark, root).where("expected > 0")
    cdf = lambda c: X.nb_cdf_udf(c.cast("double"), F.lit(8.0), F.col("expected"))
    return rows.select("score_run", "cluster_id", "period", F.round((cdf(F.col("n") - 1) + cdf(F.col("n"))) / 2, 5).alias("mid"))


# Search in an index.
_UNIT = "SELECT embedding_row AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, epoch_us(encoded_at) AS at FROM fit_embeddings WHERE embedding_row IS NOT NULL AND embedding IS NOT NULL QUALIFY row_number() OVER (PARTITION BY embedding_row ORDER BY encoded_at DESC) = 1"


@query(f"WITH v AS (SELECT id, e, sqrt(list_dot_product(e, e)) AS s FROM ({_UNIT})), u AS (SELECT id, list_transform(e, lambda x: x / s) AS e FROM v WHERE s > 0) SELECT a.id AS query_id, b.id AS vec_id, round(list_dot_product(a.e, b.e), 4) AS similarity FROM u a JOIN u b ON a.id <> b.id WHERE a.id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(list_dot_product(a.e, b.e), 7) DESC, b.id) <= 5")
def ml08_index_search(spark, root):
    """The five most similar of all vectors for every row whose id is divisible by 20, exactly."""
    rows = table(spark, root, "fit_embeddings").where("embedding_row IS NOT NULL AND embedding IS NOT NULL").groupBy(F.col("embedding_row").alias("vec_id")).agg(F.max_by("embedding", "encoded_at").alias("e"))
    size = F.sqrt(V.dot("e", "e"))
    unit = rows.withColumn("s", size).where("s > 0").select("vec_id", F.transform("e", lambda x: x.cast("double") / F.col("s")).alias("embedding"))
    return V.nearest(unit, unit.where("vec_id % 20 = 0"), 5).select("query_id", "vec_id", F.round("similarity", 4).alias("similarity"))


# The capped memory and the interval score of plug-in quantiles, which extra and series hold without SQL.
ORACLE["st02_capped_share"] = W.WK + """, k AS (SELECT *, dense_rank() OVER (PARTITION BY score_run ORDER BY period) AS i, sum(n) OVER (PARTITION BY score_run, period) AS total FROM wk),
m AS (SELECT score_run, cluster_id, period, n, total, i, CAST(0 AS DOUBLE) AS m FROM k WHERE i = 1 UNION ALL
  SELECT k.score_run, k.cluster_id, k.period, k.n, k.total, k.i, 0.95 * p.m + CASE WHEN p.i = 1 THEN p.n ELSE least(p.n, 2.0 * p.total * p.share) END
  FROM k JOIN (SELECT *, (m + 1) / (sum(m) OVER (PARTITION BY score_run) + count(*) OVER (PARTITION BY score_run)) AS share FROM m) p ON k.score_run = p.score_run AND k.cluster_id = p.cluster_id AND k.i = p.i + 1)
SELECT score_run, cluster_id, period, n, CASE WHEN i > 1 THEN round((m + 1) / (sum(m) OVER p + count(*) OVER p), 6) END AS memory_share FROM m WINDOW p AS (PARTITION BY score_run, period)"""
