"""Further queries: detection summaries, thresholds, calendars, contrasts, votes, comparison tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import special as X
from tidemark.operators import calendar as K
from tidemark.operators import series as S
from tidemark.operators import vectors as V
from tidemark.operators.lookups import small
from tidemark.operators.quantiles import exact_quantiles
from tidemark.plans import scores as R
from tidemark.plans import series as W
from tidemark.session import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(W._CUSUM_SQL + ", f AS (SELECT score_run, cluster_id, min(i) FILTER (WHERE cusum > 3.0) AS delay FROM c GROUP BY ALL) SELECT score_run, round(count(delay) / CAST(count(*) AS DOUBLE), 6) AS detected, round(quantile_cont(delay, 0.5), 6) AS median_delay FROM f GROUP BY score_run")
def ag17_detection_summary(spark, root):
    first = W.tk15_first_alarm(spark, root)
    return first.groupBy("score_run").agg(F.round(F.count("first_alarm") / F.count(F.lit(1)), 6).alias("detected"), F.round(F.percentile("first_alarm", F.lit(0.5)), 6).alias("median_delay"))


@query(R._CENTRES + ", m AS (SELECT vec_id, arg_min(part, distance) AS part, min(distance) AS d1, (list_sort(list(distance)))[2] AS d2 FROM d GROUP BY 1) SELECT part, count(*) AS n, round(avg(CAST((d2 - d1) / d1 < 0.1 AS INTEGER)), 6) AS near_border, round(avg(CAST(d1 > 1 AS INTEGER)), 6) AS far_out FROM m GROUP BY part")
def ag37_boundary_mass(spark, root):
    e = table(spark, root, "embeddings")
    got = V.assign(V.margins(e, V.centres(e, "label")), V.centres(e, "label"))
    return got.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("margin") < 0.1).cast("int")), 6).alias("near_border"), F.round(F.avg((F.col("distance") > 1).cast("int")), 6).alias("far_out"))


@query(W.WK + W._Z_SQL + " SELECT a.score_run, a.cluster_id, a.period, round(a.expected, 6) AS expected, b.n AS observed, b.n <> a.n AS mismatch FROM scored a LEFT JOIN wk b ON a.score_run = b.score_run AND a.cluster_id = b.cluster_id AND a.period = b.period + 7")
def jn05_reference_joined(spark, root):
    b = W.weekly(spark, root).select("score_run", "cluster_id", F.date_add("period", 7).alias("period"), F.col("n").alias("observed"))
    got = W._scored(spark, root).join(b, ["score_run", "cluster_id", "period"], "left")
    return got.select("score_run", "cluster_id", "period", F.round("expected", 6).alias("expected"), "observed", (F.col("observed") != F.col("n")).alias("mismatch"))


@query(R._CENTRES + ", q AS (SELECT vec_id, part, exp(-distance) / sum(exp(-distance)) OVER (PARTITION BY vec_id) AS p FROM d) SELECT vec_id, part, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY round(p, 9) DESC, part) AS INTEGER) AS place, round(p, 5) AS probability FROM q QUALIFY place <= 3")
def tk02_top_three_by_probability(spark, root):
    e = table(spark, root, "embeddings")
    near = V._distances(e, V.centres(e, "label"), "embedding").select("vec_id", F.explode("_near").alias("c"))
    p = F.exp(-F.col("c.distance")) / F.sum(F.exp(-F.col("c.distance"))).over(Window.partitionBy("vec_id"))
    rows = near.select("vec_id", F.col("c.part").alias("part"), p.alias("p"))
    w = Window.partitionBy("vec_id").orderBy(F.desc(F.round("p", 9)), "part")
    return rows.withColumn("place", F.row_number().over(w)).where("place <= 3").select("vec_id", "part", "place", F.round("p", 5).alias("probability"))


@query("SELECT m.embedding_row, len(e.embedding) + 2 AS size, CAST(CASE WHEN m.product_canonical = 'Home loan' THEN 1 ELSE 0 END AS DOUBLE) AS last_value FROM (SELECT DISTINCT embedding_row, product_canonical FROM sample_manifest WHERE embedding_row IS NOT NULL) m JOIN (SELECT embedding_row, min(shard_no) AS s, any_value(embedding) AS embedding FROM fit_embeddings WHERE embedding IS NOT NULL GROUP BY 1) e USING (embedding_row)")
def tx03_stacked_features(spark, root):
    m = table(spark, root, "sample_manifest").where("embedding_row IS NOT NULL").select("embedding_row", "product_canonical").distinct()
    e = table(spark, root, "fit_embeddings").where("embedding IS NOT NULL").groupBy("embedding_row").agg(F.first("embedding").alias("v"))
    hot = [F.coalesce((F.col("product_canonical") == p).cast("double"), F.lit(0.0)) for p in ("Study loan", "Home loan")]
    x = m.join(e, "embedding_row").select("embedding_row", F.concat(F.col("v").cast("array<double>"), F.array(*hot)).alias("x"))
    return x.select("embedding_row", F.size("x").cast("long").alias("size"), F.element_at("x", -1).alias("last_value"))


@query(R._CENTRES + ", t AS (SELECT part, quantile_cont(distance, 0.9) AS p90 FROM a WHERE part = label GROUP BY 1) SELECT a.part, count(*) AS n, count(*) FILTER (WHERE distance <= p90) AS n_accepted FROM a LEFT JOIN t USING (part) GROUP BY a.part")
def ml17_accepted_assignments(spark, root):
    a = R._assigned(spark, root)
    limit = exact_quantiles(a.where("part = label"), ["part"], "distance", [0.9]).select("part", F.col("q")[0].alias("p90"))
    return a.join(small(limit), "part", "left").groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("distance") <= F.col("p90")).alias("n_accepted"))


_LIMITS = (1.0, 2.0, 3.0, 4.0, 6.0)


@query(W.WK + W._Z_SQL + f""", h AS (SELECT CAST(h AS DOUBLE) AS h FROM (VALUES {', '.join(f'({x})' for x in _LIMITS)}) v(h)), o AS (SELECT *, row_number() OVER (PARTITION BY score_run, cluster_id ORDER BY period) AS i FROM scored),
c AS (SELECT h.h, score_run, cluster_id, i, greatest(0, COALESCE(z, 0) - 0.5) AS s FROM o, h WHERE i = 1 UNION ALL SELECT c.h, o.score_run, o.cluster_id, o.i, greatest(0, (CASE WHEN c.s > c.h THEN 0 ELSE c.s END) + COALESCE(o.z, 0) - 0.5) FROM o JOIN c ON o.score_run = c.score_run AND o.cluster_id = c.cluster_id AND o.i = c.i + 1)
SELECT h AS limit_h, round(avg(CAST(s > h AS INTEGER)), 6) AS alarm_rate FROM c GROUP BY h""")
def st08_alarm_rates_by_limit(spark, root):
    scored = W._scored(spark, root).select("score_run", "cluster_id", "period", "z")
    out = None
    for h in _LIMITS:
        one = S.upper_cusum(scored, ["score_run", "cluster_id"], "period", "z", 0.5, h).agg(F.lit(h).alias("limit_h"), F.round(F.avg(F.col("alarm").cast("int")), 6).alias("alarm_rate"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT cluster, CAST(contrast AS INTEGER) AS contrast, round((CASE WHEN cluster < contrast THEN 1.0 WHEN cluster = contrast THEN -contrast ELSE 0 END) / sqrt(contrast * (contrast + 1)) * sqrt(8 / 7.0), 6) + 0.0 AS value FROM range(8) a(cluster), range(1, 8) b(contrast)")
def st13_helmert(spark, root):
    return K.helmert(spark, 8).withColumn("value", F.round("value", 6) + 0.0)


@query(W.WK + ", k AS (SELECT unnest([10.0, 50.0, 250.0]) AS kappa), s AS (SELECT *, sum(n) OVER p AS total, lag(n, 1, 0) OVER (PARTITION BY score_run, cluster_id ORDER BY period) + 1.0 AS a FROM wk WINDOW p AS (PARTITION BY score_run, period)), b AS (SELECT *, a / sum(a) OVER (PARTITION BY score_run, period) AS share FROM s), l AS (SELECT score_run, period, kappa, lgamma(kappa) + lgamma(any_value(total) + 1) - lgamma(any_value(total) + kappa) + sum(lgamma(n + kappa * share) - lgamma(kappa * share) - lgamma(n + 1)) AS v FROM b, k GROUP BY score_run, period, kappa) SELECT score_run, period, round(any_value(m) + ln(sum(exp(v - m)) / 3), 5) AS log_score FROM (SELECT *, max(v) OVER (PARTITION BY score_run, period) AS m FROM l) GROUP BY score_run, period")
def st18_mixture_log_score(spark, root):
    lg, w = X.lgamma_udf, Window.partitionBy("score_run", "period")
    rows = W.weekly(spark, root).withColumn("a", F.lag("n", 1, 0).over(Window.partitionBy("score_run", "cluster_id").orderBy("period")) + 1.0).withColumn("share", F.col("a") / F.sum("a").over(w))
    rows = rows.select("score_run", "period", "n", "share", F.explode(F.array(F.lit(10.0), F.lit(50.0), F.lit(250.0))).alias("kappa"))
    part = lg(F.col("n") + F.col("kappa") * F.col("share")) - lg(F.col("kappa") * F.col("share")) - lg(F.col("n") + F.lit(1.0))
    per = rows.withColumn("part", part).groupBy("score_run", "period", "kappa").agg(F.sum("part").alias("part"), F.sum("n").cast("double").alias("t"))
    v = per.withColumn("v", F.col("part") + lg(F.col("kappa")) + lg(F.col("t") + F.lit(1.0)) - lg(F.col("t") + F.col("kappa")))
    return v.withColumn("m", F.max("v").over(w)).groupBy("score_run", "period").agg(F.round(F.max("m") + F.log(F.sum(F.exp(F.col("v") - F.col("m"))) / 3), 5).alias("log_score"))


@query(W.WK + ", f AS (SELECT score_run, cluster_id, sum(n) FILTER (WHERE period < DATE '2025-10-01') + 1.0 AS a FROM wk GROUP BY ALL) SELECT score_run, cluster_id, round(a / sum(a) OVER (PARTITION BY score_run), 6) AS mean_share FROM f")
def st23_conjugate_shares(spark, root):
    f = W.weekly(spark, root).groupBy("score_run", "cluster_id").agg((F.sum(F.when(F.col("period") < F.lit("2025-10-01").cast("date"), F.col("n"))) + 1.0).alias("a"))
    return f.select("score_run", "cluster_id", F.round(F.col("a") / F.sum("a").over(Window.partitionBy("score_run")), 6).alias("mean_share"))


@query("SELECT doc_id, length(text) AS n_chars, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) AS n_words, contains(text, 'XXXX') AS redacted, contains(text, chr(10)) AS several_lines FROM documents WHERE text IS NOT NULL")
def sc03_text_measures(spark, root):
    return table(spark, root, "documents").where("text IS NOT NULL").select("doc_id", F.length("text").cast("long").alias("n_chars"), F.regexp_count("text", F.lit(r"[^ \t\n\r\f\x0B]+")).cast("long").alias("n_words"), F.col("text").contains("XXXX").alias("redacted"), F.col("text").contains("\n").alias("several_lines"))


_HOLIDAYS = [dt.date(y, m, d) for y in range(2020, 2028) for m, d in ((1, 1), (5, 1), (10, 8), (12, 8), (12, 25))]


@query(f"""WITH days AS (SELECT d, row_number() OVER (ORDER BY d) AS i FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '2020-01-01', TIMESTAMP '2027-12-31', INTERVAL 1 DAY)) AS DATE) AS d) WHERE isodow(d) < 6 AND d NOT IN ({', '.join(f"DATE '{h}'" for h in _HOLIDAYS)}))
SELECT DISTINCT p.date_received, (SELECT d FROM days WHERE i = 15 + (SELECT max(i) FROM days WHERE d <= p.date_received)) AS due FROM prepared p WHERE p.date_received IS NOT NULL""")
def sc07_working_day_offset(spark, root):
    days = K.working_days(spark, dt.date(2020, 1, 1), dt.date(2027, 12, 31), _HOLIDAYS)
    dates = table(spark, root, "prepared").where("date_received IS NOT NULL").select("date_received").distinct()
    return K.due_after(dates, "date_received", 15, days, "due")


@query("SELECT DISTINCT score_run, week, CAST(DATE '2025-01-06' + CAST(7 * (dense_rank() OVER (PARTITION BY score_run ORDER BY week) - 1) AS INTEGER) AS DATE) AS regular_week FROM weekly_panel")
def sc12_regular_weeks(spark, root):
    weeks = table(spark, root, "weekly_panel").select("score_run", "week").distinct()
    n = F.row_number().over(Window.partitionBy("score_run").orderBy("week"))
    return weeks.select("score_run", "week", F.date_add(F.lit("2025-01-06").cast("date"), 7 * (n - 1)).alias("regular_week"))


@query("SELECT event_type, round((q[2] + q[3]) / 2, 6) AS q25, round((q[7] + q[8]) / 2, 6) AS q75 FROM (SELECT event_type, quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM events GROUP BY 1)")
def sc13_quartiles_from_deciles(spark, root):
    q = exact_quantiles(table(spark, root, "events"), ["event_type"], "value", [i / 10 for i in range(1, 10)])
    return q.select("event_type", F.round((F.col("q")[1] + F.col("q")[2]) / 2, 6).alias("q25"), F.round((F.col("q")[6] + F.col("q")[7]) / 2, 6).alias("q75"))


@query(R._WIS + "SELECT model, score_run, round(v, 6) AS value FROM (SELECT 'rolling 4, wis' AS model, score_run, avg(wis) AS v FROM i GROUP BY 2 UNION ALL SELECT 'rolling 4, mae', score_run, avg(abs(n - expected)) FROM i GROUP BY 2)")
def mt20_comparison_table(spark, root):
    i = R._intervals(spark, root)
    a = i.groupBy("score_run").agg(F.avg("wis").alias("value")).withColumn("model", F.lit("rolling 4, wis"))
    b = i.groupBy("score_run").agg(F.avg(F.abs(F.col("n") - F.col("expected"))).alias("value")).withColumn("model", F.lit("rolling 4, mae"))
    return a.unionByName(b).select("model", "score_run", F.round("value", 6).alias("value"))


@query(None)
def mt12_interval_score_by_quantiles(spark, root):
    """The interval score of plug-in negative-binomial quantiles instead of draws."""
    from tidemark.operators.metrics import weighted_interval_score

    rows = W._scored(spark, root).where("expected > 0")
    q = {p: X.nb_quantile_udf(p)(F.lit(8.0), F.col("expected")) for p in (0.1, 0.25, 0.5, 0.75, 0.9)}
    rows = rows.withColumns({f"q{int(100 * p)}": c for p, c in q.items()})
    wis = weighted_interval_score(F.col("n"), F.col("q50"), {0.2: (F.col("q10"), F.col("q90")), 0.5: (F.col("q25"), F.col("q75"))})
    return rows.groupBy("score_run").agg(F.round(F.avg(wis), 6).alias("wis"))


@query(None)
def st04_reweighted_memory(spark, root):
    from tidemark.operators.simulation import reweighted_shares

    got = reweighted_shares(W.weekly(spark, root), 0.95, 8.0, 2.0)
    return got.select("score_run", "period", "cluster_id", "n", F.round("memory_share", 6).alias("memory_share"), F.round("z", 5).alias("z"))


@query(None)
def st19_rare_mixtures(spark, root):
    from tidemark.operators.simulation import rare_mixtures

    return rare_mixtures(S.lagged_shares(W.weekly(spark, root), 4).withColumnRenamed("recent_share", "share"), 50.0).withColumn("p_value", F.round("p_value", 6))


@query("SELECT y AS year, count(*) AS n_groups, count(*) FILTER (WHERE n > 1) AS n_repeated, CAST(COALESCE(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS rows_repeated, CAST(sum(n - 1) AS BIGINT) AS extra_copies, max(n) AS largest FROM (SELECT year(date_received) AS y, hash, count(*) AS n FROM prepared WHERE hash IS NOT NULL AND date_received IS NOT NULL GROUP BY 1, hash) GROUP BY 1")
def ag23_repetition_by_year(spark, root):
    g = table(spark, root, "prepared").where("hash IS NOT NULL AND date_received IS NOT NULL").groupBy(F.year("date_received").cast("long").alias("year"), "hash").agg(F.count(F.lit(1)).alias("n"))
    many = F.col("n") > 1
    return g.groupBy("year").agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(many).alias("n_repeated"), F.sum(F.when(many, F.col("n")).otherwise(0)).alias("rows_repeated"), F.sum(F.col("n") - 1).alias("extra_copies"), F.max("n").alias("largest"))


@query(R._RANKS + "SELECT p.complaint_id, epoch_us(p.loaded_at) AS loaded_us, EXISTS (SELECT 1 FROM top WHERE top.g = p.product_canonical AND top.t1 = p.t1) AS hit FROM prepared p WHERE period = 'validation_2025_h1' AND t1 IS NOT NULL")
def tk03_top_three_hit(spark, root):
    top = R._ranks(spark, root).groupBy(F.col("g").alias("product_canonical")).agg(F.collect_set("t1").alias("best"))
    rows = table(spark, root, "prepared").where("period = 'validation_2025_h1' AND t1 IS NOT NULL").join(top, "product_canonical", "left")
    return rows.select("complaint_id", F.unix_micros("loaded_at").alias("loaded_us"), F.coalesce(F.array_contains("best", F.col("t1")), F.lit(False)).alias("hit"))


@query("""WITH fit AS (SELECT product_canonical AS g, t1, t2 FROM prepared WHERE period = 'train_2023_2024'), a AS (SELECT avg(CAST(t2 AS INTEGER)) AS r FROM fit),
r AS (SELECT g, avg(CAST(t2 AS INTEGER)) AS r FROM fit GROUP BY 1), c AS (SELECT g, t1 FROM fit WHERE t1 IS NOT NULL AND g IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY g ORDER BY count(*) DESC, t1) = 1)
SELECT p.complaint_id, epoch_us(p.loaded_at) AS loaded_us, c.t1 AS first_class, round(COALESCE(r.r, (SELECT r FROM a)), 6) AS rate FROM prepared p LEFT JOIN r ON p.product_canonical = r.g LEFT JOIN c ON p.product_canonical = c.g WHERE p.period = 'validation_2025_h1'""")
def ml03_frequency_baseline(spark, root):
    from tidemark.operators.profile import dominant

    p = table(spark, root, "prepared")
    fit = p.where("period = 'train_2023_2024'")
    rate = fit.groupBy("product_canonical").agg(F.avg(F.col("t2").cast("int")).alias("r"))
    whole = fit.agg(F.avg(F.col("t2").cast("int")).alias("a"))  # one row
    first = dominant(fit.where("product_canonical IS NOT NULL"), ["product_canonical"], "t1").select("product_canonical", F.col("t1").alias("first_class"))
    rows = p.where("period = 'validation_2025_h1'").select("complaint_id", F.unix_micros("loaded_at").alias("loaded_us"), "product_canonical")
    got = rows.join(rate, "product_canonical", "left").join(first, "product_canonical", "left").join(F.broadcast(whole))
    return got.select("complaint_id", "loaded_us", "first_class", F.round(F.coalesce("r", "a"), 6).alias("rate"))


@query(R._NEAR + ", t AS (SELECT q, max(s) AS top FROM k GROUP BY 1), l AS (SELECT quantile_cont(top, 0.05) AS q05 FROM t) SELECT q AS query_id, round(top, 5) AS top_similarity, top < (SELECT q05 FROM l) AS is_novel FROM t")
def ml11_similarity_novelty(spark, root):
    top = R._near(spark, root).groupBy("query_id").agg(F.max("similarity").alias("top"))
    limit = exact_quantiles(top, [], "top", [0.05]).select(F.col("q")[0].alias("q05"))  # one row
    return top.join(F.broadcast(limit)).select("query_id", F.round("top", 5).alias("top_similarity"), (F.col("top") < F.col("q05")).alias("is_novel"))


@query(f"SELECT label, count(*) AS n, round(min(c), 5) AS least_cosine, round(avg(c), 5) AS mean_cosine FROM (SELECT e.label, list_dot_product(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)), m.centre) / sqrt(list_dot_product(m.centre, m.centre)) AS c FROM embeddings e JOIN ({R._CENTRES.split('d AS')[0].replace('WITH c AS (', '').rstrip().rstrip(',').rstrip(')')}) m USING (label)) GROUP BY label")
def ml08_cosine_with_centre(spark, root):
    e = table(spark, root, "embeddings")
    cs = V.centres(e, "label").withColumnRenamed("part", "label")
    c = V.dot("embedding", "centre") / F.sqrt(V.dot("centre", "centre"))
    return e.join(F.broadcast(cs), "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.min(c), 5).alias("least_cosine"), F.round(F.avg(c), 5).alias("mean_cosine"))


@query(W.WK + W._Z_SQL + """, s AS (SELECT * FROM (VALUES ('none', 1.0), ('half more', 1.5), ('double', 2.0)) v(name, factor)), o AS (SELECT s.name, score_run, cluster_id, row_number() OVER (PARTITION BY s.name, score_run, cluster_id ORDER BY period) AS i, CASE WHEN expected > 0 THEN (n * CAST(factor AS DOUBLE) - expected) / sqrt(expected) END AS z FROM scored, s WHERE period >= DATE '2025-09-01'),
c AS (SELECT name, score_run, cluster_id, i, greatest(0, COALESCE(z, 0) - 0.5) AS s FROM o WHERE i = 1 UNION ALL SELECT o.name, o.score_run, o.cluster_id, o.i, greatest(0, (CASE WHEN c.s > 3.0 THEN 0 ELSE c.s END) + COALESCE(o.z, 0) - 0.5) FROM o JOIN c ON o.name = c.name AND o.score_run = c.score_run AND o.cluster_id = c.cluster_id AND o.i = c.i + 1)
SELECT name, count(*) AS n_series, count(first) AS n_detected, CAST(min(first) AS BIGINT) AS soonest FROM (SELECT name, score_run, cluster_id, min(i) FILTER (WHERE s > 3.0) AS first FROM c GROUP BY ALL) GROUP BY name""")
def jn10_scenarios_by_series(spark, root):
    # Scenarios are a constant array exploded per row; every (scenario, series) is then a fold of its own.
    names = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(x).alias("factor")) for n, x in (("none", 1.0), ("half more", 1.5), ("double", 2.0))])).alias("s")
    rows = W._scored(spark, root).where(F.col("period") >= F.lit("2025-09-01").cast("date")).select("score_run", "cluster_id", "period", "n", "expected", names)
    z = F.when(F.col("expected") > 0, (F.col("n") * F.col("s.factor") - F.col("expected")) / F.sqrt("expected"))
    by = ["name", "score_run", "cluster_id"]
    sums = S.upper_cusum(rows.select(F.col("s.name").alias("name"), "score_run", "cluster_id", "period", z.alias("z")), by, "period", "z", 0.5, 3.0)
    place = F.row_number().over(Window.partitionBy(*by).orderBy("period")).cast("long")
    first = sums.withColumn("i", place).groupBy(*by).agg(F.min(F.when(F.col("alarm"), F.col("i"))).alias("first"))
    return first.groupBy("name").agg(F.count(F.lit(1)).alias("n_series"), F.count("first").alias("n_detected"), F.min("first").alias("soonest"))


@query("""WITH g AS (SELECT product_canonical AS part, unnest(regexp_split_to_array(lower(narrative), '[^\\p{L}\\p{N}]+')) AS w FROM prepared WHERE narrative IS NOT NULL AND product_canonical IS NOT NULL)
SELECT part, count(*) AS n_tokens, count(DISTINCT w) AS n_words FROM g WHERE length(w) > 1 GROUP BY part""")
def ag20_tokens_per_group(spark, root):
    from tidemark.functions.text import tokens

    rows = table(spark, root, "prepared").where("narrative IS NOT NULL AND product_canonical IS NOT NULL").select(F.col("product_canonical").alias("part"), F.explode(tokens(F.col("narrative"))).alias("w"))
    per = rows.groupBy("part", "w").agg(F.count(F.lit(1)).alias("n"))  # words, not texts, are brought together
    return per.groupBy("part").agg(F.sum("n").alias("n_tokens"), F.count(F.lit(1)).alias("n_words"))


@query("""WITH w AS (SELECT row_number() OVER (ORDER BY week) AS i, week FROM (SELECT DISTINCT week FROM weekly_panel)), k AS (SELECT count(*) AS n FROM w),
p AS (SELECT d.draw, CAST(floor(((d.draw * 7919 + l.place * 104729 + 11) * 2654435761) % 4294967296 / 65536) AS BIGINT) % k.n + 1 AS i FROM (SELECT unnest(range(50)) AS draw) d, k, LATERAL (SELECT unnest(range(1, k.n + 1)) AS place) l)
SELECT draw, week, count(*) AS weight FROM p JOIN w USING (i) GROUP BY ALL""")
def mt11_resampling_weights(spark, root):
    weeks = table(spark, root, "weekly_panel").select("week").distinct()
    ranked = weeks.select("week", F.row_number().over(Window.orderBy("week")).cast("long").alias("i"))  # over one row per week
    n = ranked.agg(F.count(F.lit(1)).alias("n"))
    picks = spark.range(50).withColumnRenamed("id", "draw").join(F.broadcast(n)).select("draw", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("place"))
    mixed = F.pmod((F.col("draw") * 7919 + F.col("place") * 104729 + 11) * F.lit(2654435761), F.lit(1 << 32))
    picks = picks.select("draw", (F.pmod(F.floor(mixed / 65536), F.col("n")) + 1).alias("i"))
    return picks.join(ranked, "i").groupBy("draw", "week").agg(F.count(F.lit(1)).alias("weight"))
