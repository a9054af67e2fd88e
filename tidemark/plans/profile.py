"""Queries that profile complaints, texts, taxonomies and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import profile as P
from tidemark.operators.quantiles import exact_quantiles
from tidemark.session import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _prepared(spark, root):
    return table(spark, root, "prepared")


_FIELDS = ["product", "submitted_via", "timely_response", "company_response", "tags", "period"]


@query(" UNION ALL ".join(f"SELECT '{f}' AS field_name, {f} AS value, count(*) AS n FROM prepared GROUP BY {f}" for f in _FIELDS))
def ag05_value_counts(spark, root):
    return P.value_counts(_prepared(spark, root), _FIELDS)


@query(" UNION ALL ".join(f"SELECT '{f}' AS column_name, count({f}) AS n_present, round(100 * (1 - CAST(count({f}) AS DOUBLE) / count(*)), 2) AS percent_null, count(DISTINCT {f}) AS n_distinct FROM prepared" for f in [*_FIELDS, "company", "issue", "zip_code"]))
def ag06_column_summary(spark, root):
    return P.column_summary(_prepared(spark, root), [*_FIELDS, "company", "issue", "zip_code"])


@query("SELECT period, CASE WHEN length(v) > 40 THEN concat(substr(v, 1, 39), '…') ELSE v END AS example FROM (SELECT period, arg_min(sub_issue, complaint_id) FILTER (WHERE sub_issue IS NOT NULL) AS v FROM (SELECT period, complaint_id, max(sub_issue) AS sub_issue FROM prepared GROUP BY ALL) GROUP BY period)")
def ag06_first_example(spark, root):
    one = _prepared(spark, root).groupBy("period", "complaint_id").agg(F.max("sub_issue").alias("sub_issue"))
    return one.groupBy("period").agg(P.first_example(F.col("sub_issue"), F.col("complaint_id")).alias("example"))


_SIZES = "WITH g AS (SELECT hash, count(*) AS n FROM prepared WHERE hash IS NOT NULL GROUP BY 1) "


@query(_SIZES + "SELECT count(*) AS n_groups, count(*) FILTER (WHERE n > 1) AS n_repeated, CAST(COALESCE(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS rows_repeated, CAST(sum(n - 1) AS BIGINT) AS extra_copies, max(n) AS largest, round(100.0 * COALESCE(sum(n) FILTER (WHERE n > 1), 0) / sum(n), 6) AS percent_repeated FROM g")
def ag07_repeated_texts(spark, root):
    return P.repetition(_prepared(spark, root), "hash")


@query(" UNION ALL ".join(f"SELECT period, '{t}' AS target, count({t}) AS n_known, round(100 * COALESCE(avg(CAST({t} AS INTEGER)), 0), 3) AS percent_true FROM prepared GROUP BY period" for t in ("t2", "t3", "t4")))
def ag08_positive_rates(spark, root):
    return P.positive_rates(_prepared(spark, root), {t: F.col(t) for t in ("t2", "t3", "t4")}, "period")


@query(" UNION ALL ".join(f"SELECT period, 'eligible_t{i}_complete' AS flag, count(*) FILTER (WHERE eligible_t{i}_complete) AS n FROM prepared GROUP BY period" for i in range(1, 5)))
def ag09_flags_by_period(spark, root):
    flags = F.explode(F.array(*[F.struct(F.lit(f"eligible_t{i}_complete").alias("flag"), F.col(f"eligible_t{i}_complete").alias("v")) for i in range(1, 5)])).alias("f")
    return _prepared(spark, root).select("period", flags).groupBy("period", "f.flag").agg(F.count_if("f.v").alias("n"))


@query("""WITH c AS (SELECT period, t1, count(*) AS n FROM prepared WHERE t1 IS NOT NULL GROUP BY 1, 2)
SELECT period, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_classes, min(n) AS smallest, count(*) FILTER (WHERE t1 NOT IN (SELECT t1 FROM c WHERE period = 'train_2023_2024')) AS n_unseen FROM c GROUP BY period""")
def ag10_class_contract(spark, root):
    c = _prepared(spark, root).where("t1 IS NOT NULL").groupBy("period", "t1").agg(F.count(F.lit(1)).alias("n"))
    seen = c.where("period = 'train_2023_2024'").select("t1", F.lit(True).alias("seen"))
    return c.join(seen, "t1", "left").groupBy("period").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_classes"), F.min("n").alias("smallest"), F.count_if(F.col("seen").isNull()).alias("n_unseen"))


@query("SELECT product_canonical, round(avg(CAST(t2 AS INTEGER)), 6) AS rate, count(t2) AS n FROM prepared WHERE period = 'train_2023_2024' GROUP BY 1")
def ag11_group_means(spark, root):
    return _prepared(spark, root).where("period = 'train_2023_2024'").groupBy("product_canonical").agg(F.round(F.avg(F.col("t2").cast("int")), 6).alias("rate"), F.count("t2").alias("n"))


@query("""WITH r AS (SELECT product_canonical AS g, hash, length(narrative) AS n FROM prepared WHERE hash IS NOT NULL AND product_canonical IS NOT NULL),
h AS (SELECT g, hash, count(*) AS c FROM r GROUP BY ALL)
SELECT r.g AS product_canonical, count(*) AS n_rows, round(count(DISTINCT hash) / CAST(count(*) AS DOUBLE), 6) AS unique_text_fraction, round((SELECT max(c) FROM h WHERE h.g = r.g) / CAST(count(*) AS DOUBLE), 6) AS dominant_template_fraction,
round(quantile_cont(n, 0.5), 6) AS median_chars, round(quantile_cont(n, 0.95), 6) AS p95_chars FROM r GROUP BY r.g""")
def ag12_group_summary(spark, root):
    r = _prepared(spark, root).where("hash IS NOT NULL AND product_canonical IS NOT NULL").select("product_canonical", "hash", F.length("narrative").alias("n"))
    h = r.groupBy("product_canonical", "hash").agg(F.count(F.lit(1)).alias("c")).groupBy("product_canonical").agg(F.sum("c").alias("n_rows"), F.round(F.count(F.lit(1)) / F.sum("c"), 6).alias("unique_text_fraction"), F.round(F.max("c") / F.sum("c"), 6).alias("dominant_template_fraction"))
    q = exact_quantiles(r, ["product_canonical"], "n", [0.5, 0.95]).select("product_canonical", F.round(F.col("q")[0], 6).alias("median_chars"), F.round(F.col("q")[1], 6).alias("p95_chars"))
    return h.join(q, "product_canonical")


@query("SELECT split, cluster_id, round(avg(complaint_count), 6) AS mean_count, round(avg(proportion), 6) AS mean_share, round(sum(novel_count) / CAST(greatest(sum(complaint_count), 1) AS DOUBLE), 6) AS novel_fraction FROM weekly_panel WHERE is_complete_week GROUP BY ALL")
def ag13_weekly_summary(spark, root):
    w = table(spark, root, "weekly_panel").where("is_complete_week")
    return w.groupBy("split", "cluster_id").agg(F.round(F.avg("complaint_count"), 6).alias("mean_count"), F.round(F.avg("proportion"), 6).alias("mean_share"), F.round(F.sum("novel_count") / F.greatest(F.sum("complaint_count"), F.lit(1)), 6).alias("novel_fraction"))


@query("SELECT split, COALESCE(cluster_id, -1) AS cluster_id, count(*) AS n_rows, CAST(COALESCE(sum(complaint_count), 0) AS BIGINT) AS n FROM weekly_panel GROUP BY split, ROLLUP (cluster_id)")
def ag14_global_and_clusters(spark, root):
    w = table(spark, root, "weekly_panel").where("cluster_id IS NOT NULL")
    both = w.groupBy("split", "cluster_id").agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("complaint_count"), F.lit(0)).alias("n"))
    whole = both.groupBy("split").agg(F.sum("n_rows").alias("n_rows"), F.sum("n").alias("n")).withColumn("cluster_id", F.lit(-1))
    return both.unionByName(whole)


@query("SELECT week, CAST(sum(complaint_count) AS BIGINT) AS n, round(sum(abs(complaint_count - proportion * weekly_total)), 6) AS abs_error, round(sum(pow(complaint_count - proportion * weekly_total, 2)), 6) AS sq_error FROM weekly_panel GROUP BY week")
def ag15_additive_sums(spark, root):
    e = F.col("complaint_count") - F.col("proportion") * F.col("weekly_total")
    return table(spark, root, "weekly_panel").groupBy("week").agg(F.sum("complaint_count").alias("n"), F.round(F.sum(F.abs(e)), 6).alias("abs_error"), F.round(F.sum(F.pow(e, F.lit(2))), 6).alias("sq_error"))


_LEVELS = [0.025, 0.1, 0.25, 0.5, 0.75, 0.9, 0.975]


@query("SELECT event_type, round(avg(value), 6) AS mean, " + ", ".join(f"round(quantile_cont(value, {q}), 6) AS p{str(q)[2:].ljust(2, '0')}" for q in _LEVELS) + " FROM events GROUP BY event_type")
def ag19_quantiles(spark, root):
    e = table(spark, root, "events")
    mean = e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"))
    rows = mean.join(exact_quantiles(e, ["event_type"], "value", _LEVELS).withColumnRenamed("event_type", "_t"), F.col("event_type").eqNullSafe(F.col("_t")))
    return rows.select("event_type", "mean", *[F.round(F.col("q")[i], 6).alias(f"p{str(x)[2:].ljust(2, '0')}") for i, x in enumerate(_LEVELS)])


@query("SELECT COALESCE(product_canonical, '(all)') AS product_canonical, COALESCE(submitted_via, '(all)') AS submitted_via, count(*) AS n FROM (SELECT COALESCE(product_canonical, '?') AS product_canonical, COALESCE(submitted_via, '?') AS submitted_via FROM prepared) GROUP BY CUBE (product_canonical, submitted_via)")
def ag21_crosstab_margins(spark, root):
    rows = _prepared(spark, root).select(F.coalesce("product_canonical", F.lit("?")).alias("product_canonical"), F.coalesce("submitted_via", F.lit("?")).alias("submitted_via"))
    return rows.cube("product_canonical", "submitted_via").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("product_canonical", F.lit("(all)")).alias("product_canonical"), F.coalesce("submitted_via", F.lit("(all)")).alias("submitted_via"), "n")


_GROUPS = """WITH r AS (SELECT hash, company, product, date_received AS d FROM prepared WHERE hash IS NOT NULL), g AS (SELECT hash, count(*) AS n, count(DISTINCT company) AS n_companies, count(DISTINCT product) AS n_products, min(d) AS first_day, max(d) AS last_day, CAST(max(d) - min(d) AS INTEGER) AS span_days FROM r GROUP BY 1 HAVING count(*) > 1)
"""


def _groups(spark, root):
    r = _prepared(spark, root).where("hash IS NOT NULL")
    return r.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("company").alias("n_companies"), F.count_distinct("product").alias("n_products"), F.min("date_received").alias("first_day"), F.max("date_received").alias("last_day"), F.datediff(F.max("date_received"), F.min("date_received")).alias("span_days")).where("n > 1")


@query(_GROUPS + ", c AS (SELECT hash, company, count(*) AS k, row_number() OVER (PARTITION BY hash ORDER BY count(*) DESC, company) AS i, sum(count(*)) OVER (PARTITION BY hash) AS a FROM r WHERE company IS NOT NULL GROUP BY 1, 2) SELECT g.*, c.company AS main_company, round(c.k / CAST(c.a AS DOUBLE), 6) AS main_share FROM g LEFT JOIN c ON g.hash = c.hash AND c.i = 1")
def ag22_group_profiles(spark, root):
    top = P.dominant(_prepared(spark, root).where("hash IS NOT NULL"), ["hash"], "company").select("hash", F.col("company").alias("main_company"), F.col("share").alias("main_share"))
    return _groups(spark, root).join(top, "hash", "left")


@query(_GROUPS + "SELECT count(*) AS n_groups, count(*) FILTER (WHERE span_days > 0) AS several_days, count(*) FILTER (WHERE year(first_day) <> year(last_day)) AS across_years, max(span_days) AS longest FROM g")
def ag24_group_spans(spark, root):
    return _groups(spark, root).agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("span_days") > 0).alias("several_days"), F.count_if(F.year("first_day") != F.year("last_day")).alias("across_years"), F.max("span_days").alias("longest"))


_SIGNALS = {"same_day": "span_days = 0", "template": "n_companies > 1 AND span_days > 30", "burst": "n >= 3 AND n_companies = 1 AND n_products = 1 AND span_days <= 7", "long": "span_days > 365"}


@query(_GROUPS + " UNION ALL ".join(f"SELECT '{k}' AS signal, count(*) FILTER (WHERE {v}) AS n_groups, CAST(COALESCE(sum(n) FILTER (WHERE {v}), 0) AS BIGINT) AS n_rows FROM g" for k, v in _SIGNALS.items()))
def ag25_group_signals(spark, root):
    hits = F.explode(F.array(*[F.struct(F.lit(k).alias("signal"), F.expr(v).alias("hit")) for k, v in _SIGNALS.items()])).alias("s")
    return _groups(spark, root).select("n", hits).groupBy("s.signal").agg(F.count_if("s.hit").alias("n_groups"), F.sum(F.when(F.col("s.hit"), F.col("n")).otherwise(0)).alias("n_rows"))


@query(_SIZES + "SELECT CASE WHEN n > 10 THEN 'over 10' WHEN n >= 6 THEN '6 to 10' WHEN n >= 3 THEN '3 to 5' WHEN n = 2 THEN '2' ELSE '1' END AS band, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_rows FROM g GROUP BY 1")
def ag26_size_bands(spark, root):
    band = P.bands(F.col("n"), [("1", 1), ("2", 2), ("3 to 5", 3), ("6 to 10", 6), ("over 10", 11)])
    return P.group_sizes(_prepared(spark, root), "hash").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n_rows"))


@query(" UNION ALL ".join(f"SELECT '{f}' AS field_name, (SELECT count(DISTINCT {f}) FROM prepared) AS n_values, string_agg(v, '; ' ORDER BY n DESC, v) AS top_values FROM (SELECT {f} AS v, count(*) AS n FROM prepared WHERE {f} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 3)" for f in ("product", "company", "state")))
def ag27_top_values(spark, root):
    counts = P.value_counts(_prepared(spark, root), ["product", "company", "state"]).where("value IS NOT NULL")
    ranked = counts.withColumn("i", F.row_number().over(Window.partitionBy("field_name").orderBy(F.desc("n"), "value"))).where("i <= 3")
    top = ranked.groupBy("field_name").agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("t"))
    return counts.groupBy("field_name").agg(F.count(F.lit(1)).alias("n_values")).join(top, "field_name").select("field_name", "n_values", F.array_join("t.value", "; ").alias("top_values"))


@query("SELECT year(date_received) AS year, CAST(date_trunc('month', date_received) AS DATE) AS month, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM prepared WHERE date_received IS NOT NULL GROUP BY ALL")
def ag28_volume_by_month(spark, root):
    m = _prepared(spark, root).where("date_received IS NOT NULL").groupBy(F.year("date_received").cast("long").alias("year"), F.date_trunc("month", "date_received").cast("date").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return m.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("SELECT period, count(l) AS n, round(avg(CAST(l = 0 AS INTEGER)), 6) AS same_day_share, round(quantile_cont(l, 0.5), 6) AS median_days, round(quantile_cont(l, 0.95), 6) AS p95_days, CAST(max(l) AS INTEGER) AS longest, count(*) FILTER (WHERE l < 0) AS n_negative FROM (SELECT period, date_sent_to_company - date_received AS l FROM prepared) WHERE l IS NOT NULL GROUP BY period")
def ag29_lags(spark, root):
    r = _prepared(spark, root).select("period", F.datediff("date_sent_to_company", "date_received").alias("l")).where("l IS NOT NULL")
    return r.groupBy("period").agg(F.count("l").alias("n"), F.round(F.avg((F.col("l") == 0).cast("int")), 6).alias("same_day_share"), F.round(F.percentile("l", F.lit(0.5)), 6).alias("median_days"), F.round(F.percentile("l", F.lit(0.95)), 6).alias("p95_days"), F.max("l").alias("longest"), F.count_if(F.col("l") < 0).alias("n_negative"))


@query("SELECT source, count(*) AS n, " + ", ".join(f"round(quantile_cont(c, {q}), 6) AS chars_p{int(q * 100)}, round(quantile_cont(w, {q}), 6) AS words_p{int(q * 100)}" for q in (0.05, 0.5, 0.95)) + " FROM (SELECT source, length(text) AS c, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) AS w FROM documents WHERE text IS NOT NULL) GROUP BY source")
def ag30_text_lengths(spark, root):
    r = table(spark, root, "documents").where("text IS NOT NULL").select("source", F.length("text").alias("c"), F.regexp_count("text", F.lit(r"[^ \t\n\r\f\x0B]+")).alias("w"))
    ps, out = (0.05, 0.5, 0.95), r.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    for c, name in (("c", "chars"), ("w", "words")):
        q = exact_quantiles(r, ["source"], c, ps).select(F.col("source").alias("_s"), *[F.round(F.col("q")[i], 6).alias(f"{name}_p{int(p * 100)}") for i, p in enumerate(ps)])
        out = out.join(q, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    return out


@query("""SELECT count(*) FILTER (WHERE t IS NULL) AS n_null, count(*) FILTER (WHERE regexp_full_match(t, '\\s*')) AS n_blank, count(*) FILTER (WHERE w < 20) AS n_short, count(*) FILTER (WHERE w > 150) AS n_long, count(*) FILTER (WHERE contains(t, 'XXXX')) AS n_redacted, count(*) FILTER (WHERE contains(t, chr(10))) AS n_lines
FROM (SELECT narrative AS t, len(regexp_extract_all(narrative, '[^ \\t\\n\\r\\f\\v]+')) AS w FROM prepared)""")
def ag31_text_flags(spark, root):
    t, w = F.col("narrative"), F.regexp_count("narrative", F.lit(r"[^ \t\n\r\f\x0B]+"))
    return _prepared(spark, root).agg(F.count_if(t.isNull()).alias("n_null"), F.count_if(t.rlike(r"^\s*$")).alias("n_blank"), F.count_if(w < 20).alias("n_short"), F.count_if(w > 150).alias("n_long"), F.count_if(t.contains("XXXX")).alias("n_redacted"), F.count_if(t.contains("\n")).alias("n_lines"))


_CLASSES = "WITH c AS (SELECT t1, count(*) AS n FROM prepared WHERE t1 IS NOT NULL GROUP BY 1) "


def _classes(spark, root):
    return P.group_sizes(_prepared(spark, root), "t1")


@query(_CLASSES + "SELECT below, count(*) FILTER (WHERE n < below) AS n_classes, CAST(COALESCE(sum(n) FILTER (WHERE n < below), 0) AS BIGINT) AS n_rows FROM c, (VALUES (20), (50), (100)) v(below) GROUP BY below")
def ag32_rare_classes(spark, root):
    below = F.explode(F.array(*[F.lit(x) for x in (20, 50, 100)])).alias("below")
    rare = F.col("n") < F.col("below")
    return _classes(spark, root).select("n", below).groupBy("below").agg(F.count_if(rare).alias("n_classes"), F.sum(F.when(rare, F.col("n")).otherwise(0)).alias("n_rows"))


@query(_CLASSES + ", r AS (SELECT n, row_number() OVER (ORDER BY n DESC, t1) AS i FROM c) SELECT top, CAST(sum(CASE WHEN i <= top THEN n ELSE 0 END) AS BIGINT) AS n_rows, round(100.0 * sum(CASE WHEN i <= top THEN n ELSE 0 END) / sum(n), 6) AS percent FROM r, (VALUES (1), (3), (10), (25), (50)) v(top) GROUP BY top")
def ag33_concentration(spark, root):
    return P.concentration(_classes(spark, root), "n", "t1", [1, 3, 10, 25, 50])


@query("SELECT period, round((count(t2) - count(*) FILTER (WHERE t2)) / CAST(nullif(count(*) FILTER (WHERE t2), 0) AS DOUBLE), 6) AS negatives_per_positive, round(1 - avg(CAST(t2 AS INTEGER)), 6) AS always_negative_accuracy FROM prepared GROUP BY period")
def ag34_imbalance(spark, root):
    pos = F.count_if("t2")
    return _prepared(spark, root).groupBy("period").agg(F.round(F.try_divide(F.count("t2") - pos, pos), 6).alias("negatives_per_positive"), F.round(1 - F.avg(F.col("t2").cast("int")), 6).alias("always_negative_accuracy"))


@query("""WITH h AS (SELECT product_canonical AS g, hash, count(*) AS c FROM prepared WHERE hash IS NOT NULL GROUP BY ALL), s AS (SELECT g, sum(c) AS n, max(c) AS top, count(*) AS u FROM h GROUP BY 1)
SELECT round(sum(u) / CAST(sum(n) AS DOUBLE), 6) AS unique_fraction, CAST(COALESCE(sum(n) FILTER (WHERE top > 0.05 * n), 0) AS BIGINT) AS rows_in_template_groups FROM s""")
def ag35_template_metrics(spark, root):
    h = _prepared(spark, root).where("hash IS NOT NULL").groupBy("product_canonical", "hash").agg(F.count(F.lit(1)).alias("c"))
    s = h.groupBy("product_canonical").agg(F.sum("c").alias("n"), F.max("c").alias("top"), F.count(F.lit(1)).alias("u"))
    return s.agg(F.round(F.sum("u") / F.sum("n"), 6).alias("unique_fraction"), F.coalesce(F.sum(F.when(F.col("top") > 0.05 * F.col("n"), F.col("n"))), F.lit(0)).alias("rows_in_template_groups"))


@query("WITH s AS (SELECT label, count(*) AS n FROM embeddings WHERE label >= 0 GROUP BY 1), a AS (SELECT count(*) AS n_all, count(*) FILTER (WHERE label < 0) AS n_noise FROM embeddings) SELECT count(*) AS n_clusters, round(any_value(n_noise) / CAST(any_value(n_all) AS DOUBLE), 6) AS noise_fraction, round(max(n) / CAST(any_value(n_all) AS DOUBLE), 6) AS largest_fraction, min(n) AS smallest, round(quantile_cont(n, 0.5), 6) AS median_size, max(n) AS largest FROM s, a")
def ag36_structure(spark, root):
    e = table(spark, root, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    own, whole = F.when(F.col("label") >= 0, F.col("n")), F.sum("n")
    return e.agg(F.count(own).alias("n_clusters"), F.round(F.coalesce(F.sum(F.when(F.col("label") < 0, F.col("n"))), F.lit(0)) / whole, 6).alias("noise_fraction"), F.round(F.max(own) / whole, 6).alias("largest_fraction"), F.min(own).alias("smallest"), F.round(F.percentile(own, F.lit(0.5)), 6).alias("median_size"), F.max(own).alias("largest"))


@query("SELECT score_run, CAST(week AS VARCHAR) AS week, round(abs(sum(proportion) - 1), 6) AS off FROM (SELECT DISTINCT score_run, week, cluster_id, proportion FROM weekly_panel WHERE proportion IS NOT NULL) GROUP BY ALL")
def ag38_normalisation(spark, root):
    r = table(spark, root, "weekly_panel").where("proportion IS NOT NULL").select("score_run", "week", "cluster_id", "proportion").distinct()
    return r.groupBy("score_run", F.col("week").cast("string").alias("week")).agg(F.round(F.abs(F.sum("proportion") - 1), 6).alias("off"))


@query("SELECT cluster_id, round(avg(CAST(complaint_count = 0 AS INTEGER)), 6) AS zero_fraction, round(max(proportion), 6) AS max_share, CAST(floor((row_number() OVER (ORDER BY COALESCE(sum(complaint_count), 0) DESC, cluster_id) - 1) * 3 / count(*) OVER ()) AS BIGINT) AS volume_group FROM weekly_panel GROUP BY cluster_id")
def ag39_composition_summary(spark, root):
    g = table(spark, root, "weekly_panel").groupBy("cluster_id").agg(F.round(F.avg((F.col("complaint_count") == 0).cast("int")), 6).alias("zero_fraction"), F.round(F.max("proportion"), 6).alias("max_share"), F.coalesce(F.sum("complaint_count"), F.lit(0)).alias("_n"))
    rank = F.row_number().over(Window.orderBy(F.desc("_n"), "cluster_id"))  # over one row per cluster
    return g.withColumn("volume_group", F.floor((rank - 1) * 3 / F.count(F.lit(1)).over(Window.partitionBy()))).drop("_n")


@query("SELECT sample_split, count(*) AS n_rows, count(DISTINCT complaint_id) AS n_ids, count(t1) AS n_labelled, count(DISTINCT t1) AS n_classes FROM sample_manifest GROUP BY sample_split")
def ag40_sample_contract(spark, root):
    return table(spark, root, "sample_manifest").groupBy("sample_split").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("complaint_id").alias("n_ids"), F.count("t1").alias("n_labelled"), F.count_distinct("t1").alias("n_classes"))


@query("SELECT product, issue FROM (SELECT product, issue, row_number() OVER (PARTITION BY product ORDER BY count(*) DESC, issue) AS i FROM prepared WHERE product IS NOT NULL AND issue IS NOT NULL GROUP BY 1, 2) WHERE i = 1")
def wn11_dominant_value(spark, root):
    return P.dominant(_prepared(spark, root).where("product IS NOT NULL"), ["product"], "issue").select("product", "issue")


@query("SELECT cluster_id, n, CAST(floor((row_number() OVER (ORDER BY n DESC, cluster_id) - 1) * 3 / count(*) OVER ()) AS BIGINT) AS tercile FROM (SELECT cluster_id, CAST(COALESCE(sum(complaint_count), 0) AS BIGINT) AS n FROM daily_panel GROUP BY 1)")
def wn12_terciles(spark, root):
    g = table(spark, root, "daily_panel").groupBy("cluster_id").agg(F.coalesce(F.sum("complaint_count"), F.lit(0)).alias("n"))
    return g.withColumn("tercile", F.floor((F.row_number().over(Window.orderBy(F.desc("n"), "cluster_id")) - 1) * 3 / F.count(F.lit(1)).over(Window.partitionBy())))


_CHANGE = "SELECT product, round(100.0 * count(*) FILTER (WHERE period = 'validation_2025_h1') / (SELECT count(*) FROM prepared WHERE period = 'validation_2025_h1') - 100.0 * count(*) FILTER (WHERE period = 'train_2023_2024') / (SELECT count(*) FROM prepared WHERE period = 'train_2023_2024'), 6) AS change FROM prepared GROUP BY product"


@query(f"SELECT * FROM ({_CHANGE}) ORDER BY abs(change) DESC, product LIMIT 5")
def wn13_share_change(spark, root):
    old, new = F.count_if(F.col("period") == "train_2023_2024"), F.count_if(F.col("period") == "validation_2025_h1")
    per = _prepared(spark, root).groupBy("product").agg(old.alias("a"), new.alias("b"))
    w = Window.partitionBy()
    change = F.round(100 * F.col("b") / F.sum("b").over(w) - 100 * F.col("a") / F.sum("a").over(w), 6)
    return per.select("product", change.alias("change")).orderBy(F.desc(F.abs("change")), F.asc_nulls_last("product")).limit(5)


_COMPANIES = "SELECT DISTINCT company FROM prepared WHERE company IS NOT NULL AND period = '{p}'"


@query(f"SELECT company, 'new' AS change FROM ({_COMPANIES.format(p='validation_2025_h1')} EXCEPT {_COMPANIES.format(p='train_2023_2024')}) UNION ALL SELECT company, 'vanished' FROM ({_COMPANIES.format(p='train_2023_2024')} EXCEPT {_COMPANIES.format(p='validation_2025_h1')})")
def wn14_new_and_vanished(spark, root):
    seen = _prepared(spark, root).where("company IS NOT NULL").groupBy("company").agg(F.max(F.col("period") == "train_2023_2024").alias("a"), F.max(F.col("period") == "validation_2025_h1").alias("b"))
    return seen.where("a <> b").select("company", F.when(F.col("b"), "new").otherwise("vanished").alias("change"))


@query("SELECT hash, count(*) AS n FROM prepared WHERE hash IS NOT NULL GROUP BY 1 ORDER BY n DESC, hash LIMIT 10")
def tk06_largest_groups(spark, root):
    return P.group_sizes(_prepared(spark, root), "hash").orderBy(F.desc("n"), "hash").limit(10)


_ORDER = "(embedding_row * 2654435761 + {seed}) % 4294967296"


@query(f"SELECT DISTINCT embedding_row FROM fit_embeddings ORDER BY {_ORDER.format(seed=7)}, embedding_row LIMIT 50")
def tk08_seeded_sample(spark, root):
    return table(spark, root, "fit_embeddings").select("embedding_row").distinct().orderBy(P.hash_order(F.col("embedding_row"), 7), "embedding_row").limit(50)


@query(f"""WITH r AS (SELECT DISTINCT embedding_row, t1, {_ORDER.format(seed=9)} AS o FROM sample_manifest WHERE embedding_row IS NOT NULL AND t1 IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY t1 ORDER BY o, embedding_row) AS i FROM r) SELECT embedding_row, t1 FROM (SELECT * FROM o WHERE i = 1 UNION ALL SELECT * FROM (SELECT * FROM o WHERE i > 1 ORDER BY o, embedding_row LIMIT 60))""")
def tk09_stratified_sample(spark, root):
    r = table(spark, root, "sample_manifest").where("embedding_row IS NOT NULL AND t1 IS NOT NULL").select("embedding_row", "t1").distinct().withColumn("o", P.hash_order(F.col("embedding_row"), 9))
    first = r.groupBy("t1").agg(F.min(F.struct("o", "embedding_row")).alias("f")).select(F.col("f.embedding_row").alias("embedding_row"), "t1")
    rest = r.join(first, ["embedding_row", "t1"], "left_anti").orderBy("o", "embedding_row").limit(60).select("embedding_row", "t1")
    return first.unionByName(rest)


@query(f"SELECT embedding_row, product_canonical FROM (SELECT DISTINCT embedding_row, product_canonical FROM sample_manifest WHERE embedding_row IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY product_canonical ORDER BY {_ORDER.format(seed=3)}, embedding_row) <= 5")
def tk10_sample_per_group(spark, root):
    r = table(spark, root, "sample_manifest").where("embedding_row IS NOT NULL").select("embedding_row", "product_canonical").distinct()
    w = Window.partitionBy("product_canonical").orderBy(P.hash_order(F.col("embedding_row"), 3), "embedding_row")
    return r.withColumn("i", F.row_number().over(w)).where("i <= 5").drop("i")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i FROM documents) WHERE (i - 1) % 25 = 0")
def tk11_systematic_sample(spark, root):
    # Ranks from range-partitioned ids: counts per range partition, then the place inside it; no window over all rows.
    parts = table(spark, root, "documents").select("doc_id").repartitionByRange(16, "doc_id").sortWithinPartitions("doc_id").withColumn("p", F.spark_partition_id())
    before = parts.groupBy("p").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("p")) - F.col("n"))
    ranked = parts.withColumn("i", F.row_number().over(Window.partitionBy("p").orderBy("doc_id"))).join(F.broadcast(before), "p")
    return ranked.where((F.col("before") + F.col("i") - 1) % 25 == 0).select("doc_id")


@query("SELECT period, count(*) AS n FROM (SELECT complaint_id, period FROM prepared WHERE period = 'train_2023_2024' UNION ALL SELECT complaint_id, period FROM prepared WHERE period = 'validation_2025_h1') GROUP BY period")
def so01_union(spark, root):
    p = _prepared(spark, root).select("complaint_id", "period")
    return p.where("period = 'train_2023_2024'").unionByName(p.where("period = 'validation_2025_h1'")).groupBy("period").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT a.complaint_id, a.n AS n_rows, b.n_chars FROM (SELECT complaint_id, count(*) AS n FROM prepared GROUP BY 1) a JOIN (SELECT complaint_id, max(length(narrative)) AS n_chars FROM prepared GROUP BY 1) b USING (complaint_id)")
def so02_columns_joined(spark, root):
    p = _prepared(spark, root)
    return p.groupBy("complaint_id").agg(F.count(F.lit(1)).alias("n_rows")).join(p.groupBy("complaint_id").agg(F.max(F.length("narrative")).alias("n_chars")), "complaint_id")


@query("SELECT t1 FROM prepared WHERE period <> 'train_2023_2024' AND t1 IS NOT NULL EXCEPT SELECT t1 FROM prepared WHERE period = 'train_2023_2024'")
def so03_difference(spark, root):
    p = _prepared(spark, root)
    return p.where("period <> 'train_2023_2024' AND t1 IS NOT NULL").select("t1").subtract(p.where("period = 'train_2023_2024'").select("t1"))


@query("SELECT complaint_id, product FROM prepared QUALIFY row_number() OVER (PARTITION BY complaint_id ORDER BY loaded_at) = 1")
def so04_first_rows(spark, root):
    return _prepared(spark, root).groupBy("complaint_id").agg(F.min_by("product", "loaded_at").alias("product"))


@query("SELECT company FROM prepared WHERE period = 'train_2023_2024' INTERSECT SELECT company FROM prepared WHERE period = 'ood_2026_partial'")
def so05_intersection(spark, root):
    p = _prepared(spark, root)
    return p.where("period = 'train_2023_2024'").select("company").intersect(p.where("period = 'ood_2026_partial'").select("company"))
