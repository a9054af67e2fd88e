"""Queries of metrics, vectors, special functions and text features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import special as X
from tidemark.functions import text as T
from tidemark.operators import metrics as M
from tidemark.operators import profile as P
from tidemark.operators import vectors as V
from tidemark.operators.lookups import small
from tidemark.operators.quantiles import exact_quantiles
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


def _prepared(spark, root):
    return table(spark, root, "prepared")


# Rankings and baselines: the rule predicts a product's most frequent class in the training period.
_RANKS = """WITH fit AS (SELECT product_canonical AS g, t1 FROM prepared WHERE period = 'train_2023_2024' AND t1 IS NOT NULL),
g AS (SELECT t1, row_number() OVER (ORDER BY count(*) DESC, t1) AS i FROM fit GROUP BY 1 ORDER BY 2 LIMIT 3),
o AS (SELECT g, t1, row_number() OVER (PARTITION BY g ORDER BY count(*) DESC, t1) AS i FROM fit WHERE g IS NOT NULL GROUP BY 1, 2),
u AS (SELECT g, t1, i FROM o WHERE i <= 3 UNION ALL SELECT p.g, g.t1, g.i + 3 FROM (SELECT DISTINCT g FROM o) p, g),
top AS (SELECT g, t1, CAST(row_number() OVER (PARTITION BY g ORDER BY min(i)) AS INTEGER) AS place FROM u GROUP BY g, t1 QUALIFY row_number() OVER (PARTITION BY g ORDER BY min(i)) <= 3)
"""


def _ranks(spark, root):
    fit = _prepared(spark, root).where("period = 'train_2023_2024' AND t1 IS NOT NULL").select(F.col("product_canonical").alias("g"), "t1")
    counts = fit.groupBy("g", "t1").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.groupBy("t1").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "t1").limit(3)
    whole = whole.select("t1", (F.row_number().over(Window.orderBy(F.desc("n"), "t1")) + 3).alias("i"))
    own = counts.where("g IS NOT NULL").withColumn("i", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("n"), "t1"))).where("i <= 3")
    both = own.select("g", "t1", "i").unionByName(own.select("g").distinct().join(F.broadcast(whole)).select("g", "t1", "i"))
    best = both.groupBy("g", "t1").agg(F.min("i").alias("i"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy("i"))).where("place <= 3").select("g", "t1", "place")


@query(_RANKS + "SELECT * FROM top")
def tk01_top_three(spark, root):
    return _ranks(spark, root)


_PREDICTED = _RANKS + ", pred AS (SELECT p.complaint_id, p.t1, top.t1 AS predicted FROM prepared p LEFT JOIN top ON p.product_canonical = top.g AND place = 1 WHERE p.period = 'validation_2025_h1')\n"


def _predicted(spark, root):
    top = _ranks(spark, root).where("place = 1").select(F.col("g").alias("product_canonical"), F.col("t1").alias("predicted"))
    return _prepared(spark, root).where("period = 'validation_2025_h1'").select("complaint_id", "t1", "product_canonical").join(top, "product_canonical", "left").select("complaint_id", "t1", "predicted")


_CLASS = """, s AS (SELECT label, CAST(sum(s) AS BIGINT) AS support, sum(q) AS q, sum(h) AS h FROM (SELECT t1 AS label, 1 AS s, 0 AS q, CASE WHEN t1 = predicted THEN 1 ELSE 0 END AS h FROM pred WHERE t1 IS NOT NULL UNION ALL SELECT predicted, 0, 1, 0 FROM pred WHERE t1 IS NOT NULL AND predicted IS NOT NULL) GROUP BY 1 HAVING sum(s) > 0)
"""


@query(_PREDICTED + _CLASS + "SELECT label, support, round(COALESCE(h / nullif(q, 0), 0), 6) AS precision, round(h / support, 6) AS recall, round(2.0 * h / (q + support), 6) AS f1 FROM s")
def mt01_class_scores(spark, root):
    return M.class_scores(_predicted(spark, root), "t1", "predicted").drop("_f1")


@query(_PREDICTED + _CLASS + "SELECT count(*) AS n_labels, round(avg(2.0 * h / (q + support)), 6) AS macro_f1 FROM s")
def mt01_macro_f1(spark, root):
    return M.macro_f1(M.class_scores(_predicted(spark, root), "t1", "predicted"))


@query(_PREDICTED.replace("p.t1, top.t1 AS predicted", "p.t1, top.t1 AS predicted, 1 + CAST(right(p.complaint_id, 1) AS INTEGER) AS w") + """, s AS (SELECT label, sum(s) AS support, sum(q) AS q, sum(h) AS h FROM (SELECT t1 AS label, w AS s, 0 AS q, CASE WHEN t1 = predicted THEN w ELSE 0 END AS h FROM pred WHERE t1 IS NOT NULL UNION ALL SELECT predicted, 0, w, 0 FROM pred WHERE t1 IS NOT NULL AND predicted IS NOT NULL) GROUP BY 1 HAVING sum(s) > 0)
SELECT count(*) AS n_labels, round(avg(2.0 * h / (q + support)), 6) AS macro_f1 FROM s""")
def mt02_weighted_macro_f1(spark, root):
    weighted = _predicted(spark, root).withColumn("w", 1 + F.right("complaint_id", F.lit(1)).cast("int"))
    return M.macro_f1(M.class_scores(weighted, "t1", "predicted", "w"))


@query(_RANKS + "SELECT round(avg(CAST(EXISTS (SELECT 1 FROM top WHERE top.g = p.product_canonical AND top.t1 = p.t1) AS INTEGER)), 6) AS top_three_accuracy, count(*) AS n FROM prepared p WHERE period = 'validation_2025_h1' AND t1 IS NOT NULL")
def mt06_top_three_accuracy(spark, root):
    top = _ranks(spark, root).groupBy(F.col("g").alias("product_canonical")).agg(F.collect_set("t1").alias("best"))
    rows = _prepared(spark, root).where("period = 'validation_2025_h1' AND t1 IS NOT NULL").select("t1", "product_canonical").join(top, "product_canonical", "left")
    hit = F.coalesce(F.array_contains("best", F.col("t1")), F.lit(False)).cast("int")
    return rows.agg(F.round(F.avg(hit), 6).alias("top_three_accuracy"), F.count(F.lit(1)).alias("n"))


_SCORED = """WITH r AS (SELECT product_canonical AS g, avg(CAST(t2 AS INTEGER)) AS s FROM prepared WHERE period = 'train_2023_2024' GROUP BY 1), q AS (SELECT p.period, p.t2, round(r.s, 9) AS s FROM prepared p JOIN r ON p.product_canonical = r.g WHERE p.t2 IS NOT NULL AND r.s IS NOT NULL),
per AS (SELECT period, s, count(*) AS n, count(*) FILTER (WHERE t2) AS pos FROM q GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp, sum(pos) OVER (PARTITION BY period) AS ap FROM per WINDOW w AS (PARTITION BY period ORDER BY s DESC ROWS UNBOUNDED PRECEDING))
"""


def _scored(spark, root):
    p = _prepared(spark, root)
    r = p.where("period = 'train_2023_2024'").groupBy("product_canonical").agg(F.round(F.avg(F.col("t2").cast("int")), 9).alias("s")).where("s IS NOT NULL")
    return p.where("t2 IS NOT NULL").select("period", "t2", "product_canonical").join(r, "product_canonical")


@query(_SCORED + "SELECT period, CAST(sum(n) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS n_positive, round(sum(CAST(pos AS DOUBLE) * cp / nullif(ap * cn, 0)), 6) AS average_precision FROM cum GROUP BY period")
def mt03_average_precision(spark, root):
    return M.average_precision(_scored(spark, root), "s", "t2", ["period"])


@query(_SCORED + "SELECT period, round(COALESCE(count(*) FILTER (WHERE s >= 0.25 AND t2) / nullif(CAST(count(*) FILTER (WHERE s >= 0.25) AS DOUBLE), 0), 0), 6) AS precision, round(COALESCE(count(*) FILTER (WHERE s >= 0.25 AND t2) / nullif(CAST(count(*) FILTER (WHERE t2) AS DOUBLE), 0), 0), 6) AS recall, round(COALESCE(2.0 * count(*) FILTER (WHERE s >= 0.25 AND t2) / nullif(count(*) FILTER (WHERE s >= 0.25) + count(*) FILTER (WHERE t2), 0), 0), 6) AS f1, round(avg(pow(s - CAST(t2 AS INTEGER), 2)), 6) AS brier FROM q GROUP BY period")
def mt04_at_threshold(spark, root):
    return M.at_threshold(_scored(spark, root), "s", "t2", 0.25, ["period"])


@query(_SCORED + "SELECT period, round(f1, 6) AS f1, round(threshold, 6) AS threshold FROM (SELECT period, round(2.0 * cp / (cn + ap), 9) AS f1, s AS threshold FROM cum) QUALIFY row_number() OVER (PARTITION BY period ORDER BY f1 DESC, threshold DESC) = 1")
def mt05_best_threshold(spark, root):
    return M.best_threshold(_scored(spark, root), "s", "t2", ["period"])


# Interval scores: Poisson-like normal intervals around the rolling expectation of the weekly panel.
_Z = {0.5: 0.674490, 0.2: 1.281552, 0.05: 1.959964}


def _intervals(spark, root):
    rows = W._scored(spark, root).where("expected IS NOT NULL")
    sd = F.sqrt(F.col("expected"))
    bounds = {a: (F.greatest(F.col("expected") - z * sd, F.lit(0.0)), F.col("expected") + z * sd) for a, z in _Z.items()}
    return rows.withColumn("wis", M.weighted_interval_score(F.col("n"), F.col("expected"), bounds)).withColumn("baseline", 0.5 * F.abs(F.col("n") - F.col("expected")) / 0.5)


_WIS = W.WK + W._Z_SQL + ", i AS (SELECT *, (0.5 * abs(n - expected) + " + " + ".join(f"{a} / 2 * ((expected + {z} * sqrt(expected)) - greatest(expected - {z} * sqrt(expected), 0) + 2 / {a} * (greatest(greatest(expected - {z} * sqrt(expected), 0) - n, 0) + greatest(n - (expected + {z} * sqrt(expected)), 0)))" for a, z in _Z.items()) + ") / 3.5 AS wis, abs(n - expected) AS baseline FROM scored WHERE expected IS NOT NULL)\n"


@query(_WIS + "SELECT score_run, cluster_id, period, round(wis, 6) AS wis FROM i")
def mt07_interval_score(spark, root):
    return _intervals(spark, root).select("score_run", "cluster_id", "period", F.round("wis", 6).alias("wis"))


@query(_WIS + "SELECT score_run, round(avg(wis), 6) AS wis, round(avg(abs(n - expected)), 6) AS mae, round(sqrt(avg(pow(n - expected, 2))), 6) AS rmse, round(sum(abs(n - expected)) / sum(n), 6) AS wape, round((sum(expected) - sum(n)) / sum(n), 6) AS bias, round(avg(CAST(abs(n - expected) <= 1.281552 * sqrt(expected) AS INTEGER)), 6) AS coverage_80 FROM i GROUP BY score_run")
def mt08_predictive_metrics(spark, root):
    e = F.col("n") - F.col("expected")
    return _intervals(spark, root).groupBy("score_run").agg(F.round(F.avg("wis"), 6).alias("wis"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.round(F.sum(F.abs(e)) / F.sum("n"), 6).alias("wape"), F.round((F.sum("expected") - F.sum("n")) / F.sum("n"), 6).alias("bias"), F.round(F.avg((F.abs(e) <= 1.281552 * F.sqrt("expected")).cast("int")), 6).alias("coverage_80"))


@query(_WIS + "SELECT score_run, round(1 - avg(wis) / avg(baseline), 6) AS skill FROM i GROUP BY score_run")
def mt09_skill(spark, root):
    return _intervals(spark, root).groupBy("score_run").agg(F.round(1 - F.avg("wis") / F.avg("baseline"), 6).alias("skill"))


@query(_WIS + """, s AS (SELECT period, avg(wis) AS a, avg(baseline) AS b FROM i GROUP BY 1), r AS (SELECT row_number() OVER (ORDER BY period) AS i, a, b FROM s), k AS (SELECT count(*) AS n FROM r),
p AS (SELECT d.draw, CAST(floor(((d.draw * 7919 + l.place * 104729 + 5) * 2654435761) % 4294967296 / 65536) AS BIGINT) % k.n + 1 AS i FROM (SELECT unnest(range(500)) AS draw) d, k, LATERAL (SELECT unnest(range(1, k.n + 1)) AS place) l),
dd AS (SELECT draw, avg(a - b) AS d FROM p JOIN r USING (i) GROUP BY draw) SELECT round(quantile_cont(d, 0.025), 6) AS p025, round(quantile_cont(d, 0.5), 6) AS p50, round(quantile_cont(d, 0.975), 6) AS p975 FROM dd""")
def mt10_paired_resampling(spark, root):
    sums = _intervals(spark, root).groupBy("period").agg(F.avg("wis").alias("a"), F.avg("baseline").alias("b"))
    return M.paired_resampling(sums, "period", "a", "b", 500, 5)


@query(W.WK + ", s AS (SELECT score_run, period, cluster_id, n / nullif(sum(n) OVER (PARTITION BY score_run, period), 0) AS share FROM wk), l AS (SELECT *, lag(share) OVER (PARTITION BY score_run, cluster_id ORDER BY period) AS old FROM s) SELECT score_run, period, round(0.5 * sum(abs(share - old)), 6) AS total_variation FROM l GROUP BY ALL")
def mt14_total_variation(spark, root):
    s = W.weekly(spark, root).withColumn("share", F.expr("try_divide(n, sum(n) OVER (PARTITION BY score_run, period))"))
    s = s.withColumn("old", F.lag("share").over(Window.partitionBy("score_run", "cluster_id").orderBy("period")))
    return s.groupBy("score_run", "period").agg(F.round(0.5 * F.sum(F.abs(F.col("share") - F.col("old"))), 6).alias("total_variation"))


@query(W.WK + ", e AS (SELECT k.keep, w.score_run, w.cluster_id, w.period, w.n, (SELECT sum(pow(k.keep, (w.period - p.period) // 7 - 1) * p.n) FROM wk p WHERE p.score_run = w.score_run AND p.cluster_id = w.cluster_id AND p.period < w.period) AS m FROM wk w, (VALUES (0.7), (0.9), (0.98)) k(keep)), s AS (SELECT *, (m + 1) / (sum(m) OVER p + count(*) OVER p) * sum(n) OVER p AS expected FROM e WHERE m IS NOT NULL WINDOW p AS (PARTITION BY keep, score_run, period)) SELECT CAST(keep AS DOUBLE) AS keep, round(avg(abs(n - expected)), 6) AS mae FROM s GROUP BY keep")
def mt13_memory_grid(spark, root):
    from tidemark.operators.series import decayed_shares

    run = W.weekly(spark, root)
    out = None
    for keep in (0.7, 0.9, 0.98):
        d = decayed_shares(run, keep).withColumn("expected", F.col("memory_share") * F.sum("n").over(Window.partitionBy("score_run", "period"))).where("memory_share IS NOT NULL")
        one = d.agg(F.lit(keep).alias("keep"), F.round(F.avg(F.abs(F.col("n") - F.col("expected"))), 6).alias("mae"))
        out = one if out is None else out.unionByName(one)
    return out


@query("WITH f AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT arg_min(label, {'n': -n, 'l': label}) AS best, arg_min(label, {'n': n, 'l': label}) AS worst FROM f")
def tk14_extremes(spark, root):
    f = table(spark, root, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return f.agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("best"), F.min_by("label", F.struct("n", "label")).alias("worst"))


# Vectors: exact search over the small embeddings table, clusters by label.
_DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: CAST(x[1] AS DOUBLE) * x[2]))"
_QUERY_IDS = "vec_id % 20 = 0"


@query(f"SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round({_DOT}, 5) AS similarity, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_DOT}, 7) DESC, b.vec_id) AS INTEGER) AS place FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.{_QUERY_IDS} QUALIFY place <= 5")
def tk04_nearest(spark, root):
    return V.nearest(table(spark, root, "embeddings"), table(spark, root, "embeddings").where(_QUERY_IDS), 5).withColumn("similarity", F.round("similarity", 5))


_CENTRES = "WITH c AS (SELECT label, list(v ORDER BY i) AS centre FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS v FROM embeddings, range(1, 65) r(i) GROUP BY ALL) GROUP BY label),\nd AS (SELECT e.vec_id, e.label, c.label AS part, sqrt(list_sum(list_transform(list_zip(e.embedding, c.centre), lambda x: pow(x[1] - x[2], 2)))) AS distance FROM embeddings e, c),\na AS (SELECT vec_id, label, arg_min(part, {'d': round(distance, 9), 'p': part}) AS part, min(distance) AS distance FROM d GROUP BY ALL)\n"


def _assigned(spark, root):
    e = table(spark, root, "embeddings")
    return V.assign(e, V.centres(e, "label"))


@query(_CENTRES + "SELECT vec_id, label, part, round(distance, 5) AS distance FROM a")
def ml07_assigned(spark, root):
    return _assigned(spark, root).select("vec_id", "label", "part", F.round("distance", 5).alias("distance"))


@query(_CENTRES + ", t AS (SELECT part, quantile_cont(distance, 0.95) AS p95 FROM a GROUP BY 1) SELECT vec_id, a.part, distance > p95 AS is_novel FROM a JOIN t USING (part)")
def ml09_novelty(spark, root):
    a = _assigned(spark, root)
    limit = exact_quantiles(a, ["part"], "distance", [0.95]).select("part", F.col("q")[0].alias("p95"))
    return a.join(small(limit), "part").select("vec_id", "part", (F.col("distance") > F.col("p95")).alias("is_novel"))


_NEAR = f"WITH k AS (SELECT a.vec_id AS q, a.label AS ql, b.label AS bl, {_DOT} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_DOT}, 7) DESC, b.vec_id) AS i FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.{_QUERY_IDS} QUALIFY i <= 5)\n"


def _near(spark, root):
    e = table(spark, root, "embeddings")
    near = V.nearest(e, e.where(_QUERY_IDS), 5)
    return near.join(e.select("vec_id", F.col("label").alias("bl")), "vec_id").join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id")


@query(_NEAR + "SELECT q AS query_id, bl AS vote FROM (SELECT q, bl, sum(s) + 1e-9 * max(CAST(i = 1 AS INTEGER)) AS v FROM k GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(v, 9) DESC, bl) = 1")
def ml10_vote(spark, root):
    v = _near(spark, root).groupBy("query_id", "bl").agg(F.round(F.sum("similarity") + 1e-9 * F.max((F.col("place") == 1).cast("int")), 9).alias("v"))
    return v.groupBy("query_id").agg(F.min_by("bl", F.struct(-F.col("v"), F.col("bl"))).alias("vote"))


@query(_NEAR + ", p AS (SELECT sum(pow(n / CAST(t AS DOUBLE), 2)) AS chance FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS t FROM embeddings GROUP BY label)) SELECT round(quantile_cont(s, 0.01) FILTER (WHERE i = 1), 5) AS q01_top, round(avg(CAST(ql = bl AS INTEGER)), 6) AS same_label, round((SELECT chance FROM p), 6) AS chance, round(avg(CAST(ql = bl AS INTEGER)) / (SELECT chance FROM p), 6) AS lift FROM k")
def ml14_neighbour_lift(spark, root):
    n = table(spark, root, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    chance = n.agg((F.sum(F.col("n") * F.col("n")) / F.pow(F.sum("n"), F.lit(2))).alias("chance"))
    near = _near(spark, root)
    q01 = exact_quantiles(near.where("place = 1"), [], "similarity", [0.01]).select(F.col("q")[0].alias("q"))
    same = near.agg(F.avg((F.col("ql") == F.col("bl")).cast("int")).alias("same"))
    return same.join(F.broadcast(q01)).join(F.broadcast(chance)).select(F.round("q", 5).alias("q01_top"), F.round("same", 6).alias("same_label"), F.round("chance", 6).alias("chance"), F.round(F.col("same") / F.col("chance"), 6).alias("lift"))


@query(_CENTRES + ", g AS (SELECT part, label, count(*) AS n FROM a GROUP BY ALL), s AS (SELECT sum(n * (n - 1) / 2) AS same, sum(n) AS n FROM g), x AS (SELECT sum(m * (m - 1) / 2) AS x FROM (SELECT sum(n) AS m FROM g GROUP BY part)), y AS (SELECT sum(m * (m - 1) / 2) AS y FROM (SELECT sum(n) AS m FROM g GROUP BY label)) SELECT CAST(n AS BIGINT) AS n, round((same - x * y / (n * (n - 1) / 2)) / ((x + y) / 2 - x * y / (n * (n - 1) / 2)), 6) AS adjusted_rand FROM s, x, y")
def ml15_adjusted_rand(spark, root):
    return M.rand_index(_assigned(spark, root), "part", "label")


@query("WITH g AS (SELECT product_canonical AS a, t1 AS b, count(*) AS n FROM prepared WHERE product_canonical IS NOT NULL AND t1 IS NOT NULL GROUP BY ALL), w AS (SELECT CAST(n AS DOUBLE) AS n, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t FROM g) SELECT round(sum(n / t * ln(n * t / (na * nb))) * 2 / (-sum(n / t * ln(na / t)) - sum(n / t * ln(nb / t))), 6) AS nmi FROM w")
def ml16_mutual_information(spark, root):
    return M.mutual_information(_prepared(spark, root), "product_canonical", "t1")


@query("WITH d AS (SELECT a.vec_id, a.label AS own, b.label AS other, avg(sqrt(greatest(0, 2 - 2 * " + _DOT + "))) AS m FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY ALL), s AS (SELECT vec_id, own, max(CASE WHEN other = own THEN m END) AS a, min(CASE WHEN other <> own THEN m END) AS b FROM d GROUP BY ALL) SELECT own AS label, round(avg((b - a) / greatest(a, b)), 4) AS silhouette, count(*) AS n FROM s GROUP BY own")
def ml13_silhouette(spark, root):
    return V.silhouette(table(spark, root, "embeddings"), "label").withColumn("silhouette", F.round("silhouette", 4))


@query(_CENTRES + "SELECT vec_id, round((d2 - d1) / d1, 4) AS margin FROM (SELECT vec_id, min(distance) AS d1, (list_sort(list(distance)))[2] AS d2 FROM d GROUP BY 1)")
def ml19_margins(spark, root):
    e = table(spark, root, "embeddings")
    return V.margins(e, V.centres(e, "label")).select("vec_id", F.round("margin", 4).alias("margin"))


@query(_CENTRES + "SELECT part, vec_id, CAST(row_number() OVER (PARTITION BY part ORDER BY round(distance, 7), vec_id) AS INTEGER) AS place FROM a QUALIFY place <= 3")
def tk05_examples(spark, root):
    w = Window.partitionBy("part").orderBy(F.round("distance", 7), "vec_id")
    return _assigned(spark, root).withColumn("place", F.row_number().over(w)).where("place <= 3").select("part", "vec_id", "place")


# Special functions: negative-binomial scores of weekly counts around the rolling expectation.
_LG = "(lgamma(i + 8.0) - lgamma(8.0) - lgamma(i + 1) + 8.0 * ln(8.0 / (8.0 + expected)) + i * ln(expected / (8.0 + expected)))"


@query(W.WK + W._Z_SQL + f" SELECT score_run, cluster_id, period, round((SELECT sum(exp({_LG})) FROM range(n + 1) r(i)), 5) AS cdf FROM scored WHERE expected > 0")
def st05_nb_cdf(spark, root):
    rows = W._scored(spark, root).where("expected > 0")
    return rows.select("score_run", "cluster_id", "period", F.round(X.nb_cdf_udf(F.col("n").cast("double"), F.lit(8.0), F.col("expected")), 5).alias("cdf"))


@query(None)
def st06_normal_scores(spark, root):
    rows = W._scored(spark, root).where("expected > 0")
    return rows.select("score_run", "cluster_id", "period", F.round(X.mid_z_udf(F.col("n").cast("double"), F.lit(8.0), F.col("expected")), 5).alias("z"))


@query(W.WK + W._Z_SQL + f" SELECT score_run, cluster_id, period, (SELECT min(i) FROM (SELECT i, sum(exp({_LG})) OVER (ORDER BY i) AS c FROM range(2000) r(i)) WHERE c >= 0.9) AS p90 FROM scored WHERE expected > 0")
def st14_nb_quantile(spark, root):
    rows = W._scored(spark, root).where("expected > 0")
    return rows.select("score_run", "cluster_id", "period", X.nb_quantile_udf(0.9)(F.lit(8.0), F.col("expected")).cast("long").alias("p90"))


@query(W.WK + ", s AS (SELECT *, sum(n) OVER p AS total, lag(n, 1, 0) OVER (PARTITION BY score_run, cluster_id ORDER BY period) + 1 AS a FROM wk WINDOW p AS (PARTITION BY score_run, period)) SELECT score_run, period, round(lgamma(sum(a)) + lgamma(any_value(total) + 1) - lgamma(any_value(total) + sum(a)) + sum(lgamma(n + a) - lgamma(a) - lgamma(n + 1)), 5) AS log_pmf FROM s GROUP BY ALL")
def st17_dirichlet_multinomial(spark, root):
    rows = W.weekly(spark, root).withColumn("a", (F.lag("n", 1, 0).over(Window.partitionBy("score_run", "cluster_id").orderBy("period")) + 1).cast("double"))
    lg = X.lgamma_udf
    rows = rows.withColumn("part", lg(F.col("n") + F.col("a")) - lg(F.col("a")) - lg(F.col("n") + F.lit(1.0)))
    per = rows.groupBy("score_run", "period").agg(F.sum("a").alias("a"), F.sum("n").alias("n"), F.sum("part").alias("part"))
    return per.select("score_run", "period", F.round(lg(F.col("a")) + lg(F.col("n") + F.lit(1.0)) - lg(F.col("n") + F.col("a")) + F.col("part"), 5).alias("log_pmf"))


@query(W.WK + """, k AS (SELECT i, exp(i * 0.1) AS kappa FROM range(61) r(i)), f AS (SELECT score_run, cluster_id, (sum(n) + 1.0) / (sum(sum(n)) OVER (PARTITION BY score_run) + count(*) OVER (PARTITION BY score_run)) AS share FROM wk GROUP BY score_run, cluster_id),
l AS (SELECT wk.score_run, i, kappa, period, lgamma(kappa) - lgamma(sum(n) + kappa) + sum(lgamma(n + kappa * share) - lgamma(kappa * share)) AS v FROM wk JOIN f ON wk.score_run = f.score_run AND wk.cluster_id = f.cluster_id, k GROUP BY wk.score_run, i, kappa, period),
p AS (SELECT score_run, i, kappa, sum(v) AS v FROM l GROUP BY score_run, i, kappa), e AS (SELECT *, exp(v - max(v) OVER (PARTITION BY score_run)) AS e FROM p)
SELECT score_run, i, round(kappa, 6) AS kappa, round(e / sum(e) OVER (PARTITION BY score_run), 6) AS weight FROM e""")
def st22_grid_posterior(spark, root):
    runs, lg = W.weekly(spark, root), X.lgamma_udf
    whole = Window.partitionBy("score_run")
    share = runs.groupBy("score_run", "cluster_id").agg(F.sum("n").alias("c")).withColumn("share", (F.col("c") + 1.0) / (F.sum("c").over(whole) + F.count(F.lit(1)).over(whole))).select("score_run", "cluster_id", "share")
    points = F.explode(F.sequence(F.lit(0), F.lit(60))).alias("i")
    rows = runs.join(share, ["score_run", "cluster_id"]).select("score_run", "period", "n", "share", points).withColumn("kappa", F.exp(F.col("i") * 0.1))
    rows = rows.withColumn("v", lg(F.col("n") + F.col("kappa") * F.col("share")) - lg(F.col("kappa") * F.col("share")))
    per = rows.groupBy("score_run", "i", "kappa", "period").agg(F.sum("v").alias("v"), F.sum("n").cast("double").alias("t")).withColumn("v", F.col("v") + lg(F.col("kappa")) - lg(F.col("t") + F.col("kappa")))
    post = per.groupBy("score_run", "i", "kappa").agg(F.sum("v").alias("v")).withColumn("e", F.exp(F.col("v") - F.max("v").over(whole)))
    return post.select("score_run", F.col("i").cast("long").alias("i"), F.round("kappa", 6).alias("kappa"), F.round(F.col("e") / F.sum("e").over(whole), 6).alias("weight"))


# Text.
_NORMAL = "trim(regexp_replace(regexp_replace(lower(narrative), '\\bx{2,}\\b', '<redacted>', 'g'), '[\\s\\x{A0}]+', ' ', 'g'))"


@query(f"SELECT complaint_id, epoch_us(loaded_at) AS loaded_us, sha256({_NORMAL}) AS text_hash FROM prepared WHERE narrative IS NOT NULL")
def sc01_normalised_native(spark, root):
    rows = _prepared(spark, root).where("narrative IS NOT NULL")
    return rows.select("complaint_id", F.unix_micros("loaded_at").alias("loaded_us"), F.sha2(T.normalised_native(F.col("narrative")), 256).alias("text_hash"))


@query("SELECT complaint_id, epoch_us(loaded_at) AS loaded_us, hash AS text_hash FROM prepared WHERE narrative IS NOT NULL AND hash IS NOT NULL")
def sc02_text_hash(spark, root):
    rows = _prepared(spark, root).where("narrative IS NOT NULL AND hash IS NOT NULL")
    return rows.select("complaint_id", F.unix_micros("loaded_at").alias("loaded_us"), F.sha2(T.normalised_udf("narrative"), 256).alias("text_hash"))


_MARKERS = {"en": ["the", "and", "was", "that", "with"], "es": ["el", "que", "los", "una", "por"]}


@query("SELECT doc_id, CASE WHEN en >= 5 AND en >= 2 * es THEN 'en' WHEN es >= 5 AND es >= 2 * en THEN 'es' ELSE 'unsure' END AS hint FROM (SELECT doc_id, " + ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(m) for m in ms)}))) AS {k}" for k, ms in _MARKERS.items()) + " FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[^a-zà-ÿ]+') AS w FROM documents WHERE text IS NOT NULL))")
def sc04_language_hint(spark, root):
    w = F.split(F.lower("text"), "[^a-zà-ÿ]+")

    def said(marks):
        return F.size(F.filter(w, lambda x: x.isin(*marks)))

    n = {k: said(marks) for k, marks in _MARKERS.items()}
    hint = F.when((n["en"] >= 5) & (n["en"] >= 2 * n["es"]), "en").when((n["es"] >= 5) & (n["es"] >= 2 * n["en"]), "es").otherwise("unsure")
    return table(spark, root, "documents").where("text IS NOT NULL").select("doc_id", hint.alias("hint"))


@query("SELECT doc_id, CASE WHEN length(t) > 60 THEN concat(substr(t, 1, 59), '…') ELSE t END AS snippet FROM (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL)")
def sc05_snippet(spark, root):
    return table(spark, root, "documents").where("text IS NOT NULL").select("doc_id", P.snippet(F.col("text"), 60).alias("snippet"))


@query("SELECT cluster_id, array_to_string(list_filter(string_split(representative_terms, ', '), lambda t: NOT regexp_full_match(t, '[0-9 ]+') AND NOT contains(t, 'xx'))[1:3], '; ') AS terms FROM cluster_summary")
def sc06_clean_terms(spark, root):
    terms = F.filter(F.split("representative_terms", ", "), lambda t: ~t.rlike("^[0-9 ]+$") & ~t.contains("xx"))
    return table(spark, root, "cluster_summary").select("cluster_id", F.array_join(F.slice(terms, 1, 3), "; ").alias("terms"))


@query("SELECT complaint_id, epoch_us(loaded_at) AS loaded_us, date_trunc('week', date_received)::DATE AS week_start, CAST(isodow(date_received) - 1 AS INTEGER) AS day_of_week, CAST(date_trunc('month', date_received) AS DATE) AS month, CAST(date_sent_to_company - date_received AS INTEGER) AS days FROM prepared")
def sc08_date_parts(spark, root):
    return _prepared(spark, root).select("complaint_id", F.unix_micros("loaded_at").alias("loaded_us"), F.date_trunc("week", "date_received").cast("date").alias("week_start"), F.weekday("date_received").alias("day_of_week"), F.date_trunc("month", "date_received").cast("date").alias("month"), F.datediff("date_sent_to_company", "date_received").alias("days"))


@query("SELECT DISTINCT received_day, " + ", ".join(f"round({f}(2 * pi() * {k} * ((received_day - DATE '1970-01-01') + 719163) / 7), 6) + 0.0 AS {f}{k}" for k in (1, 2) for f in ("cos", "sin")) + " FROM daily_panel")
def sc09_fourier(spark, root):
    t = 2 * F.pi() * (F.unix_date("received_day") + 719163) / 7
    return table(spark, root, "daily_panel").select("received_day").distinct().select("received_day", *[(F.round(f(t * k), 6) + 0.0).alias(f"{name}{k}") for k in (1, 2) for f, name in ((F.cos, "cos"), (F.sin, "sin"))])


@query("SELECT query_id, to_json(list(vec_id ORDER BY place))::VARCHAR AS ids FROM (SELECT q AS query_id, bl AS vec_id, i AS place FROM (" + _NEAR.replace("WITH k AS (", "").rstrip().rstrip(")") + ")) GROUP BY query_id")
def sc14_json_ids(spark, root):
    ids = F.array_sort(F.collect_list(F.struct("place", "bl")))
    return _near(spark, root).groupBy("query_id").agg(ids.alias("l")).select("query_id", F.to_json(F.transform("l", lambda x: x["bl"])).alias("ids"))


_TOKENS = "list_filter(regexp_split_to_array(lower(narrative), '[^\\p{L}\\p{N}]+'), lambda w: length(w) > 1)"
_TFIDF = f"""WITH d AS (SELECT complaint_id, {_TOKENS} AS w FROM prepared WHERE period = 'train_2023_2024' AND narrative IS NOT NULL QUALIFY row_number() OVER (PARTITION BY complaint_id ORDER BY loaded_at DESC) = 1),
g AS (SELECT complaint_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM d), tf AS (SELECT complaint_id, term, count(*) AS n FROM g GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 5), nd AS (SELECT count(*) AS n FROM d),
w AS (SELECT complaint_id, tf.term, (1 + ln(tf.n)) * (ln((1.0 + nd.n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), nd)
"""


def _fit_docs(spark, root):
    from tidemark.operators.lookups import latest

    rows = _prepared(spark, root).where("period = 'train_2023_2024' AND narrative IS NOT NULL").select("complaint_id", "narrative", "loaded_at", "hash")
    return latest(rows, ["complaint_id"], "loaded_at", "hash").select("complaint_id", "narrative")


@query(_TFIDF + ", s AS (SELECT complaint_id, sqrt(sum(w * w)) AS norm, count(*) AS n_terms, max(w) AS top FROM w GROUP BY 1) SELECT complaint_id, n_terms, round(norm, 5) AS norm, round(top / norm, 6) AS top_weight FROM s")
def tx01_tfidf(spark, root):
    from tidemark.operators.features import tfidf

    w = tfidf(_fit_docs(spark, root), "complaint_id", "narrative", min_df=5)
    return w.groupBy("complaint_id").agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.max("norm"), 5).alias("norm"), F.round(F.max("weight"), 6).alias("top_weight"))


@query("WITH k AS (SELECT product_canonical AS p, CAST(row_number() OVER (ORDER BY product_canonical) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT product_canonical FROM prepared WHERE period = 'train_2023_2024' AND product_canonical IS NOT NULL)) SELECT complaint_id, epoch_us(loaded_at) AS loaded_us, COALESCE(k.code, -1) AS code FROM prepared LEFT JOIN k ON product_canonical = k.p")
def tx04_category_codes(spark, root):
    from tidemark.operators.features import category_codes

    p = _prepared(spark, root)
    return category_codes(p, p.where("period = 'train_2023_2024'"), "product_canonical").select("complaint_id", F.unix_micros("loaded_at").alias("loaded_us"), F.coalesce("code", F.lit(-1)).alias("code"))


@query(f"""WITH g AS (SELECT product_canonical AS part, unnest({_TOKENS}) AS term FROM prepared WHERE narrative IS NOT NULL AND product_canonical IS NOT NULL), n AS (SELECT part, term, count(*) AS n FROM g WHERE length(term) > 3 GROUP BY ALL), t AS (SELECT term, sum(n) AS a FROM n GROUP BY 1),
s AS (SELECT part, sum(n) AS size FROM n GROUP BY 1), m AS (SELECT avg(size) AS m FROM s) SELECT part, term, round(n / size * ln(1 + m / a), 6) AS weight FROM n JOIN t USING (term) JOIN s USING (part), m QUALIFY row_number() OVER (PARTITION BY part ORDER BY round(n / size * ln(1 + m / a), 9) DESC, term) <= 5""")
def tx06_class_terms(spark, root):
    from tidemark.operators.features import class_terms

    rows = _prepared(spark, root).where("narrative IS NOT NULL AND product_canonical IS NOT NULL").select(F.col("product_canonical").alias("part"), F.explode(T.tokens(F.col("narrative"))).alias("term")).where(F.length("term") > 3)
    return class_terms(rows, "part", "term", 5).withColumn("weight", F.round("weight", 6))
