"""Queries of fitted models and composed tables; results that no SQL can give are checked by tests instead."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import models as M
from tidemark.operators.predictive import daily_predictive, weekly_predictive
from tidemark.plans.series import daily, weekly
from tidemark.session import table

QUERIES, ORACLE = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _texts(spark, root):
    p = table(spark, root, "prepared").where("narrative IS NOT NULL").select("complaint_id", "period", "product_canonical", "t1", "t2", "narrative")
    return M.term_slots(p, "narrative", category="product_canonical").drop("narrative")


@query
def ml01_linear_classes(spark, root):
    """The complaint's class from its text and product."""
    x = _texts(spark, root)
    return M.linear_classes(x.where("period = 'train_2023_2024'"), x.where("period = 'validation_2025_h1'"), "t1").select("complaint_id", "t1", "predicted")


@query
def ml02_calibrated(spark, root):
    x = _texts(spark, root)
    got = M.calibrated(x.where("period = 'train_2023_2024'"), x.where("period = 'validation_2025_h1'"), x.where("period = 'holdout_2025_h2'"), "t2")
    return got.select("complaint_id", "t2", F.round("probability_true", 4).alias("probability_true"))


@query
def ml04_projection(spark, root):
    e = table(spark, root, "embeddings")
    got, _ = M.projected(e, e, "embedding", 8)
    return got.select("vec_id", F.array_join(F.transform("projected", lambda x: F.round(F.abs(x), 4).cast("string")), ",").alias("projected"))


@query
def ml06_kmeans(spark, root):
    return M.partitioned(table(spark, root, "embeddings"), "embedding", 10).select("vec_id", "part")


@query
def ml12_mixture(spark, root):
    e = table(spark, root, "embeddings")
    got, _ = M.projected(e, e, "embedding", 4)
    return M.mixture(got, "projected", 5).select("vec_id", "part", F.round("confidence", 4).alias("confidence"))


@query
def st15_weekly_predictive(spark, root):
    got = weekly_predictive(weekly(spark, root), 8.0)
    return got.select("score_run", "cluster_id", "period", "n", *[F.round(c, 4).alias(c) for c in ("expected", "z", "cusum")], "p10", "p50", "p90", "alarm")


@query
def st16_daily_predictive(spark, root):
    effect = F.exp(0.05 * F.weekday("period"))
    got = daily_predictive(daily(spark, root), 8.0, 0.05, effect)
    return got.select("score_run", "cluster_id", "period", "n", *[F.round(c, 6).alias(c) for c in ("expected", "upper_tail", "impossible")], *[F.col(c).cast("long").alias(c) for c in ("p10", "p50", "p90")])
