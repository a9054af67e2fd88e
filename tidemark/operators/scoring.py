"""Fit, score and sample as composed jobs over written tables, and transforms that go on where they stopped."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.lookups import replaced, small
from tidemark.operators.predictive import weekly_predictive
from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.series import on_grid
from tidemark.operators.vectors import assign, centres
from tidemark.sources import files
from tidemark.sources.sinks import write_csv, write_parquet, write_report


def fit(vectors: DataFrame, label: str, path: str, novel: float = 0.99, vec: str = "embedding") -> None:
    """Write a model to the new directory ``path``: the mean vector of each label and the ``novel`` quantile of its members' distances."""
    cs = centres(vectors, label, vec)
    write_parquet(cs, f"{path}/centres")
    cs = vectors.sparkSession.read.parquet(f"{path}/centres")
    near = assign(vectors.select(vec), cs, vec)
    write_parquet(exact_quantiles(near, ["part"], "distance", [novel]).select("part", F.col("q")[0].alias("limit")), f"{path}/limits")
    write_report({"novel": novel, "n_centres": cs.count()}, f"{path}/model.json")


def assigned(new: DataFrame, model: str, key: str, day: str, vec: str = "embedding") -> DataFrame:
    """(key, day, cluster_id, distance, is_novel) of rows with a key, a day and a vector."""
    spark = new.sparkSession
    rows = new.where(F.col(key).isNotNull() & F.col(day).isNotNull()).select(key, F.col(day).cast("date").alias(day), vec)
    near = assign(rows, spark.read.parquet(f"{model}/centres"), vec).drop(vec)
    near = near.join(small(spark.read.parquet(f"{model}/limits")), "part", "left")
    return near.select(key, day, F.col("part").alias("cluster_id"), "distance", F.coalesce(F.col("distance") > F.col("limit"), F.lit(True)).alias("is_novel"))


def score(new: DataFrame, model: str, path: str, key: str, day: str, history: DataFrame | None = None, vec: str = "embedding", shape: float = 8.0) -> None:
    """Write all results for ``new`` to the new directory ``path``: assignments, daily and weekly panels, weekly predictions, alerts and ``score.json``.

    Panels have every cluster on every period between the first and the last. ``history`` (period, cluster_id, n) holds
    earlier weeks; those that ``new`` has replace them. A repeated key is an error; rows without key, day or vector are
    left out and counted. The report comes last, so its presence tells that all is written.
    """
    spark = new.sparkSession
    got = assigned(new, model, key, day, vec)
    write_parquet(got, f"{path}/assignments")
    got = spark.read.parquet(f"{path}/assignments")
    n, n_keys = got.count(), got.select(key).distinct().count()
    if n != n_keys:
        raise ValueError(f"{n - n_keys} repeated keys")
    week = F.date_trunc("week", day).cast("date")
    for name, period, step in (("daily", F.col(day), 1), ("weekly", week, 7)):
        counts = got.groupBy(period.alias("period"), "cluster_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_novel").alias("n_novel"))
        write_parquet(on_grid(counts, "period", "cluster_id", step, ["n", "n_novel"]), f"{path}/{name}")
    panel = spark.read.parquet(f"{path}/weekly").select("period", "cluster_id", "n")
    whole = panel if history is None else replaced(history.select("period", "cluster_id", "n"), panel, "period").drop("source")
    predicted = weekly_predictive(whole.select(F.lit(1).cast("long").alias("score_run"), "period", "cluster_id", "n"), shape).drop("score_run")
    write_parquet(predicted, f"{path}/predictions")
    alerts = spark.read.parquet(f"{path}/predictions").where("alarm").select("period", "cluster_id", "n", "expected", "z", "cusum")
    write_csv(alerts, f"{path}/alerts", ("period", "cluster_id"))
    write_report({"n_rows": new.count(), "n_assigned": n, "n_novel": got.where("is_novel").count(), "n_alerts": alerts.count()}, f"{path}/score.json")


def sampled(df: DataFrame, n: int, key: str, path: str, seed: int = 7) -> int:
    """Write the ``n`` rows of the smallest seeded hash of ``key`` to a new path, whatever order the rows come in."""
    rows = df.where(F.col(key).isNotNull()).withColumn("_h", F.xxhash64(key, F.lit(seed))).orderBy("_h", key).limit(n).drop("_h")
    return write_parquet(rows, path)


def resumable(df: DataFrame, key: str, transform: Callable[[DataFrame], DataFrame], path: str, settings: dict, buckets: int = 16, per_job: int = 4) -> DataFrame:
    """``transform`` of ``df``, written bucket by bucket of ``key``; buckets that an earlier call finished are kept.

    ``settings`` name what the result depends on: a directory made with others is refused. A job writes ``per_job``
    buckets and marks each when it is done; a job that dies leaves unmarked buckets, which are written anew.
    """
    spark: SparkSession = df.sparkSession
    mark = json.dumps({**settings, "buckets": buckets}, sort_keys=True)
    if not files.exists(f"{path}/settings.json"):
        files.write_text(f"{path}/settings.json", mark)
    elif files.read_text(f"{path}/settings.json") != mark:
        raise ValueError(f"{path} was made with other settings")
    todo = [b for b in range(buckets) if not files.exists(f"{path}/done/{b}")]
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets).cast("long"))
    for a in range(0, len(todo), per_job):
        part = todo[a : a + per_job]
        out = transform(df.where(bucket.isin(part))).withColumn("bucket", bucket.cast("int"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/rows")
        for b in part:
            files.write_text(f"{path}/done/{b}", "done\n")
    return spark.read.parquet(f"{path}/rows").drop("bucket")
