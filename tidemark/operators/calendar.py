"""Working days and orthogonal contrasts: small tables made from parameters."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def working_days(spark: SparkSession, first: dt.date, last: dt.date, holidays: Sequence[dt.date]) -> DataFrame:
    """(day, number): Mondays to Fridays without ``holidays``, numbered from 1; a row per day of the calendar asked for."""
    off = F.array(*[F.lit(h) for h in holidays]).cast("array<date>")
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day"))
    kept = days.where((F.weekday("day") < 5) & ~F.array_contains(off, F.col("day")))
    return kept.withColumn("number", F.row_number().over(Window.orderBy("day")))


def due_after(df: DataFrame, at: str, n: int, days: DataFrame, out: str) -> DataFrame:
    """``df`` with the ``n``-th working day after ``at``; a start on no working day counts from the last one before it. Null where the calendar doesn't reach.

    Distinct dates, not rows, are looked up in the calendar.
    """
    dates = df.select(at).where(F.col(at).isNotNull()).distinct()
    lists = days.agg(F.array_sort(F.collect_list("day")).alias("_days"))  # one row, as long as the calendar
    before = F.size(F.filter("_days", lambda d: d <= F.col(at)))
    due = F.get("_days", before + n - 1)
    known = (F.col(at) >= F.get("_days", F.lit(0))) & (F.col(at) <= F.element_at("_days", -1))
    got = dates.join(F.broadcast(lists)).select(at, F.when(known, due).alias(out))
    return df.join(got, at, "left")


def helmert(spark: SparkSession, k: int) -> DataFrame:
    """(cluster, contrast, value): k x (k - 1) orthonormal contrasts that sum to zero, scaled so that a sum over them with unit normal weights has variance 1 per cluster."""
    grid = spark.range(k).withColumnRenamed("id", "cluster").select("cluster", F.explode(F.sequence(F.lit(1), F.lit(k - 1))).alias("contrast"))
    j, c = F.col("contrast"), F.col("cluster")
    raw = F.when(c < j, 1.0).when(c == j, -j.cast("double")).otherwise(0.0) / F.sqrt(j * (j + 1))
    return grid.select("cluster", "contrast", (raw * F.sqrt(F.lit(k / (k - 1)))).alias("value"))
