"""Totals and averages over trailing periods, periods without rows included (problem 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALL = -1  # the cluster_id under which a run's sum over its clusters is reported; ``is_sum`` tells it from a stored -1


def held_rows(panel: DataFrame, period: str) -> DataFrame:
    """Of several rows for a score_run, cluster_id and period, the one loaded last: score_run, cluster_id, period, n.

    A null count is 0; a null loaded_at is older than any; of rows loaded at the same instant the larger count holds.
    Rows without score_run, cluster_id or period belong to no series and are left out.
    """
    keys = [F.col("score_run").cast("long").alias("score_run"), F.col("cluster_id").cast("long").alias("cluster_id"), F.col(period).cast("date").alias("period")]
    rows = panel.select(*keys, F.struct(F.col("loaded_at").alias("at"), F.coalesce("complaint_count", F.lit(0)).cast("long").alias("n")).alias("v"))
    rows = rows.where("score_run IS NOT NULL AND cluster_id IS NOT NULL AND period IS NOT NULL")
    return rows.groupBy("score_run", "cluster_id", "period").agg(F.max("v").alias("v")).select("score_run", "cluster_id", "period", F.col("v.n").alias("n"))


def densified(held: DataFrame, step_days: int) -> DataFrame:
    """Every series of every run on the run's whole calendar, and the run's own sum as cluster -1 with ``is_sum``.

    The calendar of a run goes from its first to its last stored period. Entities are crossed with it through a sequence
    per (run, cluster), an equi-join on the run, so no Cartesian product is planned; counts are then added by key.
    """
    span = held.groupBy("score_run").agg(F.min("period").alias("first"), F.max("period").alias("last"))
    held = held.withColumn("is_sum", F.lit(False))
    series = held.select("score_run", "cluster_id", "is_sum").distinct()
    series = series.unionByName(span.select("score_run", F.lit(ALL).cast("long").alias("cluster_id"), F.lit(True).alias("is_sum")))
    every = F.sequence("first", "last", F.expr(f"interval {int(step_days)} days"))
    grid = series.join(span, "score_run").select("score_run", "cluster_id", "is_sum", F.explode(every).alias("period"), F.lit(0).cast("long").alias("n"))
    totals = held.groupBy("score_run", "period").agg(F.sum("n").alias("n")).withColumn("cluster_id", F.lit(ALL).cast("long")).withColumn("is_sum", F.lit(True))
    return grid.unionByName(held).unionByName(totals).groupBy("score_run", "cluster_id", "is_sum", "period").agg(F.sum("n").alias("n"))


def trailing(panel: DataFrame, grain: str, short: int, long: int) -> DataFrame:
    """Trailing totals and averages of each series: grain, score_run, cluster_id, period_start, period_no, complaint_count, short_total, short_mean, long_total, long_mean.

    ``grain`` is ``week`` (column week) or ``day`` (column received_day). Windows hold the period itself and those before
    it, fewer at the start of a run, and means are over the periods there are. A series has at most as many rows as its
    run's calendar has periods, however many rows the panel stores. An empty panel gives no rows.
    """
    period, step = {"week": ("week", 7), "day": ("received_day", 1)}[grain]
    dense = densified(held_rows(panel, period), step)
    w = Window.partitionBy("score_run", "cluster_id", "is_sum").orderBy("period")

    def over(agg: Column, n: int) -> Column:
        return agg.over(w.rowsBetween(1 - n, 0))

    return dense.select(
        F.lit(grain).alias("grain"),
        "score_run",
        "cluster_id",
        F.date_format("period", "yyyy-MM-dd").alias("period_start"),
        F.row_number().over(w).alias("period_no"),
        F.col("n").alias("complaint_count"),
        over(F.sum("n"), short).alias("short_total"),
        F.round(over(F.avg("n"), short), 6).alias("short_mean"),
        over(F.sum("n"), long).alias("long_total"),
        F.round(over(F.avg("n"), long), 6).alias("long_mean"),
    )


def surges(panel: DataFrame, grain: str, short: int, long: int, least: int = 20) -> DataFrame:
    """Periods, from the ``long``-th of a run on, whose long total is at least ``least`` and whose short total is at least half of it."""
    out = trailing(panel, grain, short, long)
    out = out.where((F.col("period_no") >= long) & (F.col("long_total") >= least) & (2 * F.col("short_total") >= F.col("long_total")))
    return out.select("grain", "score_run", "cluster_id", "period_start").distinct()
