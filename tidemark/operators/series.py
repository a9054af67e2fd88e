"""Count panels over time: grids, shares, decaying memory, cumulative sums, alarms.

A panel here has a row per ``run``, ``period`` and ``cluster_id`` with a count ``n``. Folds over time (decaying memory,
cumulative sums) are grouped Arrow functions, linear in a series' length, which the calendar bounds; series and runs are
spread over tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def period_counts(events: DataFrame, keys: list, distinct: str, novel: Column) -> DataFrame:
    """Rows, distinct values of ``distinct`` and novel rows per group."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(distinct).alias("n_distinct"), F.count_if(novel).alias("n_novel"))


def on_grid(counts: DataFrame, period: str, cluster: str, step_days: int, values: list[str]) -> DataFrame:
    """``counts`` for every cluster and every period from the first to the last of all, zero where there is no row."""
    span = counts.agg(F.min(period).alias("_a"), F.max(period).alias("_b"))  # one row
    every = F.explode(F.sequence("_a", "_b", F.expr(f"interval {step_days} days"))).alias(period)
    grid = counts.select(cluster).distinct().join(F.broadcast(span)).select(cluster, every)
    return grid.join(counts, [cluster, period], "left").select(cluster, period, *[F.coalesce(v, F.lit(0)).cast("long").alias(v) for v in values])


def with_shares(panel: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """The group total beside each row and the row's share of it; the share of an empty group is 0."""
    w = Window.partitionBy(*by)
    return panel.withColumn("total", F.sum(n).over(w)).withColumn("share", F.when(F.col("total") != 0, F.col(n) / F.col("total")).otherwise(0.0))


def lagged_shares(panel: DataFrame, width: int, short: bool = False, run: str = "score_run") -> DataFrame:
    """Share of each cluster in the ``width`` periods before, smoothed by one count per cluster: column ``recent_share``.

    Null until ``width`` earlier periods are there; with ``short``, until one is.
    """
    w = Window.partitionBy(run, "cluster_id").orderBy("period").rowsBetween(-width, -1)
    enough = F.count(F.lit(1)).over(w) >= (1 if short else width)
    own = panel.withColumn("_own", F.when(enough, F.sum("n").over(w)))
    per = Window.partitionBy(run, "period")
    return own.withColumn("recent_share", (F.col("_own") + 1) / (F.sum("_own").over(per) + F.count(F.lit(1)).over(per))).drop("_own")


def static_shares(panel: DataFrame, fit: Column, smooth: float = 1.0, run: str = "score_run") -> DataFrame:
    """(run, cluster_id, share) of the fit rows, with ``smooth`` counts added per cluster."""
    per = panel.groupBy(run, "cluster_id").agg(F.sum(F.when(fit, F.col("n")).otherwise(0)).alias("_n"))
    w = Window.partitionBy(run)
    return per.select(run, "cluster_id", ((F.col("_n") + smooth) / (F.sum("_n").over(w) + smooth * F.count(F.lit(1)).over(w))).alias("share"))


def decayed_shares(panel: DataFrame, keep: float, cap: float | None = None, run: str = "score_run") -> DataFrame:
    """Smoothed shares of a memory m <- keep * m + y over earlier periods: column ``memory_share``, null in a run's first period.

    Each series is one fold of its calendar. With ``cap``, at most cap * total * share of a period's count enters a
    cluster's memory, which couples the clusters: then a run, its calendar times its clusters, is one fold.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("period")
        n, memory, m = rows.n.to_numpy(float), np.zeros(len(rows)), 0.0
        for i in range(1, len(n)):
            m = memory[i] = keep * m + n[i - 1]
        return rows.assign(_m=memory)

    def coupled(rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot_table(index="period", columns="cluster_id", values="n", aggfunc="sum", fill_value=0).sort_index()
        y, memory = wide.to_numpy(float), np.zeros(wide.shape)
        for i in range(1, len(y)):
            share = (memory[i - 1] + 1) / (memory[i - 1].sum() + y.shape[1])
            seen = y[0] if i == 1 else np.minimum(y[i - 1], cap * y[i - 1].sum() * share)
            memory[i] = keep * memory[i - 1] + seen
        held = pd.DataFrame(memory, wide.index, wide.columns).stack().rename("_m").reset_index()
        return rows.merge(held, on=["period", "cluster_id"])[["score_run", "period", "cluster_id", "n", "_m"]]

    rows = panel.select(F.col(run).alias("score_run"), "period", "cluster_id", F.col("n").cast("long").alias("n"))
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in rows.columns) + ", _m double"
    out = rows.groupBy("score_run", "cluster_id").applyInPandas(one, schema) if cap is None else rows.groupBy("score_run").applyInPandas(coupled, schema)
    per = Window.partitionBy("score_run", "period")
    first = F.min("period").over(Window.partitionBy("score_run"))
    share = (F.col("_m") + 1) / (F.sum("_m").over(per) + F.count(F.lit(1)).over(per))
    return out.select(F.col("score_run").alias(run), "period", "cluster_id", "n", F.when(F.col("period") > first, share).alias("memory_share"))


def upper_cusum(scored: DataFrame, by: list[str], at: str, z: str, slack: float, limit: float) -> DataFrame:
    """S = max(0, S + z - slack), an alarm where S > limit, after which S starts again from 0: columns ``cusum`` and ``alarm``. A null z counts as 0.

    Each series is one fold over its periods.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(at)
        out, s = np.zeros(len(rows)), 0.0
        for i, v in enumerate(rows._z.to_numpy(float)):
            s = out[i] = max(0.0, s + v - slack)
            if s > limit:
                s = 0.0
        return rows.drop(columns="_z").assign(cusum=out, alarm=out > limit)

    rows = scored.select(*by, at, F.coalesce(z, F.lit(0.0)).cast("double").alias("_z"))
    kinds = dict(rows.dtypes)
    return rows.groupBy(*by).applyInPandas(fold, ", ".join(f"{c} {kinds[c]}" for c in [*by, at]) + ", cusum double, alarm boolean")


def scan_statistic(z: Column, w: Window, width: int = 3) -> Column:
    """Sum of the last ``width`` values over its square root; null before there are as many."""
    frame = w.rowsBetween(1 - width, 0)
    return F.when(F.count(z).over(frame) == width, F.sum(z).over(frame) / F.sqrt(F.lit(float(width))))


def injected(panel: DataFrame, start: Column, scenarios: DataFrame, run: str = "score_run") -> DataFrame:
    """The panel once per scenario (name, kind, size, span): from ``start`` on growth (1 + size) ** t, a step of 1 + size, or a burst times size for span periods; counts are rounded half to even and totals made anew."""
    t = F.datediff("period", start) / 7
    grown = F.when(F.col("kind") == "growth", F.pow(1 + F.col("size"), t + 1)).when(F.col("kind") == "step", 1 + F.col("size")).when((F.col("kind") == "burst") & (t < F.col("span")), F.col("size")).otherwise(1.0)
    rows = panel.withColumn("_s", F.lit(1)).join(F.broadcast(scenarios.withColumn("_s", F.lit(1))), "_s").drop("_s")
    rows = rows.withColumn("n", F.when((F.col("cluster_id") == F.col("target")) & (t >= 0), F.bround(F.col("n") * grown)).otherwise(F.col("n")).cast("long"))
    return rows.withColumn("total", F.sum("n").over(Window.partitionBy(run, "name", "period")))


def softmax_expected(df: DataFrame, by: list[str], score: str, total: str) -> DataFrame:
    """``expected`` = total * softmax of ``score`` within the group, by the shifted exponential."""
    w = Window.partitionBy(*by)
    e = F.exp(F.col(score) - F.max(score).over(w))
    return df.withColumn("_e", e).withColumn("expected", F.col(total) * F.col("_e") / F.sum("_e").over(w)).drop("_e")
