"""Weekly and daily predictive tables: expectation, quantiles, normal score, cumulative sum and alarms of each series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.special import mid_z_udf, nb_cdf_udf, nb_quantile_udf
from tidemark.operators.series import decayed_shares, lagged_shares, upper_cusum

LEVELS = {"p10": 0.1, "p50": 0.5, "p90": 0.9}


def weekly_predictive(panel: DataFrame, shape: float, keep: float = 0.9, slack: float = 0.5, limit: float = 3.0) -> DataFrame:
    """Per run, week and cluster: n, expected, quantiles, z, cusum, alarm.

    The expectation is the week's total times the share remembered from earlier weeks; counts around it are negative
    binomial with the given shape. Nothing is scored in a run's first week: there the sum takes z as 0 and alarms are off.
    """
    rows = decayed_shares(panel, keep)
    rows = rows.withColumn("expected", F.col("memory_share") * F.sum("n").over(Window.partitionBy("score_run", "period"))).drop("memory_share")
    mean = F.when(F.col("expected") > 0, F.col("expected"))
    alpha = F.lit(float(shape))
    rows = rows.withColumn("z", mid_z_udf(F.col("n").cast("double"), alpha, mean)).withColumns({k: nb_quantile_udf(q)(alpha, mean) for k, q in LEVELS.items()})
    sums = upper_cusum(rows.select("score_run", "cluster_id", "period", "z"), ["score_run", "cluster_id"], "period", "z", slack, limit)
    return rows.join(sums, ["score_run", "cluster_id", "period"]).withColumn("alarm", F.col("alarm") & F.col("z").isNotNull())


def daily_predictive(panel: DataFrame, shape: float, zero: float, effect: Column, width: int = 7) -> DataFrame:
    """Per run, day and cluster: n, expected, p10, p50, p90, upper_tail, impossible, of a zero-inflated negative binomial.

    The mean is the day's total times the share of the last ``width`` days times the weekday effect, made to sum to the
    total again; with probability ``zero`` a count is zero whatever the mean. ``upper_tail`` is the chance of n or more,
    ``impossible`` that of more than the day's total.
    """
    day = Window.partitionBy("score_run", "period")
    rows = lagged_shares(panel, width, short=True).withColumn("_e", F.col("recent_share") * effect).withColumn("total", F.sum("n").over(day))
    mean = F.when(F.col("total") > 0, F.col("total") * F.col("_e") / F.sum("_e").over(day))
    rows = rows.withColumn("_mean", mean).withColumn("expected", (1 - zero) * F.col("_mean")).drop("recent_share", "_e")
    tail = lambda c: F.when(c >= 0, (1 - zero) * (1 - nb_cdf_udf(c.cast("double"), F.lit(float(shape)), F.col("_mean")))).otherwise(1.0)
    # A quantile at or under the share of zeros is zero.
    at = {k: nb_quantile_udf((q - zero) / (1 - zero))(F.lit(float(shape)), F.col("_mean")) if q > zero else F.when(F.col("_mean").isNotNull(), 0.0) for k, q in LEVELS.items()}
    return rows.withColumns(at).withColumn("upper_tail", tail(F.col("n") - 1)).withColumn("impossible", tail(F.col("total"))).drop("_mean")
