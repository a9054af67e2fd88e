"""Evaluation metrics as aggregates: classification, ranking, intervals, paired resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def class_scores(df: DataFrame, truth: str, predicted: str, weight: str | None = None) -> DataFrame:
    """(label, support, precision, recall, f1) of the labels in truth; a ratio over nothing is 0. Rows without truth don't count."""
    w = F.col(weight) if weight else F.lit(1)
    cells = df.where(F.col(truth).isNotNull()).groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.sum(w).alias("w"))
    both = F.explode(F.array(F.struct(F.col("t").alias("label"), F.col("w").alias("s"), F.lit(0).cast("double").alias("q"), F.when(F.col("t") == F.col("p"), F.col("w")).otherwise(0).cast("double").alias("h")), F.struct(F.col("p").alias("label"), F.lit(0).alias("s"), F.col("w").cast("double").alias("q"), F.lit(0).cast("double").alias("h")))).alias("x")
    per = cells.select(both).where("x.label IS NOT NULL").groupBy("x.label").agg(F.sum("x.s").alias("support"), F.sum("x.q").alias("q"), F.sum("x.h").alias("h"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return per.where("support > 0").select("label", "support", F.round(ratio(F.col("h"), F.col("q")), 6).alias("precision"), F.round(ratio(F.col("h"), F.col("support")), 6).alias("recall"), F.round(ratio(2 * F.col("h"), F.col("q") + F.col("support")), 6).alias("f1"), ratio(2 * F.col("h"), F.col("q") + F.col("support")).alias("_f1"))


def macro_f1(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count(F.lit(1)).alias("n_labels"), F.round(F.avg("_f1"), 6).alias("macro_f1"))


def _by_score(df: DataFrame, score: str, truth: str, by: list[str]) -> DataFrame:
    """Running positives and rows at each distinct score, highest first. One row per score enters the window, not one per row."""
    per = df.where(F.col(score).isNotNull() & F.col(truth).isNotNull()).groupBy(*by, score).agg(F.count(F.lit(1)).alias("n"), F.count_if(truth).alias("pos"))
    w = Window.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumns({"cum_n": F.sum("n").over(w), "cum_pos": F.sum("pos").over(w), "all_pos": F.sum("pos").over(Window.partitionBy(*by))})


def average_precision(df: DataFrame, score: str, truth: str, by: list[str]) -> DataFrame:
    """Sum of precision times recall gained at each distinct score."""
    rows = _by_score(df, score, truth, by)
    return rows.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("pos").alias("n_positive"), F.round(F.sum(F.try_divide(F.col("pos") * F.col("cum_pos"), F.col("all_pos") * F.col("cum_n"))), 6).alias("average_precision"))


def best_threshold(df: DataFrame, score: str, truth: str, by: list[str]) -> DataFrame:
    """The score with the largest F1 (the highest on ties to 9 places)."""
    rows = _by_score(df, score, truth, by).withColumn("f1", F.round(2 * F.col("cum_pos") / (F.col("cum_n") + F.col("all_pos")), 9))
    return rows.groupBy(*by).agg(F.max(F.struct("f1", F.col(score).alias("threshold"))).alias("b")).select(*by, F.round("b.f1", 6).alias("f1"), F.round("b.threshold", 6).alias("threshold"))


def at_threshold(df: DataFrame, score: str, truth: str, threshold: float, by: list[str]) -> DataFrame:
    """Precision, recall, F1 with ``score >= threshold`` and the Brier score."""
    called, hit = F.col(score) >= threshold, F.col(truth)
    tp, p, t = F.count_if(called & hit), F.count_if(called), F.count_if(hit)
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return df.where(F.col(truth).isNotNull()).groupBy(*by).agg(ratio(tp, p).alias("precision"), ratio(tp, t).alias("recall"), ratio(2 * tp, p + t).alias("f1"), F.round(F.avg(F.pow(F.col(score) - F.col(truth).cast("int"), F.lit(2))), 6).alias("brier"))


def interval_score(y: Column, low: Column, high: Column, alpha: float) -> Column:
    """Width of the interval plus 2 / alpha times how far y lies outside."""
    return (high - low) + (2 / alpha) * (F.greatest(low - y, F.lit(0.0)) + F.greatest(y - high, F.lit(0.0)))


def weighted_interval_score(y: Column, median: Column, intervals: dict[float, tuple[Column, Column]]) -> Column:
    """(|y - median| / 2 + sum of alpha / 2 times the interval scores) / (number of intervals + 1/2); ``intervals`` by alpha."""
    total = 0.5 * F.abs(y - median)
    for alpha, (low, high) in intervals.items():
        total = total + (alpha / 2) * interval_score(y, low, high, alpha)
    return total / (len(intervals) + 0.5)


def paired_resampling(sums: DataFrame, period: str, a: str, b: str, draws: int, seed: int) -> DataFrame:
    """Quantiles of the difference a - b of mean errors over resampled periods, the same periods for both.

    ``sums`` has one row per period; a draw picks as many periods as there are, with replacement, by integer arithmetic
    on (draw, place). Only period sums, never rows, are repeated per draw.
    """
    ranked = sums.select(F.row_number().over(Window.orderBy(period)).alias("i"), a, b)
    n = ranked.agg(F.count(F.lit(1)).alias("n"))
    picks = sums.sparkSession.range(draws).withColumnRenamed("id", "draw").join(F.broadcast(n)).select("draw", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("place"), "n")
    mixed = F.pmod((F.col("draw") * 7919 + F.col("place") * 104729 + seed) * F.lit(2654435761), F.lit(1 << 32))
    picks = picks.select("draw", (F.pmod(F.floor(mixed / 65536), F.col("n")) + 1).alias("i"))
    per = picks.join(ranked, "i").groupBy("draw").agg(F.avg(F.col(a) - F.col(b)).alias("d"))
    q = F.percentile("d", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return per.agg(q.alias("q")).select(*[F.round(F.col("q")[k], 6).alias(name) for k, name in enumerate(("p025", "p50", "p975"))])


def rand_index(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labellings on rows that have both, and the number of those rows."""
    cell = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda n: n * (n - 1) / 2
    whole = cell.agg(F.sum("n").alias("n"), F.sum(pairs(F.col("n"))).alias("same"))
    side = lambda c, name: cell.groupBy(c).agg(F.sum("n").alias("m")).agg(F.sum(pairs(F.col("m"))).alias(name))
    one = whole.join(F.broadcast(side(a, "x"))).join(F.broadcast(side(b, "y")))  # one row each
    expected = F.col("x") * F.col("y") / pairs(F.col("n"))
    return one.select("n", F.round((F.col("same") - expected) / ((F.col("x") + F.col("y")) / 2 - expected), 6).alias("adjusted_rand"))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mutual information over the mean of the two entropies, on rows that have both labels."""
    cell = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    wa, wb, w = Window.partitionBy(a), Window.partitionBy(b), Window.partitionBy()
    p = cell.select("n", F.sum("n").over(wa).alias("na"), F.sum("n").over(wb).alias("nb"), F.sum("n").over(w).alias("t"))
    return p.agg(F.round(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))) * 2 / (-F.sum(F.col("n") / F.col("t") * F.log(F.col("na") / F.col("t"))) - F.sum(F.col("n") / F.col("t") * F.log(F.col("nb") / F.col("t")))), 6).alias("nmi"))
