"""Joins of facts with small or large lookups: categories, membership flags, alignment, grids and replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which a lookup is sent to all tasks; it is counted before.
BROADCAST_ROWS = 100_000


def small(dim: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``dim`` with a broadcast hint if it has at most ``most`` rows, which a bounded count checks; else as it is."""
    return F.broadcast(dim) if dim.limit(most + 1).count() <= most else dim


def with_category(df: DataFrame, raw: str, mapping: DataFrame, out: str, unknown: str | None, known: str) -> DataFrame:
    """``raw`` mapped through (raw, canonical): column ``out``, ``unknown`` where the mapping lacks it, and the flag ``known``."""
    dim = small(mapping.select(F.col("raw").alias("_raw"), F.col("canonical").alias("_canonical")).dropDuplicates(["_raw"]))
    got = df.join(dim, df[raw] == F.col("_raw"), "left")
    return got.withColumns({out: F.coalesce("_canonical", F.lit(unknown)), known: F.col("_raw").isNotNull()}).drop("_raw", "_canonical")


def with_pair_flag(df: DataFrame, left: str, right: str, pairs: DataFrame, out: str) -> DataFrame:
    """A flag whether (left, right) is one of ``pairs`` (left, right); null on either side is no pair."""
    dim = small(pairs.select(F.col("left").alias("_l"), F.col("right").alias("_r"), F.lit(True).alias("_ok")).distinct())
    return df.join(dim, (df[left] == F.col("_l")) & (df[right] == F.col("_r")), "left").withColumn(out, F.coalesce("_ok", F.lit(False))).drop("_l", "_r", "_ok")


def membership(df: DataFrame, key: str, reference: DataFrame, out: str) -> DataFrame:
    """A flag whether ``key`` occurs in ``reference`` (one column), null-safe: a null key occurs nowhere. Keeps all rows."""
    ref = reference.toDF("_k").where("_k IS NOT NULL").distinct().withColumn("_in", F.lit(True))
    return df.join(ref, df[key] == F.col("_k"), "left").withColumn(out, F.coalesce("_in", F.lit(False))).drop("_k", "_in")


def latest(df: DataFrame, keys: Sequence[str], at: str, tie: str) -> DataFrame:
    """Per ``keys`` the row with the last ``at``, then the largest ``tie``; all columns, without sorting groups."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def rate_with_default(df: DataFrame, group: str, value: Column, fit: Column) -> DataFrame:
    """Mean of a boolean per group over the fit rows, the global mean where a group has none: group, n_rows, rate."""
    v = F.when(fit, value.cast("double"))
    per = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(v).alias("_mean"))
    whole = df.agg(F.avg(v).alias("_all"))  # one row
    return per.join(F.broadcast(whole)).select(group, "n_rows", F.round(F.coalesce("_mean", "_all"), 6).alias("rate"))


def replaced(old: DataFrame, new: DataFrame, period: str | list[str]) -> DataFrame:
    """``old`` without the periods that ``new`` has, and ``new``, with a ``source`` tag; both have the same columns."""
    kept = old.join(new.select(period).distinct(), period, "left_anti").withColumn("source", F.lit("frozen"))
    return kept.unionByName(new.withColumn("source", F.lit("new")))
