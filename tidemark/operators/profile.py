"""Profiles of tables and texts: value counts, column summaries, repeated groups, concentration, bands."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field_name, value, n) of every value as text, null included, in one pass over all fields."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in fields])).alias("p")
    return df.select(pairs).groupBy("p.field_name", "p.value").agg(F.count(F.lit(1)).alias("n"))


def column_summary(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(column_name, n_present, percent_null to 2 places, n_distinct), one pass for counts, distinct values by exploding."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("column_name"), F.col(f).cast("string").alias("v")) for f in fields])).alias("p")
    per = df.select(pairs).groupBy("p.column_name", "p.v").agg(F.count(F.lit(1)).alias("n"))  # pre-aggregated: distinct values, not rows, are shuffled
    present = F.sum(F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0))
    return per.groupBy("column_name").agg(present.alias("n_present"), F.round(100 * (1 - present / F.sum("n")), 2).alias("percent_null"), F.count("v").alias("n_distinct"))


def first_example(c: Column, key: Column, most: int = 40) -> Column:
    """Aggregate: the value of the smallest key that isn't null, cut to ``most`` characters with an ellipsis."""
    v = F.min_by(c, F.when(c.isNotNull(), key))
    return F.when(F.length(v) > most, F.concat(F.substring(v, 1, most - 1), F.lit("…"))).otherwise(v)


def positive_rates(df: DataFrame, targets: Mapping[str, Column], by: str) -> DataFrame:
    """(by, target, n_known, percent_true to 3 places, 0 where none is known); nulls are dropped."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("target"), c.cast("int").alias("v")) for k, c in targets.items()])).alias("p")
    got = df.select(by, pairs).groupBy(by, "p.target").agg(F.count("p.v").alias("n_known"), F.avg("p.v").alias("_m"))
    return got.select(by, "target", "n_known", F.round(100 * F.coalesce("_m", F.lit(0.0)), 3).alias("percent_true"))


def group_sizes(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of the groups that aren't null."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def repetition(df: DataFrame, key: str) -> DataFrame:
    """Groups, repeated groups, rows in them, copies beyond the first, largest group, percent of rows repeated."""
    g = group_sizes(df, key)
    many = F.col("n") > 1
    rows = F.sum(F.when(many, F.col("n")).otherwise(0))
    return g.agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(many).alias("n_repeated"), rows.alias("rows_repeated"), F.sum(F.col("n") - 1).alias("extra_copies"), F.max("n").alias("largest"), F.round(100 * rows / F.sum("n"), 6).alias("percent_repeated"))


def dominant(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """(group, value, n, share) of the most frequent value, the smaller on ties; null values don't count.

    Counts are aggregated per (group, value) first, so a hot group sends its distinct values only.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    top = per.groupBy(*group).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("t"), F.sum("n").alias("_all"))
    return top.select(*group, F.col("t.v").alias(value), (-F.col("t.m")).alias("n"), F.round(-F.col("t.m") / F.col("_all"), 6).alias("share"))


def bands(n: Column, edges: Sequence[tuple[str, int]]) -> Column:
    """The label of the last edge on or below ``n``; null below the first. ``edges`` are (label, from), ascending."""
    out = F.lit(None).cast("string")
    for label, low in edges:
        out = F.when(n >= low, label).otherwise(out)
    return out


def concentration(counts: DataFrame, n: str, tie: str, tops: Sequence[int]) -> DataFrame:
    """(top, n_rows, percent) covered by the ``top`` largest of few counted groups."""
    ranked = counts.withColumn("_r", F.row_number().over(Window.orderBy(F.desc(n), F.asc_nulls_first(tie))))
    picks = F.explode(F.array(*[F.lit(t) for t in tops])).alias("top")
    return ranked.select("_r", n, picks).groupBy("top").agg(F.sum(F.when(F.col("_r") <= F.col("top"), F.col(n)).otherwise(0)).alias("n_rows"), F.sum(n).alias("_all")).select("top", "n_rows", F.round(100 * F.col("n_rows") / F.col("_all"), 6).alias("percent"))


def snippet(text: Column, most: int) -> Column:
    """White space collapsed, cut to ``most`` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def hash_order(key: Column, seed: int) -> Column:
    """A pseudo-random order of integer keys by integer arithmetic, the same in any engine."""
    return F.pmod(key * F.lit(2654435761) + F.lit(seed), F.lit(1 << 32))
