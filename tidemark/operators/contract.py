"""Schema and content contracts: each check is a single pass that yields a violations row, raised on the driver if asked."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table breaks its contract."""


def require_columns(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """``df`` if its columns are ``expected`` in this order; else an error that names missing and extra ones."""
    if list(df.columns) != list(expected):
        missing, extra = [c for c in expected if c not in df.columns], [c for c in df.columns if c not in expected]
        raise ContractError(f"missing {missing}, extra {extra}" if missing or extra else f"order {df.columns}")
    return df


def require_none(violations: DataFrame) -> None:
    """Raise if any number of the single row of ``violations`` isn't 0."""
    bad = {k: v for k, v in violations.first().asDict().items() if v}
    if bad:
        raise ContractError(str(bad))


def strict_date(c: Column) -> Column:
    """A ``yyyy-MM-dd`` text as a date; null stays null, anything else becomes null and is counted by ``unparsable``."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def unparsable(c: Column) -> Column:
    """Aggregate: how many texts are there but no date."""
    return F.count_if(c.isNotNull() & strict_date(c).isNull())


def null_counts(df: DataFrame) -> DataFrame:
    """(column_name, n_null), a row per column, in one pass."""
    one = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    return one.selectExpr(f"stack({len(df.columns)}, {pairs}) AS (column_name, n_null)")


def table_contract(df: DataFrame, key: str, period: str) -> DataFrame:
    """Rows, distinct and null keys, null periods and the sorted set of periods as one text."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(key).alias("n_keys"),
        F.count_if(F.col(key).isNull()).alias("n_null_keys"),
        F.count_if(F.col(period).isNull()).alias("n_null_periods"),
        F.array_join(F.array_sort(F.collect_set(period)), ",").alias("periods"),
    )


def input_violations(df: DataFrame, required: Sequence[str], key: str) -> DataFrame:
    """Nulls per required column and rows beyond the first of each key, one row."""
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in required]
    return df.agg(*nulls, (F.count(key) - F.count_distinct(key)).alias("repeated_keys"))


def panel_violations(panel: DataFrame, run: Sequence[str], period: str, count: str, total: str) -> DataFrame:
    """Per ``run`` group: repeated (period, cluster) rows, null and negative counts, periods whose stored total varies or isn't the sum, and cells the grid lacks."""
    cell = panel.groupBy(*run, period, "cluster_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce(count, F.lit(0))).alias("c"), F.count_if(F.col(count).isNull()).alias("nulls"), F.count_if(F.col(count) < 0).alias("negative"), F.min(total).alias("lo"), F.max(total).alias("hi"))
    per = cell.groupBy(*run, period).agg(F.count(F.lit(1)).alias("cells"), F.sum(F.col("n") - 1).alias("repeats"), F.sum("nulls").alias("nulls"), F.sum("negative").alias("negative"), F.sum("c").alias("sum"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    clusters = panel.groupBy(*run).agg(F.count_distinct("cluster_id").alias("k"))
    out = per.groupBy(*run).agg(
        F.sum("repeats").alias("repeated_rows"), F.sum("nulls").alias("null_counts"), F.sum("negative").alias("negative_counts"), F.count_if(F.col("lo") != F.col("hi")).alias("varying_totals"), F.count_if(F.col("hi") != F.col("sum")).alias("wrong_totals"), F.count(F.lit(1)).alias("_periods"), F.sum("cells").alias("_cells")
    )
    return out.join(clusters, list(run)).withColumn("missing_cells", F.col("_periods") * F.col("k") - F.col("_cells")).drop("_periods", "_cells", "k")


def vector_check(df: DataFrame, vec: str) -> DataFrame:
    """Rows, null vectors, lengths, zero vectors and the largest distance of a norm from 1 among the others."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    held = df.select(F.col(vec).alias("v"), norm.alias("norm"))
    return held.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("v").isNull()).alias("n_null"), F.min(F.size("v")).alias("min_size"), F.max(F.when(F.col("v").isNotNull(), F.size("v"))).alias("max_size"), F.count_if(F.col("norm") == 0).alias("n_zero"), F.round(F.max(F.when(F.col("norm") > 0, F.abs(F.col("norm") - 1))), 4).alias("worst_norm"))


def text_boolean(c: Column) -> Column:
    """``true``/``false`` in any case as a boolean; null and other texts become null."""
    return F.when(F.lower(F.trim(c)) == "true", True).when(F.lower(F.trim(c)) == "false", False)


def renamed(df: DataFrame, prefix: str, to: str, keys: Sequence[str]) -> DataFrame:
    """``keys`` and all columns that start with ``prefix``, with ``to`` in its place."""
    return df.select(*keys, *[F.col(c).alias(to + c[len(prefix) :]) for c in df.columns if c.startswith(prefix)])


def three_valued(c: Column, values: Mapping[str, bool]) -> Column:
    """True or false for the texts named, null for null and all others."""
    out = F.lit(None).cast("boolean")
    for text, value in values.items():
        out = F.when(c == text, value).otherwise(out)
    return out


def label_by_start(d: Column, starts: Sequence[tuple[str, str]], before: str) -> Column:
    """The label of the last start on or before ``d``; ``before`` if there is none, null for null. ``starts`` are (label, date)."""
    out = F.lit(before)
    for label, start in sorted(starts, key=lambda s: s[1]):
        out = F.when(d >= F.lit(start).cast("date"), label).otherwise(out)
    return F.when(d.isNotNull(), out)


def contiguous(splits: Sequence[tuple[str, str, str]]) -> None:
    """Raise unless each (name, start, end) ends after it starts and starts where the one before it ends."""
    for i, (name, start, end) in enumerate(splits):
        if start >= end or i and splits[i - 1][2] != start:
            raise ContractError(f"split {name}: {start} to {end}")
