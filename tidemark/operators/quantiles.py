"""Exact interpolated quantiles without keeping all distinct values of a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.lookups import small

ACCURACY = 100_000  # of the sketch that encloses a quantile


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], accuracy: int = ACCURACY) -> DataFrame:
    """(keys, q): quantiles of the non-null ``value`` per group, linear between neighbouring ranks, in the order of ``probs``.

    A mergeable sketch gives values that enclose each quantile; counts of what lies below them and the distinct values
    between them, about 4 / ``accuracy`` of a group's rows, then give the exact ranks. Null keys are a group; a group
    without values has a null; an empty table gives no rows. Without keys there is one row.
    """
    keys, ps, margin = list(keys), [float(p) for p in probs], 2 / accuracy
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(value).cast("double").alias("_v"))
    edges = [min(1.0, max(0.0, p + s * margin)) for p in ps for s in (-1, 1)]
    sketch = rows.groupBy(*names).agg(F.count("_v").alias("_n"), F.percentile_approx("_v", edges, accuracy).alias("_e"))
    sketch = sketch.select(*names, "_n", *[F.col("_e")[2 * i + s].alias(f"_{'ab'[s]}{i}") for i in range(len(ps)) for s in (0, 1)])
    ranks = [(F.lit(p) * (F.col("_n") - 1)).alias(f"_r{i}") for i, p in enumerate(ps)]
    sketch = sketch.select("*", *ranks)
    right = small(sketch.select(*[F.col(n).alias(f"{n}_") for n in names], *[c for c in sketch.columns if c not in names]))
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}_"))
    both = (rows.join(right, same) if names else rows.join(F.broadcast(right))).where("_v IS NOT NULL").select(*names, "_v", *[f"_{c}{i}" for i in range(len(ps)) for c in "abr"])
    v = F.col("_v")
    # Below each enclosure: how many, and the largest; above it the smallest.
    around = both.groupBy(*names).agg(
        *[F.count_if(v < F.col(f"_a{i}")).alias(f"_below{i}") for i in range(len(ps))],
        *[F.max(F.when(v < F.col(f"_a{i}"), v)).alias(f"_prev{i}") for i in range(len(ps))],
        *[F.min(F.when(v > F.col(f"_b{i}"), v)).alias(f"_next{i}") for i in range(len(ps))],
        *[F.first(f"_r{i}").alias(f"_r{i}") for i in range(len(ps))],
    )
    hits = F.filter(F.array(*[F.when((v >= F.col(f"_a{i}")) & (v <= F.col(f"_b{i}")), F.lit(i)) for i in range(len(ps))]), lambda x: x.isNotNull())
    inside = both.select(*names, "_v", F.explode(hits).alias("_i")).groupBy(*names, "_i", "_v").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*names, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("_upto", F.sum("_c").over(w))
    each = around.select(*names, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"_below{i}").alias("below"), F.col(f"_prev{i}").alias("prev"), F.col(f"_next{i}").alias("next"), F.col(f"_r{i}").alias("r")) for i in range(len(ps))])).alias("_x")).select(*names, "_x.*")
    each = each.select(*[F.col(n).alias(f"{n}_") for n in names], "i", "below", "prev", "next", "r")
    match = F.col("i") == F.col("_i")
    for n in names:
        match = match & F.col(n).eqNullSafe(F.col(f"{n}_"))
    both = inside.join(each, match)
    low = F.floor("r") + 1  # as a rank from 1
    at = lambda k: F.when(F.col("below") >= k, F.col("prev")).otherwise(F.coalesce(F.min(F.when(F.col("below") + F.col("_upto") >= k, F.col("_v"))), F.first("next")))
    got = both.groupBy(*names, "_i", "below", "prev", "r").agg(at(low).alias("x"), at(low + 1).alias("y"))
    q = F.when(F.col("r") == F.floor("r"), F.col("x")).otherwise(F.col("x") + (F.col("y") - F.col("x")) * (F.col("r") - F.floor("r")))
    out = got.groupBy(*names).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", q.alias("q")))), lambda s: s["q"]).alias("q"))
    if not names:
        return out
    every = rows.select(*names).distinct().select(*[F.col(n).alias(f"{n}_") for n in names])
    return every.join(out, same, "left").select(*[F.col(f"{n}_").alias(k) for n, k in zip(names, keys)], "q")
