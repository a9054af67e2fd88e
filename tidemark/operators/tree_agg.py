"""Per-key results under heavy skew: aggregation over a tree of fixed-size input chunks (problem 2).

A key that holds a third of all rows would send all of its partial states to one reducer in a plain ``groupBy``: as many
as there are map tasks. Here every state carries the ordinal of the input chunk it came from. The first round combines
rows by (key, chunk), which map-side aggregation does locally; each later round merges ``fan_in`` neighbouring nodes, so
no reducer ever gets more than ``fan_in`` states of a key, and the number of rounds is the logarithm of the chunk count.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ROW_BITS = 33  # monotonically_increasing_id holds the row number in the lower 33 bits


class State(NamedTuple):
    """A mergeable state: its name, the aggregate over input rows and how two states merge (sum, min or max)."""

    name: str
    init: Column
    merge: str = "sum"


_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def tree_aggregate(df: DataFrame, keys: Sequence[str], states: Sequence[State], chunk_rows: int = 65_536, fan_in: int = 16) -> DataFrame:
    """One row per distinct ``keys`` with the merged states.

    Nulls in keys are keys of their own (as in ``groupBy``); aggregates skip null inputs; an empty table gives no rows;
    rows count as often as they are stored. Column names of ``df`` don't matter, as inner columns are prefixed.
    """
    if fan_in < 2 or chunk_rows < 1:
        raise ValueError("fan_in must be at least 2 and chunk_rows at least 1")
    row = F.monotonically_increasing_id()
    part = F.shiftright(row, _ROW_BITS)
    chunk = F.floor((row % F.lit(1 << _ROW_BITS)) / F.lit(chunk_rows))
    placed = df.withColumns({"_tree_part": part, "_tree_chunk": chunk.cast("long")})
    # Only the shape of the input, two numbers; a scan reads no column for it.
    shape = placed.agg(F.max("_tree_part").alias("p"), F.max("_tree_chunk").alias("c")).first()
    width, nodes = (shape["c"] or 0) + 1, ((shape["p"] or 0) + 1) * ((shape["c"] or 0) + 1)
    out = placed.withColumn("_tree_node", F.col("_tree_part") * F.lit(width) + F.col("_tree_chunk"))
    out = out.groupBy(*keys, "_tree_node").agg(*[s.init.alias(s.name) for s in states])
    merged = [_MERGE[s.merge](s.name).alias(s.name) for s in states]
    for _ in range(max(0, math.ceil(math.log(max(nodes, 1), fan_in)) - 1)):
        up = F.floor(F.col("_tree_node") / F.lit(fan_in)).alias("_tree_node")
        out = out.groupBy(*keys, up).agg(*merged)
    return out.groupBy(*keys).agg(*merged)


def long_keys(df: DataFrame, fields: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Each row once per field, as ``field_name`` and ``key_value`` beside the columns ``keep``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("key_value")) for f in fields])).alias("_kv")
    return df.select(pairs, *keep).select("_kv.field_name", "_kv.key_value", *keep)


def key_profile(prepared: DataFrame, fields: Sequence[str] = ("company", "product"), chunk_rows: int = 65_536, fan_in: int = 16) -> DataFrame:
    """Counts, dates, lags and text volume of every value of ``fields``, null included as a value of its own.

    Columns: field_name, key_value, n_rows, n_narrative, narrative_chars, n_untimely, first_received, last_received,
    mean_lag_days (null where no row has both dates).
    """
    long = long_keys(prepared, fields, ["narrative", "timely_response", "date_received", "date_sent_to_company"])
    lag = F.datediff("date_sent_to_company", "date_received")
    states = [
        State("n_rows", F.count(F.lit(1))),
        State("n_narrative", F.count("narrative")),
        State("narrative_chars", F.sum(F.coalesce(F.length("narrative"), F.lit(0)).cast("long"))),
        State("n_untimely", F.count_if(F.col("timely_response") == "No")),
        State("first_received", F.min("date_received"), "min"),
        State("last_received", F.max("date_received"), "max"),
        State("lag_days", F.sum(lag.cast("long"))),
        State("lag_rows", F.count(lag)),
    ]
    out = tree_aggregate(long, ["field_name", "key_value"], states, chunk_rows, fan_in)
    mean = F.when(F.col("lag_rows") > 0, F.col("lag_days") / F.col("lag_rows"))
    return out.withColumn("mean_lag_days", F.round(mean, 6)).drop("lag_days", "lag_rows")


def heavy_keys(prepared: DataFrame, fields: Sequence[str] = ("company", "product"), share: float = 0.02, chunk_rows: int = 65_536, fan_in: int = 16) -> DataFrame:
    """Values that hold at least ``share`` of all stored rows: field_name, key_value. Null is no value; an empty table has none."""
    long = long_keys(prepared, fields, [])
    counts = tree_aggregate(long, ["field_name", "key_value"], [State("n_rows", F.count(F.lit(1)))], chunk_rows, fan_in)
    # One row per field: as many rows as fields are named in the call, whatever the data.
    totals = counts.groupBy("field_name").agg(F.sum("n_rows").alias("_all"))
    held = counts.join(F.broadcast(totals), "field_name").where(F.col("key_value").isNotNull() & (F.col("n_rows") >= F.lit(share) * F.col("_all")))
    return held.select("field_name", "key_value")
