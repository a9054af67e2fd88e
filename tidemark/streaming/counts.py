"""Incremental versions of the panels: windowed counts, period replacement, cumulative sums kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def period_counts(stream: DataFrame, at: str, key: str, period: str = "1 day", late: str = "2 days", ident: str | None = None) -> DataFrame:
    """(period_start, key, n) per tumbling period; weeks start on Monday. Rows later than ``late`` are dropped; with ``ident``, repeats within that time count once."""
    stream = stream.withWatermark(at, late)
    if ident:
        stream = stream.dropDuplicatesWithinWatermark([ident])
    # Windows are counted from 1970-01-01, a Thursday: weeks are moved to start on Monday.
    w = F.window(at, "7 days", "7 days", "4 days") if period == "7 days" else F.window(at, period)
    return stream.groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("period_start"), key, "n")


def replace_periods(path: str, period: str):
    """A ``foreachBatch`` function that overwrites the batch's periods, and only these, in a table partitioned by ``period``."""

    def run(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(period).parquet(path)

    return run


def running_cusum(stream: DataFrame, key: str, at: str, z: str, slack: float, limit: float) -> DataFrame:
    """(key, at, cusum, alarm) with the sum of each key kept between batches; a batch's rows are taken in order of ``at``. A null z counts as 0."""

    def update(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (held,) = state.get if state.exists else (0.0,)
        rows = pd.concat(list(frames)).sort_values(at)
        out = []
        for when, v in zip(rows[at], rows[z]):
            held = max(0.0, held + (0.0 if v is None or v != v else float(v)) - slack)
            alarm = held > limit
            out.append((k[0], when, held, alarm))
            held = 0.0 if alarm else held
        state.update((held,))
        yield pd.DataFrame(out, columns=[key, at, "cusum", "alarm"])

    kinds = dict(stream.dtypes)
    schema = f"{key} {kinds[key]}, {at} {kinds[at]}, cusum double, alarm boolean"
    return stream.groupBy(key).applyInPandasWithState(update, schema, "held double", "append", "NoTimeout")
