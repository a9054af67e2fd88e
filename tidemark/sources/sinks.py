"""Writers: verified Parquet, sharded and CSV output, reports, publishing by renaming."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources import files


def write_parquet(df: DataFrame, path: str, expected_rows: int | None = None, rows_per_file: int | None = None, partition_by: tuple[str, ...] = ()) -> int:
    """Write zstd Parquet to a new path, count it again and compare with ``expected_rows``; returns the rows."""
    w = df.write.mode("errorifexists").option("compression", "zstd")
    if rows_per_file:
        w = w.option("maxRecordsPerFile", rows_per_file)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    n = df.sparkSession.read.parquet(path).count()
    if expected_rows is not None and n != expected_rows:
        raise ValueError(f"{path} holds {n} rows instead of {expected_rows}")
    return n


def write_csv(df: DataFrame, path: str, order_by: tuple[str, ...] = (), one_file: bool = True) -> None:
    """CSV with a header: a small result, such as a metrics table, as one file, or a file per task where ``one_file`` is off."""
    out = df.orderBy(*order_by) if order_by else df
    (out.coalesce(1) if one_file else out).write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def write_report(values: dict, path: str) -> None:
    """A report as JSON text with non-ASCII characters kept; NaN and infinities are refused."""
    text = json.dumps(values, ensure_ascii=False, allow_nan=False, indent=2, default=str)
    files.write_text(path, text + "\n")


def publish(staging: str, final: str, expected_rows: int | None = None) -> None:
    """Move a finished staging directory to its final name within a store; an existing target, unfinished output or, where given, another number of Parquet rows is refused."""
    if files.exists(final):
        raise FileExistsError(final)
    if not files.exists(f"{staging}/_SUCCESS"):
        raise ValueError(f"{staging} is not finished")
    if expected_rows is not None:
        n = SparkSession.active().read.parquet(staging).count()
        if n != expected_rows:
            raise ValueError(f"{staging} holds {n} rows instead of {expected_rows}")
    files.rename(staging, final)
