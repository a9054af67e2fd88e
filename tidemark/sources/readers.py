"""Readers: typed Parquet, CSV and array sources, pinned inputs, finished runs, file statistics."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.sources import files


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet or CSV table by its suffix, all CSV columns as text so that ids keep their zeros; other suffixes are refused."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix == ".parquet":
        df = spark.read.parquet(path)
    elif suffix == ".csv":
        df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", False).csv(path)
    else:
        raise ValueError(f"unsupported input {suffix or path!r}; expected .parquet or .csv")
    return df.select(*columns) if columns else df


def completed(df: DataFrame, required: Sequence[str], optional: Sequence[str]) -> DataFrame:
    """``required`` and ``optional`` columns as text, optional ones null where ``df`` lacks them; a missing required one is an error."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    have = set(df.columns)
    return df.selectExpr(*[f"CAST(`{c}` AS STRING) AS `{c}`" if c in have else f"CAST(NULL AS STRING) AS `{c}`" for c in [*required, *optional]])


def text_schema(columns: Sequence[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def read_dated(spark: SparkSession, path: str, columns: Sequence[str], dates: Sequence[str], pattern: str = "yyyy-MM-dd") -> DataFrame:
    """Some columns of a CSV table as text, those in ``dates`` as dates; a text that is no date of the pattern is an error when read."""
    df = read_table(spark, path, columns)
    return df.withColumns({c: F.to_date(c, pattern) for c in dates})


def file_sha256(path: str) -> str:
    """The digest of a file of any store that Spark reads."""
    return files.sha256(path)


def require_pinned(pinned: Mapping[str, str]) -> None:
    """Raise unless each file has the SHA-256 given for it."""
    wrong = [p for p, want in pinned.items() if file_sha256(p) != want]
    if wrong:
        raise ValueError(f"changed inputs: {wrong}")


def pinned_lines(path: str, digest: str) -> list[str]:
    """The lines of a small reference file, such as a list of holidays, with the SHA-256 given for it."""
    require_pinned({path: digest})
    return files.read_text(path).splitlines()


def latest_run(pattern: str) -> str:
    """The last directory by name that matches and holds ``_SUCCESS``."""
    done = [p for p in files.matching(pattern) if files.exists(f"{p}/_SUCCESS")]
    if not done:
        raise FileNotFoundError(f"no finished run at {pattern}")
    return done[-1]


def file_statistics(path: str) -> dict[str, dict[str, int]]:
    """Per column the nulls and bytes that the row group footers of a Parquet file tell, without reading data."""
    store, at = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (None, path)
    meta, out = pq.ParquetFile(at, filesystem=store).metadata, {}
    for g in range(meta.num_row_groups):
        for c in range(meta.num_columns):
            col = meta.row_group(g).column(c)
            got = out.setdefault(col.path_in_schema, {"n_null": 0, "n_bytes": 0})
            got["n_bytes"] += col.total_compressed_size
            if col.statistics is not None and col.statistics.has_null_count:
                got["n_null"] += col.statistics.null_count
    return out


def read_vectors(spark: SparkSession, path: str, row: str = "embedding_row", vec: str = "embedding", first: int | None = None, end: int | None = None) -> DataFrame:
    """A directory of vector shards as one table (row, vec); with ``first`` and ``end`` the rows of that half-open range, which prunes files by their statistics."""
    df = spark.read.parquet(path).select(row, vec)
    df = df if first is None else df.where(F.col(row) >= first)
    return df if end is None else df.where(F.col(row) < end)
