"""Session helpers: table access, shared scratch tables, session defaults."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_STAGED: list[str] = []


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``root``."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where that is unset in a local session a folder of this machine is made and set; on a cluster that would be one
    folder per machine, so there it is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = held.get() if held.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        at = "file://" + folder
        spark.sparkContext.setCheckpointDir(at)
    return at


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    if not _STAGED:
        atexit.register(discard, spark)
    _STAGED.append(f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}")
    return _STAGED[-1]


def staged(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage and keeps the rows of an expensive step that is read more than once; it outlives any executor. The
    table is deleted when the application ends, or before by ``discard``.
    """
    at = scratch(df.sparkSession)
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def discard(spark: SparkSession) -> None:
    """Delete all tables that ``staged`` has written so far; results not yet read from them are lost."""
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        while _STAGED:
            path = jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
            path.getFileSystem(conf).delete(path, True)
    except Exception:  # the session may have ended before the interpreter
        _STAGED.clear()
