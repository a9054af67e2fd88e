"""Files of any store that Spark reads, through its file system interface."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(path: str):
    """(file system, path) of the session's store."""
    spark = SparkSession.active()
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(sc._jsc.hadoopConfiguration()), where


def exists(path: str) -> bool:
    fs, at = _at(path)
    return fs.exists(at)


def matching(pattern: str) -> list[str]:
    """Paths that match a glob pattern, sorted by name."""
    fs, at = _at(pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(at) or [])


def sha256(path: str) -> str:
    """The digest of a file's bytes, read as a stream."""
    fs, at = _at(path)
    stream = fs.open(at)
    try:
        return SparkSession.active().sparkContext._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def write_text(path: str, text: str) -> None:
    """A new file of UTF-8 text; an existing one is refused."""
    fs, at = _at(path)
    if fs.exists(at):
        raise FileExistsError(path)
    stream = fs.create(at, False)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def read_text(path: str) -> str:
    fs, at = _at(path)
    stream = fs.open(at)
    try:
        return SparkSession.active().sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def rename(old: str, new: str) -> None:
    """Move a file or directory within a store; an existing target is refused."""
    fs, at = _at(old)
    target = _at(new)[1]
    if fs.exists(target):
        raise FileExistsError(new)
    if target.getParent() is not None:
        fs.mkdirs(target.getParent())
    if not fs.rename(at, target):
        raise OSError(f"can't move {old} to {new}")
