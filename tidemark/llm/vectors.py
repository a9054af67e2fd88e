"""Vector columns in Spark and numpy: usable vectors, Arrow to matrix, spherical k-means."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _usable(v: Column) -> Column:
    return F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def usable_vectors(vectors: DataFrame, reached_from: DataFrame | None = None, row: str = "embedding_row", vec: str = "embedding", at: str = "encoded_at", dim: int | None = None) -> DataFrame:
    """(row_id, vec): one row per embedding_row with a usable vector.

    Unusable are null, all-zero and non-finite vectors, vectors with a null element, a null row id and, where ``dim`` is
    given, vectors of another length (a pass over all rows finds the usual one, see ``usual_size``). Of several vectors for a row the one encoded last holds, then the one with the
    larger hash. With ``reached_from``, only rows named in that table's ``embedding_row``. Scale doesn't matter later on.
    """
    v = F.col(vec)
    ok = _usable(v)
    if dim is not None:
        ok = ok & (F.size(v) == dim)
    held = vectors.where(F.col(row).isNotNull() & v.isNotNull() & ok)
    held = held.groupBy(F.col(row).cast("long").alias("row_id")).agg(F.max_by(v, F.struct(F.col(at), F.xxhash64(v))).alias("vec"))
    if reached_from is not None:
        held = held.join(reached_from.select(F.col(row).cast("long").alias("row_id")), "row_id", "left_semi")
    return held


def usual_size(vectors: DataFrame, vec: str = "embedding") -> int:
    """The length that most vectors have (the shorter on ties), 0 without vectors."""
    sizes = vectors.where(F.col(vec).isNotNull()).groupBy(F.size(vec).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    top = sizes.orderBy(F.desc("n"), "size").first()
    return top["size"] if top else 0


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list-of-float or binary column as a float32 matrix of unit rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if pa.types.is_binary(column.type):
        flat = np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32)
    else:
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(n, -1) if n else np.zeros((0, 1), np.float32)
    norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return (x / np.where(norm > 0, norm, 1)).astype(np.float32)


def usable_rows(vectors: DataFrame, dim: int, row: str = "embedding_row", vec: str = "embedding") -> DataFrame:
    """(row_id, vec) of every stored row that ``usable_vectors`` may take, repeated rows as often as stored: to draw a sample from."""
    v = F.col(vec)
    return vectors.where(F.col(row).isNotNull() & _usable(v) & (F.size(v) == dim)).select(F.col(row).cast("long").alias("row_id"), v.alias("vec"))


def training_sample(held: DataFrame, n: int, most: int) -> np.ndarray:
    """At most ``most`` of the ``n`` vectors, picked by a hash of the row id: a bounded fitting sample of unit rows."""
    picked = held if n <= most else held.where(F.pmod(F.xxhash64(F.col("row_id"), F.lit(17)), F.lit(100_000_000)) < int(100_000_000 * min(1.0, most / n)))
    table = picked.select("row_id", "vec").limit(most + most // 4).toArrow()
    order = np.argsort(table.column("row_id").to_numpy(), kind="stable")
    return matrix(table.column("vec"))[order][:most]


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0, spherical: bool = False) -> np.ndarray:
    """Centres of ``x`` by Lloyd's rounds; an empty centre moves to the point that is worst served."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].astype(np.float32).copy()
    for _ in range(rounds):
        score = x @ c.T - (0 if spherical else 0.5 * (c * c).sum(1))
        near = score.argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        c = sums / np.maximum(n, 1)[:, None]
        for j, worst in zip(np.flatnonzero(n == 0), np.argsort(score.max(1))):
            c[j] = x[worst]
        if spherical:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c.astype(np.float32)
