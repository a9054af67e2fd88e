"""Exact vector operators: search of a stated query set against all rows, centres, assignment, margins, silhouettes.

Vectors are arrays of floats; products are sums over zipped arrays inside generated code. Searches compare the query set
with all rows in blocks; a set is sent to all tasks only if it is checked to be small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _best(ids: np.ndarray, q: np.ndarray, mine: np.ndarray, x: np.ndarray, k: int) -> list[np.ndarray]:
    """(query, row, similarity) of the k rows nearest to each query, itself left out, ties by id."""
    s = q @ x.T
    s[ids[:, None] == mine] = -np.inf
    order = np.lexsort((np.broadcast_to(mine, s.shape), -np.round(s, 7)), axis=1)[:, :k]
    best = np.take_along_axis(s, order, 1)
    keep = best > -np.inf
    return [ids[np.nonzero(keep)[0]], mine[order[keep]], best[keep]]


def _cells(left: DataFrame, right: DataFrame, n_left: int, n_right: int, work, schema: str) -> DataFrame:
    """``work`` on each block of (id, ...) rows of ``left`` with each of ``right``: a grid of tasks, each row sent to as many as the other side has blocks."""
    block = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n).cast("long"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    a = left.withColumn("_i", block(n_left, 1)).withColumn("_j", each(n_right))
    b = right.withColumn("_j", block(n_right, 2)).withColumn("_i", each(n_left))
    return a.groupBy("_i", "_j").cogroup(b.groupBy("_i", "_j")).applyInArrow(work, schema)


def nearest(index: DataFrame, queries: DataFrame, k: int, block_queries: int = 20_000, key: str = "vec_id", vec: str = "embedding", block_rows: int = 50_000) -> DataFrame:
    """(query_id, vec_id, similarity, place): the ``k`` rows with the largest inner product, itself left out, ties by id.

    At most ``block_queries`` queries are sent to all tasks; more meet the rows in a grid of blocks through a shuffle. Each
    task keeps ``k`` per query and batch, so what is shuffled after that doesn't grow with the rows compared.
    """
    pick = lambda d: d.where(F.col(vec).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vec).alias("v"))
    asked, rows, schema = pick(queries), pick(index), "query_id long, vec_id long, similarity double"
    names = ["query_id", "vec_id", "similarity"]
    if asked.limit(block_queries + 1).count() <= block_queries:
        part = asked.toArrow()
        if not part.num_rows:
            return index.sparkSession.createDataFrame([], schema + ", place int")
        ids, q = part.column("id").to_numpy(), _matrix(part.column("v").combine_chunks())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield pa.record_batch(list(map(pa.array, _best(ids, q, b.column("id").to_numpy(), _matrix(b.column("v")), k))), names=names)

        out = rows.mapInArrow(run, schema)
    else:

        def cell(a: pa.Table, b: pa.Table) -> pa.Table:
            parts = []
            for s in range(0, a.num_rows if b.num_rows else 0, 512):
                some = a.slice(s, 512)
                parts.append(_best(some.column("id").to_numpy(), _matrix(some.column("v").combine_chunks()), b.column("id").to_numpy(), _matrix(b.column("v").combine_chunks()), k))
            kinds = (np.int64, np.int64, np.float64)
            return pa.table([pa.array(np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, t)) for c, t in enumerate(kinds)], names=names)

        out = _cells(asked, rows, -(-asked.count() // block_queries), max(1, -(-rows.count() // block_rows)), cell, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 7)), "vec_id")
    return out.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def centres(df: DataFrame, label: str, vec: str = "embedding") -> DataFrame:
    """(part, centre): the mean vector of each label, summed by place, so map-side aggregation shrinks it before it moves."""
    place = df.where(F.col(vec).isNotNull() & F.col(label).isNotNull()).select(F.col(label).alias("part"), F.posexplode(vec).alias("i", "v"))
    mean = place.groupBy("part", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return mean.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("c")).select("part", F.col("c.v").alias("centre"))


def _distances(df: DataFrame, cs: DataFrame, vec: str) -> DataFrame:
    """Each row with its distances from all centres as one sorted array; centres are one row per label."""
    all_c = cs.agg(F.collect_list(F.struct("part", "centre")).alias("_cs"))
    apart = lambda c: F.sqrt(F.aggregate(F.zip_with(vec, c["centre"], lambda x, y: F.pow(x.cast("double") - y, F.lit(2))), F.lit(0.0), lambda s, x: s + x))
    near = F.transform("_cs", lambda c: F.struct(F.round(apart(c), 9).alias("r"), c["part"].alias("part"), apart(c).alias("distance")))
    return df.where(F.col(vec).isNotNull()).join(F.broadcast(all_c)).withColumn("_near", F.array_sort(near)).drop("_cs")


def assign(df: DataFrame, cs: DataFrame, vec: str = "embedding") -> DataFrame:
    """``df`` with ``part``, the nearest centre (the smaller label on ties), and ``distance``; null vectors are left out."""
    return _distances(df, cs, vec).withColumns({"part": F.col("_near")[0]["part"], "distance": F.col("_near")[0]["distance"]}).drop("_near")


def margins(df: DataFrame, cs: DataFrame, vec: str = "embedding") -> DataFrame:
    """``df`` with ``margin``, by how much the second centre is farther than the first, relative to the first."""
    n = F.col("_near")
    return _distances(df, cs, vec).withColumn("margin", F.try_divide(n[1]["distance"] - n[0]["distance"], n[0]["distance"])).drop("_near")


def silhouette(sample: DataFrame, label: str, key: str = "vec_id", vec: str = "embedding", block_rows: int = 20_000) -> DataFrame:
    """(label, silhouette, n): mean exact silhouette of unit vectors by label; rows with a null vector or label are left out.

    Quadratic by its definition: every row's distances from all others are summed by label, up to ``block_rows`` rows in
    one block that all tasks have, more in a grid of blocks. A row alone in its label has a silhouette of 0.
    """
    rows = sample.where(F.col(vec).isNotNull() & F.col(label).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vec).alias("v"))
    size = rows.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    names = ["id", "own", "other", "d"]

    def sums(a: pa.Table | pa.RecordBatch, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> pa.Table:
        kinds, code = np.unique(labels, return_inverse=True)
        parts = []
        for s in range(0, a.num_rows if len(ids) else 0, 512):
            some = a.slice(s, 512)
            v = some.column("v")
            mine = some.column("id").to_numpy()
            d = np.sqrt(np.maximum(0, 2 - 2 * _matrix(v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v) @ x.T))
            d[mine[:, None] == ids] = 0
            per = np.stack([d[:, code == j].sum(1) for j in range(len(kinds))], axis=1)
            parts.append((np.repeat(mine, len(kinds)), np.repeat(some.column("label").to_numpy(), len(kinds)), np.tile(kinds, len(mine)), per.ravel()))
        return pa.table([pa.array(np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, t)) for c, t in enumerate((np.int64, np.int64, np.int64, np.float64))], names=names)

    schema, n = "id long, own long, other long, d double", rows.count()
    if n <= block_rows:
        held = rows.toArrow()
        if not n:
            return sample.sparkSession.createDataFrame([], "label int, silhouette double, n long")
        all_ = (held.column("id").to_numpy(), held.column("label").to_numpy(), _matrix(held.column("v").combine_chunks()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from sums(b, *all_).to_batches()

        got = rows.mapInArrow(run, schema)
    else:
        work = lambda a, b: sums(a, b.column("id").to_numpy(), b.column("label").to_numpy(), _matrix(b.column("v").combine_chunks()) if b.num_rows else np.zeros((0, 1)))
        blocks = -(-n // block_rows)
        got = _cells(rows, rows, blocks, blocks, work, schema)
    per = got.groupBy("id", "own", "other").agg(F.sum("d").alias("d")).join(size.withColumnRenamed("label", "other"), "other")
    own = F.col("own") == F.col("other")
    two = per.groupBy("id", "own").agg(F.max(F.when(own, F.col("d") / F.greatest(F.col("size") - 1, F.lit(1)))).alias("a"), F.max(F.when(own, F.col("size"))).alias("size"), F.min(F.when(~own, F.col("d") / F.col("size"))).alias("b"))
    s = F.when((F.col("size") > 1) & F.col("b").isNotNull(), F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).otherwise(0.0)
    return two.groupBy(F.col("own").cast("int").alias("label")).agg(F.avg(s).alias("silhouette"), F.count(F.lit(1)).alias("n"))
