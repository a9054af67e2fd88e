"""The k most similar vectors of every vector (problem 1): inverted file, product-quantised residuals, exact reranking.

Coarse centroids and codebooks are fitted on a bounded sample; every vector is indexed in the list of its nearest
centroid and searches that list and those whose centroid is nearly as close. A list's task encodes the residuals of its
members, sums asymmetric distance tables over the codes for each searching vector, and reranks the best by exact cosine.

The number of lists grows with the vectors (about ``LIST_ROWS`` each), so does the fitting sample, up to its bound, and the
lists a vector searches are at most ``probes`` at any size: work grows with the vectors, not with their square. Inside a
list the members are parted once more, by centroids of the list's own, and a vector is held against the nearest ``probes``
parts of about ``PART_ROWS`` members; a list of fewer parts is searched whole.

A vector travels once per list it searches. Lists expected to hold more than ``block_rows`` vectors are cut into a grid
of (member block, query block) tasks, so a hot list never lands in one task. Exact copies are collapsed before: one
representative searches for the class, and the class's ids are put back afterwards, without expanding all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.vectors import kmeans, matrix, training_sample, usable_rows, usable_vectors, usual_size

SAMPLE_ROWS = 262_144  # bound of the fitting sample; it is 16,384 until lists beyond 1,024 ask for more, 16 vectors each
LIST_ROWS = 12_500  # vectors of a list, once there are more than 64 lists of so many
PART_ROWS = 512
MEMBER, QUERY = 1, 2


class Index:
    """Coarse centroids and residual codebooks, a few hundred KB whatever the data."""

    def __init__(self, sample: np.ndarray, n: int, lists: int | None, parts: int, words: int, block_rows: int):
        self.lists = lists or max(1, min(max(64, n // LIST_ROWS), len(sample) // (64 if n // LIST_ROWS <= 64 else 16)))
        self.coarse = kmeans(sample, self.lists, spherical=True, seed=1)
        self.lists = len(self.coarse)
        near = (sample @ self.coarse.T).argmax(1)
        share = (np.bincount(near, minlength=self.lists) + 1) / max(1, len(sample))
        self.grid = np.maximum(1, np.ceil(share * n / block_rows)).astype(np.int64)
        rest = sample - self.coarse[near]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(parts, sample.shape[1]))
        self.books = [kmeans(rest[:, c], words, rounds=8, seed=2 + i) for i, c in enumerate(self.cuts)]

    def encode(self, x: np.ndarray, at: int) -> np.ndarray:
        """Codes of members of list ``at``: rows x parts."""
        rest = x - self.coarse[at]
        return np.stack([(rest[:, c] @ b.T - 0.5 * (b * b).sum(1)).argmax(1) for c, b in zip(self.cuts, self.books)], axis=1)

    def best(self, q: np.ndarray, codes: np.ndarray, members: np.ndarray, keep: int) -> np.ndarray:
        """For each query the positions of the ``keep`` members with the largest asymmetric inner product."""
        got = np.zeros((len(members), len(q)), np.float32)  # the list's own centroid adds the same to all members
        for m, (c, b) in enumerate(zip(self.cuts, self.books)):
            got += (b @ q[:, c].T)[codes[:, m]]
        got = np.ascontiguousarray(got.T)
        if keep >= len(members):
            return np.tile(np.arange(len(members)), (len(q), 1))
        return np.argpartition(-got, keep, axis=1)[:, :keep]


def _routed(index: Index, probes: int, margin: float):
    schema = pa.schema([("cell", pa.int64()), ("row_id", pa.int64()), ("role", pa.int8()), ("vec", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.concatenate([[0], np.cumsum(index.grid**2)])
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column("row_id").to_numpy(), matrix(batch.column("vec"))
            score = x @ index.coarse.T
            order = np.argsort(-score, axis=1, kind="stable")[:, :probes]
            sorted_score = np.take_along_axis(score, order, 1)
            use = sorted_score >= sorted_score[:, :1] - margin
            who, rank = np.nonzero(use)
            to = order[who, rank]
            g, h = index.grid[to], (ids[who] * 2654435761) % (1 << 32)
            cells, rows, roles = [], [], []
            one = g == 1
            cells.append(base[to[one]]), rows.append(who[one]), roles.append(np.where(rank[one] == 0, MEMBER | QUERY, QUERY))
            for i in np.flatnonzero(~one):
                n, at = g[i], base[to[i]]
                cells.append(at + np.arange(n) * n + h[i] % n), rows.append(np.full(n, who[i])), roles.append(np.full(n, QUERY))
                if rank[i] == 0:
                    cells.append(at + (h[i] // n % n) * n + np.arange(n)), rows.append(np.full(n, who[i])), roles.append(np.full(n, MEMBER))
            cell, row, role = np.concatenate(cells), np.concatenate(rows), np.concatenate(roles)
            packed = x.view(f"V{4 * x.shape[1]}").ravel()
            for a in range(0, len(cell), 8192):
                s = slice(a, a + 8192)
                yield pa.record_batch([pa.array(cell[s]), pa.array(ids[row[s]]), pa.array(role[s].astype(np.int8)), pa.array([v.tobytes() for v in packed[row[s]]], pa.binary())], schema=schema)

    return run


def _parts(members: np.ndarray, part_rows: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(centres, part of each member); one part where there would be no more than ``most``."""
    n = -(-len(members) // part_rows)
    if n <= most:
        return members[:1], np.zeros(len(members), np.int64)
    centres = kmeans(members[:: max(1, len(members) // (16 * n))], n, rounds=6, spherical=True, seed=3)
    return centres, (members @ centres.T).argmax(1)


def _searched(index: Index, k: int, rerank: int, probes: int, part_rows: int, chunk: int = 128):
    base = np.concatenate([[0], np.cumsum(index.grid**2)])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        at = int(np.searchsorted(base, key[0].as_py(), side="right") - 1)
        ids, role, x = table.column("row_id").to_numpy(), table.column("role").to_numpy(), matrix(table.column("vec"))
        members, queries = np.flatnonzero(role & MEMBER), np.flatnonzero(role & QUERY)
        out: list[tuple[np.ndarray, ...]] = []
        if len(members):
            centres, part = _parts(x[members], part_rows, probes)
            near = np.argsort(-(x[queries] @ centres.T), axis=1, kind="stable")[:, :probes]
            for c in range(len(centres)):
                mine, asking = members[part == c], queries[(near == c).any(1)]
                mx, mid, codes = x[mine], ids[mine], index.encode(x[mine], at)
                for s in range(0, len(asking) if len(mine) else 0, chunk):
                    some = asking[s : s + chunk]
                    got = index.best(x[some], codes, mine, min(len(mine), rerank + 1))
                    exact = np.einsum("qd,qrd->qr", x[some], mx[got])
                    other = mid[got]
                    exact[other == ids[some][:, None]] = -2
                    order = np.lexsort((other, -exact), axis=1)[:, :k]
                    exact, other = np.take_along_axis(exact, order, 1), np.take_along_axis(other, order, 1)
                    keep = exact > -2
                    out.append((np.repeat(ids[some], keep.sum(1)), other[keep], exact[keep]))
        a, b, sim = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.float32)))
        order = np.lexsort((b, -sim, a))
        a, b, sim = a[order], b[order], sim[order]
        first = np.searchsorted(a, a, "left")
        top = np.arange(len(a)) - first < k
        return pa.table({"a": pa.array(a[top]), "b": pa.array(b[top]), "sim": pa.array(sim[top].astype(np.float32))})

    return run


def most_similar(vectors: DataFrame, reached_from: DataFrame | None = None, k: int = 5, lists: int | None = None, probes: int = 12, margin: float = 0.15, parts: int = 24, words: int = 64, rerank: int = 96, sample_rows: int = SAMPLE_ROWS, block_rows: int = 50_000, part_rows: int = PART_ROWS) -> DataFrame:
    """The ``k`` most similar other vectors of every usable vector: row_id, other_id, similarity, rank.

    ``probes`` lists are searched at most, and only those whose centroid's cosine is within ``margin`` of the best;
    ``rerank`` candidates of each part of a list get the exact cosine. Ties go to the smaller id. Null, all-zero and non-finite
    vectors, and those of another length than most, take no part (see ``usable_vectors``); a repeated row id counts once; a vector without any other has no
    rows; empty tables give none. ``similarity`` is rounded to 6 places.
    """
    dim = usual_size(vectors)
    held = usable_vectors(vectors, reached_from, dim=dim)
    stamped = held.select("row_id", F.struct(F.xxhash64("vec").alias("x"), F.hash("vec").alias("y")).alias("h"))
    classes = stamped.groupBy("h").agg(F.min("row_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    members = stamped.join(classes.where("n > 1"), "h").select("row_id", "rep")
    fitting = usable_rows(vectors, dim)
    n = fitting.count()
    sample = training_sample(fitting, n, min(sample_rows, max(16_384, 16 * (n // LIST_ROWS))))
    schema = "row_id long, other_id long, similarity double, rank int"
    if not len(sample):
        return vectors.sparkSession.createDataFrame([], schema)
    index = Index(sample, n, lists, parts, words, block_rows)
    reps = held.join(members.where("row_id <> rep").select("row_id"), "row_id", "left_anti")
    cells = reps.select("row_id", "vec").mapInArrow(_routed(index, probes, margin), "cell long, row_id long, role byte, vec binary")
    found = cells.groupBy("cell").applyInArrow(_searched(index, k, rerank, probes, part_rows), "a long, b long, sim float")

    def top(df: DataFrame, key: str, n: int) -> DataFrame:
        w = Window.partitionBy(key).orderBy(F.desc("sim"), "b")
        return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)

    found = top(found, "a", k).drop("rank")
    # Copies: a class's smallest ids stand for it, k + 1 of them, so that each member still finds k others.
    small = top(members.select(F.col("rep").alias("a"), F.col("row_id").alias("b"), F.lit(0.0).alias("sim")), "a", k + 1).select(F.col("a").alias("rep"), F.col("b").alias("copy"))
    to_class = found.join(small, found.b == small.rep, "left").select("a", F.coalesce("copy", "b").alias("b"), "sim")
    doubles = members.where("row_id <> rep")
    for_copies = to_class.join(doubles, to_class.a == doubles.rep).select(F.col("row_id").alias("a"), "b", "sim")
    inside = members.join(small, "rep").where("row_id <> copy").select(F.col("row_id").alias("a"), F.col("copy").alias("b"), F.lit(1.0).cast("float").alias("sim"))
    out = top(to_class.unionByName(for_copies).unionByName(inside), "a", k)
    return out.select(F.col("a").alias("row_id"), F.col("b").alias("other_id"), F.round(F.col("sim").cast("double"), 6).alias("similarity"), "rank")


def close_pairs(neighbours: DataFrame, least: float = 0.85) -> DataFrame:
    """Pairs (row_a < row_b) at cosine ``least`` or more where one is among the most similar of the other."""
    pairs = neighbours.where(F.col("similarity") >= least)
    return pairs.select(F.least("row_id", "other_id").alias("row_a"), F.greatest("row_id", "other_id").alias("row_b")).distinct()


def recall(neighbours: DataFrame, vectors: DataFrame, reached_from: DataFrame | None = None, k: int = 5, queries: int = 2_000) -> DataFrame:
    """How many of the exact ``k`` most similar of at most ``queries`` vectors, picked by a hash of their id, ``neighbours`` has: n_queries, n_exact, n_found, recall.

    A neighbour as similar as the k-th (to 6 places) counts as found, whichever of equals it is.
    """
    held = usable_vectors(vectors, reached_from, dim=usual_size(vectors))
    asked = held.where(F.pmod(F.xxhash64("row_id", F.lit(23)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, queries / max(1, held.count()))))
    table = asked.select("row_id", "vec").limit(queries + queries // 4).toArrow()
    ids, q = table.column("row_id").to_numpy(), matrix(table.column("vec"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            other, x = b.column("row_id").to_numpy(), matrix(b.column("vec"))
            if not len(other) or not len(ids):
                continue
            sim = q @ x.T
            sim[ids[:, None] == other] = -2
            top = np.argpartition(-sim, min(k, len(other)) - 1, axis=1)[:, :k]
            best = np.take_along_axis(sim, top, 1)
            who = np.repeat(ids, top.shape[1])[(best > -2).ravel()]
            yield pa.record_batch([pa.array(who), pa.array(best[best > -2].astype(np.float64))], names=["row_id", "sim"])

    ranked = held.select("row_id", "vec").mapInArrow(near, "row_id long, sim double").withColumn("i", F.row_number().over(Window.partitionBy("row_id").orderBy(F.desc("sim"))))
    exact = ranked.where(F.col("i") <= k).groupBy("row_id").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("least"))
    found = neighbours.join(exact, "row_id").where(F.col("similarity") >= F.col("least") - 1e-6).groupBy("row_id").agg(F.count(F.lit(1)).alias("hit"))
    both = exact.join(found, "row_id", "left").select("n", F.least("n", F.coalesce("hit", F.lit(0))).alias("hit"))
    return both.agg(F.count(F.lit(1)).alias("n_queries"), F.sum("n").alias("n_exact"), F.sum("hit").alias("n_found"), F.round(F.sum("hit") / F.sum("n"), 4).alias("recall"))
