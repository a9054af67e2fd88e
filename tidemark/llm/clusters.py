"""Similarity clusters of vectors (problem 5): cluster-feature trees, tree-reduced, Ward agglomeration, one assignment pass.

Every partition builds a cluster-feature tree over its unit vectors; a leaf entry is a mergeable summary (count, linear
sum), a vector joins the nearest entry if its cosine with the entry's direction reaches the tree's threshold, and a tree
that outgrows its bound is rebuilt: where most of it are potential outliers, with these set aside in a coarser tree, else
with a lower threshold. Leaf summaries of neighbouring partitions, those set aside included, are merged in rounds of bounded
fan-in, so that a cluster of which every partition has a few rows only comes together. The last round's entries, at most
twice ``max_leaves``, are agglomerated by Ward's criterion on the driver, and one pass over all rows assigns each to the
nearest centre.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.vectors import matrix, usable_vectors, usual_size
from tidemark.session import staged


STRAY = 3.0  # entries of less weight are potential outliers: fewer than five vectors that are much alike, or very many that are not


def weight(n: np.ndarray, s: np.ndarray) -> np.ndarray:
    """How far an entry is more than chance: squared length of its sum over its count, 1 for one vector and about 1 for vectors of unlike directions, 1 + (n - 1) c for n vectors of mean cosine c with each other."""
    return (s * s).sum(1) / np.maximum(n, 1)


class FeatureTree:
    """A cluster-feature tree over directions: entries (n, linear sum) in leaves, nodes of bounded width above them."""

    def __init__(self, dim: int, threshold: float = 0.5, max_leaves: int = 1024, width: int = 32, outliers: bool = True):
        self.dim, self.threshold, self.max_leaves, self.width = dim, threshold, max_leaves, width
        #: Entries set aside, in a tree that is coarser and sets nothing aside itself.
        self.aside = FeatureTree(dim, threshold - 0.1, max_leaves, width, False) if outliers else None
        self._clear()

    def _clear(self) -> None:
        self.root, self.size = self._node(leaf=True), 0

    def _node(self, leaf: bool) -> dict:
        return {"leaf": leaf, "k": 0, "n": np.zeros(self.width + 1), "sum": np.zeros((self.width + 1, self.dim)), "dir": np.zeros((self.width + 1, self.dim)), "down": []}

    @staticmethod
    def _add(node: dict, i: int, n: float, s: np.ndarray) -> None:
        node["n"][i] += n
        node["sum"][i] += s
        node["dir"][i] = node["sum"][i] / max(math.sqrt(node["sum"][i] @ node["sum"][i]), 1e-12)

    def _append(self, node: dict, n: float, s: np.ndarray, down: dict | None = None) -> None:
        i = node["k"]
        node["k"] += 1
        node["n"][i] = 0
        node["sum"][i] = 0
        self._add(node, i, n, s)
        if not node["leaf"]:
            node["down"].append(down)

    def extend(self, x: np.ndarray, first: int = 64, most: int = 1024) -> None:
        """Add unit vectors, block by block: those that an entry takes at once, the others one by one."""
        at, size = 0, first if not self.size else most
        while at < len(x):
            for v in x[at : at + size][self._absorbed(self.root, x[at : at + size])[2]]:
                self.insert(1.0, v)
            at, size = at + size, min(most, 2 * size)

    def _absorbed(self, node: dict, x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """Adds the vectors that a leaf entry below ``node`` takes: how many, their sum, and which are left."""
        if not node["k"]:
            return 0, np.zeros(self.dim), np.ones(len(x), bool)
        score = x @ node["dir"][: node["k"]].T
        to, left, count, total = score.argmax(1), np.zeros(len(x), bool), 0, np.zeros(self.dim)
        if node["leaf"]:
            left = score[np.arange(len(x)), to] < self.threshold
        for i in np.unique(to if not node["leaf"] else to[~left]):
            rows = np.flatnonzero((to == i) & ~left)
            if node["leaf"]:
                n, s = len(rows), x[rows].sum(0)
            else:
                n, s, rest = self._absorbed(node["down"][i], x[rows])
                left[rows] = rest
            if n:
                self._add(node, i, n, s)
                count, total = count + n, total + s
        return count, total, left

    def insert(self, n: float, s: np.ndarray) -> None:
        """Add ``n`` vectors with the sum ``s``."""
        unit = s / max(math.sqrt(s @ s), 1e-12)
        path, node = [], self.root
        while not node["leaf"]:
            i = int((node["dir"][: node["k"]] @ unit).argmax())
            path.append((node, i))
            node = node["down"][i]
        if node["k"]:
            score = node["dir"][: node["k"]] @ unit
            i = int(score.argmax())
        if node["k"] and score[i] >= self.threshold:
            self._add(node, i, n, s)
        else:
            self._append(node, n, s)
            self.size += 1
        for up, i in path:
            self._add(up, i, n, s)
        while node["k"] > self.width:
            other = self._split(node)
            if path:
                up, i = path.pop()
            else:
                up, i = self._node(leaf=False), 0
                self._append(up, node["n"][: node["k"]].sum(), node["sum"][: node["k"]].sum(0), node)
                self.root = up
            up["n"][i], up["sum"][i] = 0, 0
            self._add(up, i, node["n"][: node["k"]].sum(), node["sum"][: node["k"]].sum(0))
            self._append(up, other["n"][: other["k"]].sum(), other["sum"][: other["k"]].sum(0), other)
            node = up
        if self.size > self.max_leaves:
            self._rebuild()

    def _split(self, node: dict) -> dict:
        """Move the half of ``node`` that lies nearer to the second of its two least alike entries to a new node."""
        k, d = node["k"], node["dir"][: node["k"]]
        a, b = divmod(int((d @ d.T).argmin()), k)
        go = (d @ d[b] > d @ d[a]) | (np.arange(k) == b)
        go[a] = False
        other, keep = self._node(node["leaf"]), self._node(node["leaf"])
        for i in range(k):
            self._append(other if go[i] else keep, node["n"][i], node["sum"][i], None if node["leaf"] else node["down"][i])
        node.update(keep)
        return other

    def _rebuild(self) -> None:
        n, s = self.entries(aside=False)
        stray = weight(n, s) < STRAY
        if self.aside is not None and stray.sum() >= self.max_leaves // 2:
            for i in np.flatnonzero(stray):
                self.aside.insert(n[i], s[i])
            n, s = n[~stray], s[~stray]
        else:
            self.threshold -= 0.05
        self._clear()
        for i in np.argsort(-n, kind="stable"):
            self.insert(n[i], s[i])

    def entries(self, aside: bool = True) -> tuple[np.ndarray, np.ndarray]:
        n, s, todo = [], [], [self.root] + ([self.aside.root] if aside and self.aside is not None else [])
        while todo:
            node = todo.pop()
            if node["leaf"]:
                n.append(node["n"][: node["k"]]), s.append(node["sum"][: node["k"]])
            else:
                todo += node["down"]
        return np.concatenate(n), np.concatenate(s)


_LEAVES = pa.schema([("node", pa.int64()), ("n", pa.float64()), ("threshold", pa.float64()), ("s", pa.list_(pa.float64()))])


def _leaf_table(node: int, tree: FeatureTree | None) -> pa.Table:
    if tree is None:
        return _LEAVES.empty_table()
    n, s = tree.entries()
    return pa.table([pa.array(np.full(len(n), node)), pa.array(n), pa.array(np.full(len(n), tree.threshold)), pa.array(list(s), pa.list_(pa.float64()))], schema=_LEAVES)


def leaf_summaries(held: DataFrame, threshold: float, max_leaves: int, fan_in: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and linear sums of at most twice ``max_leaves`` entries that sum up all rows of ``held`` (row_id, vec)."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tree = None
        for batch in batches:
            x = matrix(batch.column("vec")).astype(np.float64)
            if tree is None and len(x):
                tree = FeatureTree(x.shape[1], threshold, max_leaves)
            if len(x):
                tree.extend(x)
        yield from _leaf_table(TaskContext.get().partitionId(), tree).to_batches()

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        n, s = table.column("n").to_numpy(), np.stack(table.column("s").to_numpy(zero_copy_only=False))
        tree = FeatureTree(s.shape[1], float(np.min(table.column("threshold").to_numpy())), max_leaves)
        order = np.lexsort((*s.T[:3], -n))
        for i in order:
            tree.insert(n[i], s[i])
        return _leaf_table(key[0].as_py(), tree)

    schema = "node long, n double, threshold double, s array<double>"
    out = staged(held.select("vec").mapInArrow(local, schema))  # the rounds below start from written summaries, not from a second tree building
    top = out.agg(F.max("node")).first()[0]
    while top:
        top //= fan_in
        up = F.floor(F.col("node") / F.lit(fan_in)).alias("node")
        out = out.select(up, "n", "threshold", "s").groupBy("node").applyInArrow(merge, schema)
    table = out.toArrow()
    if not table.num_rows:
        return np.zeros(0), np.zeros((0, 1))
    return table.column("n").to_numpy(), np.stack(table.column("s").to_numpy(zero_copy_only=False))


def ward(n: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Labels 0..k-1 of the entries after merging, again and again, the two whose union adds the least variance."""
    n, c = n.astype(float).copy(), s / n[:, None]
    label, alive = np.arange(len(n)), np.ones(len(n), bool)
    d2 = np.maximum(0, (c * c).sum(1)[:, None] + (c * c).sum(1) - 2 * c @ c.T)
    cost = d2 * (n[:, None] * n) / (n[:, None] + n)
    np.fill_diagonal(cost, np.inf)
    best = cost.argmin(1)
    low = cost[np.arange(len(n)), best]
    for _ in range(max(0, len(n) - k)):
        i = int(np.where(alive, low, np.inf).argmin())
        j = int(best[i])
        c[i] = (n[i] * c[i] + n[j] * c[j]) / (n[i] + n[j])
        n[i] += n[j]
        alive[j] = False
        label[label == j] = i
        row = np.where(alive, ((c - c[i]) ** 2).sum(1) * n * n[i] / (n + n[i]), np.inf)
        row[i] = np.inf
        cost[i], cost[:, i], cost[j], cost[:, j] = row, row, np.inf, np.inf
        best[i], low[i] = int(row.argmin()), row.min()
        stale = np.flatnonzero(alive & ((best == i) | (best == j)))
        for t in stale:
            best[t] = int(cost[t].argmin())
            low[t] = cost[t, best[t]]
        better = alive & (row < low)
        best[better], low[better] = i, row[better]
    return np.unique(label, return_inverse=True)[1]


def fit_centres(held: DataFrame, k: int, threshold: float = 0.3, max_leaves: int = 1024, fan_in: int = 8) -> np.ndarray:
    """``k`` unit centres (fewer only where there are fewer than ``k`` vectors that differ by more than a cosine of 0.99).

    The trees have room for eight entries a cluster at least, and where they come out with fewer entries than clusters they
    are built again with a higher threshold. Entries of less weight than ``STRAY`` are potential outliers: while enough others
    are left they don't take part in the agglomeration, but their rows are assigned like all others.
    """
    max_leaves = max(max_leaves, 8 * k)
    n, s = leaf_summaries(held, threshold, max_leaves, fan_in)
    while len(n) and len(n) < k and threshold < 0.99:
        threshold = min(0.99, threshold + 0.2)
        n, s = leaf_summaries(held, threshold, max_leaves, fan_in)
    if not len(n):
        return np.zeros((0, 1))
    dense = weight(n, s) >= STRAY
    if dense.sum() >= k:
        n, s = n[dense], s[dense]
    label = ward(n, s, k)
    c = np.stack([s[label == j].sum(0) for j in range(label.max() + 1)])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def _nearest(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("vec"))
            score = x @ centres.T.astype(np.float32) if len(x) else np.zeros((0, 1))
            at = score.argmax(1)
            yield pa.record_batch([batch.column("row_id"), pa.array(at.astype(np.int32)), pa.array(score[np.arange(len(x)), at].astype(np.float64)), pa.array(list(x), pa.list_(pa.float32()))], names=["row_id", "part", "cosine", "vec"])

    return run


def _sums(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x, at = matrix(batch.column("vec")), batch.column("part").to_numpy()
            for j in np.unique(at):
                total[int(j)] = total.get(int(j), np.zeros(dim)) + x[at == j].sum(0, dtype=np.float64)
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["part", "s"])

    return run


def assigned(vectors: DataFrame, k: int, **fit) -> DataFrame:
    """Every usable vector with its cluster: row_id, part (0..k-1), cosine with the centre, the mean direction of the members.

    Null, all-zero and non-finite vectors, and those of another length than most, take no part; a repeated row counts once; an empty table gives no rows; with
    fewer distinct vectors than ``k`` there are fewer clusters. Ties go to the lower cluster number.
    """
    held = staged(usable_vectors(vectors, dim=usual_size(vectors)))
    centres = fit_centres(held, k, **fit)
    schema = "row_id long, part int, cosine double, vec array<float>"
    if not len(centres):
        return vectors.sparkSession.createDataFrame([], "row_id long, part int, cosine double")
    first = staged(held.select("row_id", "vec").mapInArrow(_nearest(centres), schema))
    dim = centres.shape[1]
    sums = first.select("part", "vec").mapInArrow(_sums(dim), "part int, s array<double>")
    # k rows of dim numbers each come to the driver.
    sums = sums.select("part", F.posexplode("s").alias("i", "v")).groupBy("part", "i").agg(F.sum("v").alias("v")).toPandas()
    means = np.zeros_like(centres)
    means[sums.part, sums.i] = sums.v
    means /= np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = matrix(batch.column("vec")), batch.column("part").to_numpy()
            yield pa.record_batch([batch.column("row_id"), batch.column("part"), pa.array(np.einsum("nd,nd->n", x.astype(np.float64), means[at]))], names=["row_id", "part", "cosine"])

    return first.select("row_id", "part", "vec").mapInArrow(final, "row_id long, part int, cosine double")


def named(members: DataFrame, summary: DataFrame) -> DataFrame:
    """``members`` with the cluster_id of the summary row whose typical_row lies in the cluster (the smallest of several, null if none).

    The table of names has at most one row per cluster, as many as ``summary`` has.
    """
    seat = summary.where(F.col("typical_row").isNotNull()).select(F.col("typical_row").cast("long").alias("row_id"), F.col("cluster_id").cast("long").alias("cluster_id"))
    names = members.join(seat, "row_id").groupBy("part").agg(F.min("cluster_id").alias("cluster_id"))
    return members.join(F.broadcast(names), "part", "left")


def cluster_members(vectors: DataFrame, summary: DataFrame, **fit) -> DataFrame:
    """Every usable vector with its cluster, as many clusters as ``summary`` has rows: row_id, part, cosine, cluster_id."""
    return named(assigned(vectors, max(1, summary.count()), **fit), summary)


def near_members(members: DataFrame, least: float = 0.45) -> DataFrame:
    """Members whose cosine with their named cluster's centre is ``least`` or more: embedding_row, cluster_id."""
    return members.where((F.col("cosine") >= least) & F.col("cluster_id").isNotNull()).select(F.col("row_id").alias("embedding_row"), "cluster_id")


def described(members: DataFrame, manifest: DataFrame, texts: DataFrame, typical: int = 5, terms: int = 5, least: float = 0.45) -> DataFrame:
    """One row per cluster: part, cluster_id, fit_rows, median_cosine, typical_rows (nearest the centre first), representative_terms.

    Terms are the word pairs of the members' narratives with the highest class weight: share of the cluster's pairs times
    ln(1 + mean pairs per cluster / pairs of this kind in all clusters), members below ``least`` not counted. Narratives
    are those of the complaints that ``manifest`` gives the embedding_row; rows without one add no terms. Ties go to the
    smaller row or term.
    """
    sizes = members.groupBy("part", "cluster_id").agg(F.count(F.lit(1)).alias("fit_rows"), F.round(F.percentile_approx("cosine", 0.5), 6).alias("median_cosine"))
    near = Window.partitionBy("part").orderBy(F.desc("cosine"), "row_id")
    top = members.withColumn("_i", F.row_number().over(near)).where(F.col("_i") <= typical)
    top = top.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("_i", "row_id"))).alias("t")).select("part", F.col("t.row_id").alias("typical_rows"))
    ids = manifest.select("complaint_id", F.col("embedding_row").cast("long").alias("row_id")).where("row_id IS NOT NULL AND complaint_id IS NOT NULL").distinct()
    mine = members.where(F.col("cosine") >= least).select("row_id", "part").join(ids, "row_id").select("complaint_id", "part").distinct()
    text = texts.where("narrative IS NOT NULL AND complaint_id IS NOT NULL").select("complaint_id", "narrative").distinct().join(mine, "complaint_id")
    words = F.expr("filter(split(lower(narrative), '[^\\\\p{L}\\']+'), w -> length(w) > 1)")
    pairs = F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1)))
    grams = text.select("part", words.alias("w")).where("size(w) > 1").select("part", F.explode(pairs).alias("term"))
    n = grams.groupBy("part", "term").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("term").agg(F.sum("n").alias("all_n"))
    size = n.groupBy("part").agg(F.sum("n").alias("size"))
    mean = size.agg(F.avg("size").alias("mean_size"))
    weight = (F.col("n") / F.col("size")) * F.log1p(F.col("mean_size") / F.col("all_n"))
    scored = n.join(total, "term").join(F.broadcast(size), "part").join(F.broadcast(mean)).select("part", "term", weight.alias("weight"))
    best = Window.partitionBy("part").orderBy(F.desc("weight"), "term")
    scored = scored.withColumn("_i", F.row_number().over(best)).where(F.col("_i") <= terms)
    said = scored.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("_i", "term"))).alias("t")).select("part", F.array_join("t.term", ", ").alias("representative_terms"))
    return sizes.join(top, "part", "left").join(said, "part", "left")
