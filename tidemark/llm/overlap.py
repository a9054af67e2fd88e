"""Same or nearly the same texts across splits (problem 6): weighted join over inverted lists of word vectors.

A text is a vector over words, each weighted by how often it occurs. Every change, addition or drop costs the longer of two
texts at most one of its words, so with at most a share e of the longer one's m words edited the two have a dot product (of
the lesser counts) of (1 - e) m at least: the threshold of a pair follows from the edit rule and the pair's sizes alone,
whatever the corpus. Words stand in one global order, rarest first. A list entry carries the residual weight of its text
from that word on, and two texts whose residuals can't reach the threshold any more at the first word they share need no
look: only these leading words are listed, and of them those that both sides have. (An edited word that occurs nowhere else
takes its place among the words that may differ, but can hide nothing.) Then bitmaps of the texts' words, which entries
carry along, bound the dot product from above before any text is fetched. Exact dot products and word edits decide; the
cosine under inverse document frequencies is given with each link. Texts alike but for formatting are one text throughout,
so a text with very many copies is joined once, and words that very many texts list are cut into a grid of blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.letters import Grams, Letters, words
from tidemark.llm.sieve import bitmap, slot
from tidemark.session import staged

SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS  # bound of the document frequency table, whatever the vocabulary: words that share a slot share its frequency, in the order and the idf
BLOCK_ROWS = 20_000  # entries of a word's list on either side that meet in one task


SLACK = 1e-6  # of products with a share of words, against rounding
BITS = ("b0", "b1", "b2", "b3")  # 64 bits each of a text's terms; where longer texts set most of them, the bound gets looser, not wrong


def _keyed(wanted: np.ndarray):
    packed = np.packbits(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(packed).astype(bool)
        for b in batches:
            b = b.filter(pa.array(bits[b.column("slot").to_numpy()]))
            said = [" ".join(words(t)) for t in b.column("text").to_pylist()]
            keys = pa.array([hashlib.md5(s.encode()).digest() for s in said], pa.binary())
            yield pa.record_batch([b.column("id"), b.column("via"), keys, pa.array(said, pa.string())], names=["id", "via", "key", "words"])

    return run


def _kept(wanted: np.ndarray):
    packed = np.packbits(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(packed).astype(bool)
        for b in batches:
            yield b.filter(pa.array(bits[b.column("slot").to_numpy()])).select(["doc", "words"])

    return run


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number in the batch, 64-bit hash of the word, times it occurs), each pair once, ordered by document."""
    letters, grams = Letters(texts), Grams()
    at, h = grams.of_words(letters, 1, grams.sums(letters))
    doc = letters.owner[letters.starts[at]].astype(np.int64)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.zeros(0, np.int64)
    return doc[first], h[first], np.diff(np.append(first, len(h)))


class Weights:
    """Inverse document frequencies by slot of the word's hash, and in which splits a slot occurs at all."""

    def __init__(self, texts: DataFrame):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros((2, SLOTS), np.int64)
            n = 0
            for b in batches:
                doc, h, _ = _terms(b.column("words").to_pylist())
                at = _slots(h)
                for side, column in enumerate(("in_fit", "in_eval")):
                    held[side] += np.bincount(at[b.column(column).to_numpy(zero_copy_only=False)[doc]], minlength=SLOTS)
                both = (b.column("in_fit").to_numpy(zero_copy_only=False) & b.column("in_eval").to_numpy(zero_copy_only=False)).sum()
                n += b.num_rows + int(both)
            at = np.flatnonzero(held.any(0))
            yield pa.record_batch([pa.array(np.append(at, -1)), pa.array(np.append(held[0, at], n)), pa.array(np.append(held[1, at], 0))], names=["term", "fit", "held_out"])

        # At most SLOTS rows of three numbers come to the driver.
        got = texts.mapInArrow(count, "term long, fit long, held_out long").groupBy("term").agg(F.sum("fit").alias("fit"), F.sum("held_out").alias("held_out")).toPandas()
        n = int(got.fit[got.term < 0].sum())
        got = got[got.term >= 0]
        df = np.zeros(SLOTS, np.int64)
        df[got.term] = got.fit + got.held_out
        self.idf = np.where(df > 0, np.log1p(n / np.maximum(df, 1)), 0).astype(np.float32)
        self.shared = np.zeros(SLOTS, bool)
        self.shared[got.term] = (got.fit > 0) & (got.held_out > 0)


_POSTING = "term long, doc long, in_fit boolean, in_eval boolean, n_words int, residual int, " + ", ".join(f"{x} long" for x in BITS)


def _postings(weights: Weights, edits: float):
    names = ["term", "doc", "in_fit", "in_eval", "n_words", "residual", *BITS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, h, times = _terms(b.column("words").to_pylist())
            if not len(doc):
                continue
            at = _slots(h)
            order = np.lexsort((h, -weights.idf[at], doc))  # rarest first, ties by hash: the same order for all texts
            doc, h, at, times = doc[order], h[order], at[order], times[order]
            n_words = np.bincount(doc, times, minlength=b.num_rows).astype(np.int64)
            residual = np.cumsum(n_words)[doc] - np.cumsum(times) + times  # words from here on
            use = (n_words[doc] - residual <= edits * n_words[doc] + SLACK) & weights.shared[at]
            bits = np.zeros((len(BITS), b.num_rows), np.uint64)
            place = (h >> np.uint64(7)) % np.uint64(64 * len(BITS))
            np.bitwise_or.at(bits, ((place // np.uint64(64)).astype(np.int64), doc), np.uint64(1) << (place % np.uint64(64)))
            bits = bits.view(np.int64)
            of, h, residual = doc[use], h[use].view(np.int64), residual[use].astype(np.int32)
            for a in range(0, len(of), 8192):
                part = of[a : a + 8192]
                rows = pa.array(part)
                yield pa.record_batch([pa.array(h[a : a + 8192]), *(b.column(c).take(rows) for c in ("doc", "in_fit", "in_eval")), pa.array(n_words[part].astype(np.int32)), pa.array(residual[a : a + 8192]), *(pa.array(x[part]) for x in bits)], names=names)

    return run


def blocked(listed: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Held-out and fit entries with a cell (term, i, j), so that those of a term meet in one cell each, of at most about ``block_rows`` entries of either side."""
    sizes = listed.groupBy("term").agg(F.count_if("in_eval").alias("p"), F.count_if("in_fit").alias("q")).where((F.col("p") > 0) & (F.col("q") > 0))
    hot = sizes.where(F.greatest("p", "q") > block_rows).select("term", F.ceil(F.col("p") / block_rows).cast("long").alias("gp"), F.ceil(F.col("q") / block_rows).cast("long").alias("gq"))
    hot = staged(hot)
    few = hot.count() <= 100_000  # terms of long lists, at most a row per ``block_rows`` entries
    all_ = listed.join(F.broadcast(hot) if few else hot, "term", "left")
    mine = lambda g: F.pmod(F.xxhash64("doc"), F.coalesce(F.col(g), F.lit(1).cast("long")))
    others = lambda g: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(g), F.lit(1)) - 1))
    p = all_.where("in_eval").withColumn("i", mine("gp")).withColumn("j", others("gq"))
    q = all_.where("in_fit").withColumn("j", mine("gq")).withColumn("i", others("gp"))
    return p, q


def word_edits(a: list[str], b: list[str]) -> int:
    """Words to change, add or drop to turn ``a`` into ``b``: bit-parallel columns of the alignment matrix."""
    if not a:
        return len(b)
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for w in b:
        eq = at.get(w, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        rise, fall = down | (full & ~(diagonal | up)), up & diagonal
        score += bool(rise & top) - bool(fall & top)
        rise, fall = (rise << 1 | 1) & full, (fall << 1) & full
        up, down = fall | (full & ~(diagonal | rise)), rise & diagonal
    return score


def _decided(weights: Weights, edits: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square = weights.idf.astype(np.float64) ** 2
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                b = batch.slice(a, 2048)
                doc, other = b.column("doc").to_pylist(), b.column("other").to_pylist()
                said = dict(zip(doc, b.column("words").to_pylist())) | dict(zip(other, b.column("other_words").to_pylist()))
                at, h, times = _terms(list(said.values()))
                ends = np.searchsorted(at, np.arange(len(said) + 1))
                vector = {d: (h[x:y], times[x:y], int(times[x:y].sum())) for d, x, y in zip(said, ends[:-1], ends[1:])}
                split: dict[int, list[str]] = {}
                keep, cosines = [], []
                for i, (x, y) in enumerate(zip(doc, other)):
                    (u, m, p), (v, n, q) = vector[x], vector[y]
                    same, of_u, of_v = np.intersect1d(u, v, assume_unique=True, return_indices=True)
                    most = edits * max(p, q) + SLACK
                    if max(p, q) - np.minimum(m[of_u], n[of_v]).sum() > most:  # the dot product
                        continue
                    for d in (x, y):
                        if d not in split:
                            split[d] = said[d].split()
                    if word_edits(split[x], split[y]) <= most:
                        norm = (square[_slots(u)].sum() * square[_slots(v)].sum()) ** 0.5
                        keep.append(i), cosines.append(float(square[_slots(same)].sum() / (norm or 1.0)))
                rows = pa.array(keep, pa.int64())
                yield pa.record_batch([b.column("doc").take(rows), b.column("other").take(rows), pa.array(cosines, pa.float64())], names=["doc", "other", "cosine"])

    return run


def split_overlaps(manifest: DataFrame, texts: DataFrame, edits: float = 0.1, fit: str = "fit", held_out: tuple[str, ...] = ("calibration", "validation"), block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts of held-out splits that also stand, exactly or almost, in the fit split.

    Returns ``members`` (id, split, via, key), one row per complaint, split and submitted_via, the ``texts`` (key, doc,
    words, in_fit, in_eval) and the ``links`` (doc, other, cosine) between different texts: ``doc`` of a held-out text,
    ``other`` of a fit text, at most ``edits`` of the longer one's words changed, added or dropped. No such pair is lost,
    however rare the edited words are and however low the weighted ``cosine`` is. A text on both sides needs no link.

    Null ids, narratives and splits, other splits, and ids that ``texts`` lacks take no part; repeated rows count once;
    a text without letters or digits matches its like only; empty tables give empty results.
    """
    ids = manifest.where(F.col("sample_split").isin(fit, *held_out) & F.col("complaint_id").isNotNull()).select(F.col("complaint_id").alias("id"), F.col("sample_split").alias("split")).distinct()
    said = texts.where("complaint_id IS NOT NULL AND narrative IS NOT NULL").select(F.col("complaint_id").alias("id"), F.col("submitted_via").alias("via"), slot(F.col("complaint_id")).alias("slot"), F.col("narrative").alias("text"))
    # Texts are written once, straight from the scan; what follows moves their ids until one text per key is left.
    rows = staged(said.mapInArrow(_keyed(bitmap(ids, "id")), "id string, via string, key binary, words string").withColumn("rid", F.monotonically_increasing_id()))
    members = rows.select("id", "via", "key", "rid").join(ids, "id")
    sides = members.groupBy("key").agg(F.max(F.col("split") == fit).alias("in_fit"), F.max(F.col("split") != fit).alias("in_eval"), F.min("rid").alias("doc"))
    docs = staged(sides.join(rows.select(F.col("rid").alias("doc"), "words"), "doc"))
    weights = Weights(docs)
    listed = staged(docs.mapInArrow(_postings(weights, edits), _POSTING))
    p, q = (side.alias(name) for side, name in zip(blocked(listed, block_rows), "pq"))
    same = (1 - edits) * F.greatest("p.n_words", "q.n_words") - SLACK  # the dot product that both texts must reach
    size = F.least("p.n_words", "q.n_words") >= same
    first = (F.col("p.residual") >= same) & (F.col("q.residual") >= same)
    lone = lambda x, y: sum(F.bit_count(F.col(f"{x}.{b}").bitwiseAND(F.bitwise_not(f"{y}.{b}"))) for b in BITS)
    bound = (F.col("p.n_words") - lone("p", "q") >= same) & (F.col("q.n_words") - lone("q", "p") >= same)
    cell = (F.col("p.term") == F.col("q.term")) & (F.col("p.i") == F.col("q.i")) & (F.col("p.j") == F.col("q.j"))
    pairs = p.join(q, cell & size & first & (F.col("p.doc") != F.col("q.doc")) & bound)
    pairs = staged(pairs.select(F.col("p.doc").alias("doc"), F.col("q.doc").alias("other")).distinct())
    seen = bitmap(pairs.select("doc").union(pairs.select("other")), "doc")
    said = docs.select("doc", "words", slot(F.col("doc")).alias("slot")).mapInArrow(_kept(seen), "doc long, words string")
    full = pairs.join(said, "doc").join(said.select(F.col("doc").alias("other"), F.col("words").alias("other_words")), "other")
    links = full.select("doc", "other", "words", "other_words").mapInArrow(_decided(weights, edits), "doc long, other long, cosine double")
    return members.select("id", "split", "via", "key").distinct(), docs, links


def overlapping(members: DataFrame, docs: DataFrame, links: DataFrame, fit: str = "fit") -> DataFrame:
    """One row per held-out complaint, split and submitted_via that stands in the fit split: id, split, via, key, is_exact, n_links (other fit texts)."""
    n = links.groupBy("doc").agg(F.count(F.lit(1)).alias("n_links")).join(docs.select("doc", "key"), "doc").select("key", "n_links")
    both = docs.where("in_fit AND in_eval").select("key", F.lit(True).alias("is_exact"))
    hit = n.join(both, "key", "full").select("key", F.coalesce("is_exact", F.lit(False)).alias("is_exact"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return members.where(F.col("split") != fit).join(hit, "key").select("id", "split", "via", "key", "is_exact", "n_links")


def overlap_report(members: DataFrame, docs: DataFrame, links: DataFrame, fit: str = "fit") -> DataFrame:
    """Counts per held-out split and submitted_via (null is a value): complaints, those overlapping, exactly and almost only."""
    hit = overlapping(members, docs, links, fit).select("id", "split", "via", "is_exact", F.lit(True).alias("hit")).distinct()
    rows = members.where(F.col("split") != fit).select("id", "split", "via").distinct()
    joined = rows.join(hit.withColumnRenamed("via", "_via"), (rows.id == hit.id) & (rows.split == hit.split) & rows.via.eqNullSafe(F.col("_via")), "left").select(rows.id, rows.split, rows.via, "is_exact", "hit")
    one = joined.groupBy("id", "split", "via").agg(F.max("hit").alias("hit"), F.max("is_exact").alias("exact"))
    return one.groupBy(F.col("split").alias("sample_split"), F.col("via").alias("submitted_via")).agg(F.count(F.lit(1)).alias("n_complaints"), F.count_if("hit").alias("n_overlapping"), F.count_if("exact").alias("n_exact"), F.count_if(F.col("hit") & ~F.col("exact")).alias("n_almost"))
