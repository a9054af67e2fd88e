"""Evaluation passages inside training texts (problem 7): q-gram lemma filtering in diagonal bands, banded alignment.

The q-grams are of variable length, the letters and digits of ``q`` successive words, one where each word begins. An edit of
a word spoils the q-grams that reach it, at most q; a stretch's end spoils q - 1. So of a stretch of s passage words with at
most one edit in ``edit_every``, at most q s / edit_every + q - 1 are missing in the text. That bounds from below how many
a text shares with a passage that it holds in part, and from above how far a stretch reaches beyond shared q-grams.

1. One scan of the texts, however many passages there are. Shared q-grams are counted per text and passage, then in
   overlapping bands of diagonals (text word minus passage word, so that an edit shifts a stretch by one at most).
2. Bands whose q-grams can't make up the share, together with those of another band, are dropped; the others are aligned
   word by word within the band.

While the passages' q-grams are few (``small_rows``) every task of the scan has them all. Beyond that, a bitmap of bounded
size picks each text's q-grams that may be a passage's, texts and passages meet in a join on the q-gram, and steps 1 and 2
follow for the pairs that share enough. In that join the q-grams of each passage that most texts have are set aside, as
many as leave half of the bound, and a text must have the other half among the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.letters import Grams, Letters, words
from tidemark.llm.sieve import FewestBits, may_hold
from tidemark.session import staged

LADDER = (4, 3, 2, 1)  # q to choose from
SMALL_ROWS = 1_000_000  # q-grams of an index (20 bytes each) that every task may hold


class Rule:
    """What counts as a leak: ``share`` of the passage's words, stretches of ``shortest`` words or more with an edit in ``edit_every``."""

    def __init__(self, share: float, edit_every: int, shortest: int):
        self.share, self.edit_every, self.shortest = share, edit_every, shortest

    def need(self, n: int) -> int:
        return max(1, int(np.ceil(self.share * n - 1e-9)))

    def least(self, n: int, q: int) -> int:
        """q-grams that a text with ``need`` of n words must share: the fewest over stretches of just so many words and up to ``edit_every`` more."""
        need = self.need(n)
        ends = 2 if need >= 2 * self.shortest else 1
        return min(s - s // self.edit_every * q for s in range(need, need + self.edit_every)) - ends * (q - 1)

    def choose(self, n: int) -> tuple[int, int]:
        """(q, bound) for a passage of n words: the largest q with a bound of at least 1; q = 1 always has one, as some word is untouched."""
        q = next((q for q in LADDER if self.least(n, q) >= 1), 1)
        return q, max(1, self.least(n, q))


class Index:
    """The q-grams of some passages by hash, with their passage and word."""

    def __init__(self, ids: list[int], said: list[str], qs: list[int], least: list[int], rule: Rule):
        self.ids, self.words = ids, [s.split(" ") for s in said]
        self.q, self.least = np.array(qs, np.int64), np.array(least, np.int64)
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.need = np.array([rule.need(len(w)) for w in self.words], np.int64)
        self.width = self.size // rule.edit_every + 1
        # A stretch of s words shares c q-grams at least, where s <= reach(c). Of a stretch of half the share, ``half`` of
        # them in a row lie within ``span`` words: if it has c, c // half times as many words hold them all.
        self.every = rule.edit_every
        self.half = np.maximum(1, -(-(-(-self.need // 2) * (self.every - self.q)) // self.every) - self.q + 1)
        self.span = self.reach(2 * self.half - 1, np.arange(len(self.size)))
        letters, grams = Letters(said), Grams()
        sums, first = grams.sums(letters), np.concatenate([[0], np.cumsum(self.size)])
        self.qs, keys, item, word = np.unique(self.q).tolist(), [], [], []
        for q in self.qs:
            at, h = grams.of_words(letters, q, sums)
            of = letters.owner[letters.starts[at]]
            mine = self.q[of] == q
            keys.append(h[mine]), item.append(of[mine]), word.append((at - first[of])[mine])
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        self.keys, begin = np.unique(keys[order], return_index=True)
        self.begin = np.append(begin, len(keys))
        self.item, self.word = np.concatenate(item)[order].astype(np.int32), np.concatenate(word)[order].astype(np.int32)
        self.shift = np.uint64(64 - max(1, (4 * len(self.keys)).bit_length()))
        bits = 64 - int(self.shift)
        self.bucket = np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int64)
        self.padded = np.append(self.keys, np.uint64(0xFFFFFFFFFFFFFFFF))

    def reach(self, count: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Passage words at most of a stretch that shares ``count`` q-grams."""
        q = self.q[item]
        return np.where(q < self.every, (count + q - 1) * self.every // np.maximum(1, self.every - q), self.size[item])

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``h`` are in the index, their key's number)"""
        pos = self.bucket[h >> self.shift]
        key = self.padded[pos]
        while (later := key < h).any():
            pos = np.minimum(pos + later, len(self.keys))
            key = self.padded[pos]
        hit = np.flatnonzero((key == h) & (pos < len(self.keys)))
        return hit, pos[hit]


def _places(ws: list[str]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for j, w in enumerate(ws):
        out.setdefault(w, []).append(j)
    return out


def _path(item: list[str], places: dict[str, list[int]], i0: int, i1: int, low: int, high: int) -> list[tuple[int, int]]:
    """The matching words (passage position, text position) of the best local alignment of item[i0:i1] on diagonals low..high.

    A matching word scores 1, an edit -2. Runs of matches on a diagonal are chained, each to the best of those before it.
    """
    runs: list[list[int]] = []  # first passage position, diagonal, length
    last: dict[int, list[int]] = {}
    for i in range(i0, i1):
        for j in places.get(item[i], ()):
            d = j - i
            if low <= d <= high:
                run = last.get(d)
                if run and run[0] + run[2] == i:
                    run[2] += 1
                else:
                    last[d] = run = [i, d, 1]
                    runs.append(run)
    best, far = None, 0
    strong: list[tuple] = []  # (score, end, diagonal, start, run before) of runs that can pay for a gap
    for start, d, n in runs:
        score, cut, before, end = n, start, None, start + n
        for one in strong:
            shift = d - one[2]
            overlap = one[1] - start + (-shift if shift < 0 else 0)  # words that the run before has already, in passage or text
            got = one[0] + n - 2 * max(abs(shift), start - one[1] + (shift if shift > 0 else 0))
            if overlap > 0:
                got -= overlap
                if overlap >= n:
                    continue
            if got > score:
                score, cut, before = got, start + max(0, overlap), one
        one = (score, end, d, cut, before)
        if score > 2:
            strong.append(one)
        if score > far:
            best, far = one, score
    out: list[tuple[int, int]] = []
    while best:
        _, end, d, cut, before = best
        out += [(i, i + d) for i in range(end - 1, cut - 1, -1)]
        best = before
    return out[::-1]


def _stretches(path: list[tuple[int, int]], edit_every: int, shortest: int) -> list[tuple[int, int, int, int]]:
    """Stretches (passage start, end, text start, end) on a path of matches: the longest with at most one edit in ``edit_every`` passage words, then the longest in what is left to either side."""
    out, todo = [], [path]
    while todo:
        p = todo.pop()
        if len(p) < shortest:
            continue
        runs = [[0, 0]]  # of matches that follow each other: first and last position in p
        for k in range(1, len(p)):
            if p[k][0] - p[k - 1][0] == 1 and p[k][1] - p[k - 1][1] == 1:
                runs[-1][1] = k
            else:
                runs.append([k, k])
        best = None
        for x in range(len(runs)):
            edits = 0
            for y in range(x, len(runs)):
                if y > x:
                    (i, j), (i2, j2) = p[runs[y - 1][1]], p[runs[y][0]]
                    edits += max(i2 - i, j2 - j) - 1
                n = p[runs[y][1]][0] - p[runs[x][0]][0] + 1
                if edits * edit_every <= n and n >= shortest and (best is None or n > best[0]):
                    best = (n, runs[x][0], runs[y][1])
        if best is None:
            continue
        _, a, b = best
        out.append((p[a][0], p[b][0] + 1, p[a][1], p[b][1] + 1))
        todo += [p[:a], p[b + 1 :]]
    return out


def _covered(spans: list[tuple[int, int, int, int]], shortest: int = 1) -> tuple[int, int]:
    """Most passage words in one stretch, or in two that follow each other in passage and text (what two share counts once); and how many stretches."""
    best = (max((b - a for a, b, _, _ in spans), default=0), 1)
    for a, b, c, d in spans:
        for e, f, g, h in spans:
            cut = max(0, b - e, d - g)
            if e >= a and g >= c and f - e - cut >= shortest and (b - a) + (f - e - cut) > best[0]:
                best = ((b - a) + (f - e - cut), 2)
    return best


def _bands_kept(pair: np.ndarray, band: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair, first band) of the windows of two neighbouring bands that hold ``least`` q-grams of the pair, or do so together with another window.

    Two stretches have no q-gram of the passage in common, so windows that share a band count it once. Input: pair and
    band of each q-gram of a passage found in a band, ``least`` per pair number.
    """
    cells, n = np.unique(pair << 31 | band, return_counts=True)

    def of(keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(cells, keys), len(cells) - 1)
        return np.where(cells[at] == keys, n[at], 0)

    keys = np.unique(np.concatenate([cells, cells - 1]))
    pair = keys >> 31
    below, first, second, above = (of(keys + k) for k in (-1, 0, 1, 2))
    size = first + second
    together = size + np.maximum(below, above)
    # The largest window of the pair that shares no band with this one is among its four largest.
    order = np.lexsort((-size, pair))
    cut = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    count = np.diff(np.append(cut, len(pair)))
    of_pair = np.repeat(np.arange(len(cut)), count)
    apart = np.zeros(len(keys), np.int64)
    for k in range(4):
        other = order[np.minimum(cut + k, len(order) - 1)][of_pair]
        fits = (k < count[of_pair]) & (np.abs(keys[other] - keys) >= 2)
        apart = np.maximum(apart, np.where(fits, size[other], 0))
    keep = np.maximum(together, size + apart) >= least[pair]
    return pair[keep], keys[keep] & ((1 << 31) - 1)


class Search:
    """Steps 1 and 2 for texts against an index of passages."""

    def __init__(self, index: Index, rule: Rule):
        self.index, self.rule, self.grams = index, rule, Grams()

    def shared(self, letters: Letters) -> tuple[np.ndarray, ...]:
        """(text, passage, text word, passage word) of each shared q-gram."""
        x, parts = self.index, []
        sums = self.grams.sums(letters)
        for q in x.qs:
            at, h = self.grams.of_words(letters, q, sums)
            hit, key = x.find(h)
            parts.append((at[hit], key))
        at, key = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        n = x.begin[key + 1] - x.begin[key]
        ref = np.repeat(x.begin[key] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(letters.owner[letters.starts[at]], n), x.item[ref], np.repeat(at, n), x.word[ref]

    def regions(self, letters: Letters, n_texts: int) -> list[tuple[int, int, int, int, np.ndarray]]:
        """(text, passage, lowest and highest diagonal, passage words with a shared q-gram) of the bands kept, by text and passage, those of most words first."""
        x = self.index
        text, item, at, word = self.shared(letters)
        pair = text.astype(np.int64) * len(x.ids) + item
        counts = np.bincount(pair, minlength=n_texts * len(x.ids)) if n_texts * len(x.ids) <= 1 << 23 else None
        if counts is None:
            _, back, of_pair = np.unique(pair, return_inverse=True, return_counts=True)
            total = of_pair[back]
        else:
            total = counts[pair]
        keep = np.flatnonzero(total >= x.least[item])
        if not len(keep):
            return []
        pair, item, word = pair[keep], item[keep].astype(np.int64), word[keep].astype(np.int64)
        n_words = np.bincount(letters.owner[letters.starts], minlength=n_texts)
        diagonal = at[keep] - (np.cumsum(n_words) - n_words)[pair // len(x.ids)] - word
        band = diagonal // x.width[item] + (1 << 30)
        pairs, number = np.unique(pair, return_inverse=True)
        cells, of = np.unique(number << 31 | band, return_inverse=True)
        known = np.unique(of << 32 | word)  # a passage word of a band once
        number, band, word = cells[known >> 32] >> 31, cells[known >> 32] & ((1 << 31) - 1), known & ((1 << 32) - 1)
        got, low = _bands_kept(number, band, x.least[pairs % len(x.ids)])
        if not len(got):
            return []
        # The q-grams of each window kept, each passage word once, in order.
        cells = np.searchsorted(number << 31 | band, np.stack([got << 31 | low, got << 31 | (low + 2)]))
        n = cells[1] - cells[0]
        window = np.repeat(np.arange(len(got)), n)
        held = np.unique(window << 32 | word[np.repeat(cells[0] - np.cumsum(n) + n, n) + np.arange(n.sum())])
        window, word = held >> 32, held & ((1 << 32) - 1)
        item = pairs[got] % len(x.ids)
        # One of the stretches makes up half of the share, so some window has ``half`` q-grams of it in a row ...
        half, span = x.half[item], x.span[item]
        later = np.arange(len(window)) + half[window] - 1
        inside = later < len(window)
        later = np.minimum(later, len(window) - 1)
        tight = inside & (window[later] == window) & (word[later] - word < span[window])
        strong = np.zeros(len(pairs), bool)
        strong[got[window[tight]]] = True
        # ... and windows that reach the share with the best one of their pair are aligned.
        count = np.bincount(window, minlength=len(got))
        reach = np.minimum(x.reach(count, item), x.size[item])
        best = np.zeros(len(pairs), np.int64)
        np.maximum.at(best, got, reach)
        start = np.searchsorted(window, np.arange(len(got) + 1))
        keep = np.flatnonzero(strong[got] & (reach + best[got] >= x.need[item]))
        out = []
        for i in keep[np.lexsort((-count[keep], got[keep]))].tolist():
            width, at_band = int(x.width[item[i]]), int(low[i]) - (1 << 30)
            out.append((int(pairs[got[i]] // len(x.ids)), int(item[i]), at_band * width, (at_band + 2) * width - 1, word[start[i] : start[i + 1]]))
        return out

    def __call__(self, texts: list[str]) -> list[tuple[int, int, int, float]]:
        """(number of the text, passage id, stretches, coverage) of the leaks."""
        x, out, spans = self.index, [], {}
        doc, ws, places = -1, [], {}
        for d, p, low, high, near in self.regions(Letters(texts), len(texts)):
            if d != doc:
                doc, ws = d, words(texts[d])
                places = _places(ws)
            item, got = x.words[p], spans.setdefault((d, p), [])
            need, n = int(x.need[p]), len(item)
            shortest = min(self.rule.shortest, need)
            # A band holds several stretches, and neighbouring windows the same ones: go on with the q-grams outside those
            # found while these can still bring the pair to its share.
            for _ in range(len(near)):
                for i0, i1, j0, j1 in got:
                    if low <= j0 - i0 <= high and low <= j1 - i1 <= high:
                        near = near[(near < i0) | (near >= i1)]
                far = min(n, int(x.reach(len(near), p)))  # no stretch goes further beyond the q-grams it shares
                longest = max((i1 - i0 for i0, i1, _, _ in got), default=far)
                if not len(near) or far + max(far, longest) < need or _covered(got, shortest)[0] >= need:
                    break
                path = _path(item, places, max(0, int(near[0]) - far), min(n, int(near[-1]) + 1 + far), low, high)
                if not path:
                    break
                got += _stretches(path, self.rule.edit_every, shortest)
                near = np.setdiff1d(near, [i for i, _ in path])
        for (d, p), got in spans.items():
            covered, n = _covered(list(dict.fromkeys(got)), min(self.rule.shortest, int(x.need[p])))
            if covered >= x.need[p]:
                out.append((d, x.ids[p], n, covered / len(x.words[p])))
        return out


def _read_items(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, words(t)) for i, t in zip(b.column("item_id").to_pylist(), b.column("passage").to_pylist())]
            rows = [(i, " ".join(ws), *rule.choose(len(ws))) for i, ws in rows if ws]
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int32(), pa.int64()))], names=["item_id", "said", "q", "least"])

    return run


def _item_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams = Grams()
    for b in batches:
        for pid, said, q in zip(b.column("pid").to_pylist(), b.column("said").to_pylist(), b.column("q").to_pylist()):
            letters = Letters([said])
            h, n = np.unique(grams.of_words(letters, q, grams.sums(letters))[1], return_counts=True)
            yield pa.record_batch([pa.array(np.full(len(h), pid)), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["pid", "gram", "n"])


def _sieved(packed: np.ndarray, least: dict[int, int]):
    """Texts with as many q-grams in the bitmap as the least demanding passage of some q asks for: their words and these q-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                b = batch.slice(a, 512)
                texts = b.column("text").to_pylist()
                letters = Letters(texts)
                sums, keep, found = grams.sums(letters), np.zeros(len(texts), bool), []
                for q, enough in least.items():
                    at, h = grams.of_words(letters, q, sums)
                    hit = may_hold(packed, h)
                    owner, h = letters.owner[letters.starts[at[hit]]], h[hit]
                    much = np.bincount(owner, minlength=len(texts)) >= enough
                    found.append((owner[much[owner]], h[much[owner]]))
                    keep |= much
                owner, h = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                order = np.argsort(owner, kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])
                rows, h = np.flatnonzero(keep), h[order]
                got = [np.unique(h[ends[i] : ends[i + 1]]).view(np.int64) for i in rows]
                yield pa.record_batch([b.column("doc_id").take(pa.array(rows)), b.column("text").take(pa.array(rows)), pa.array(got, pa.list_(pa.int64()))], names=["doc_id", "text", "grams"])

    return run


_FOUND = pa.schema([("doc_id", pa.int64()), ("pid", pa.int64()), ("n_stretches", pa.int32()), ("coverage", pa.float64())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[k] for r in rows], t.type) for k, t in enumerate(_FOUND)], schema=_FOUND)


def _scanned(index: Index, rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(index, rule)
        step = max(1, min(512, (1 << 23) // max(1, len(index.ids))))
        for b in batches:
            for a in range(0, b.num_rows, step):
                part = b.slice(a, step)
                ids = part.column("doc_id").to_pylist()
                yield _batch([(ids[d], *rest) for d, *rest in search(part.column("text").to_pylist())])

    return run


def _paired(rule: Rule):
    """The same for given pairs, sorted by passage: those of a batch against its passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                b = batch.slice(a, 512)
                column = {c: b.column(c).to_pylist() for c in b.schema.names}
                at = {p: i for i, p in enumerate(column["pid"])}
                index = Index(list(at), *([column[c][i] for i in at.values()] for c in ("said", "q", "least")), rule)
                texts = dict(zip(column["rid"], zip(column["doc_id"], column["text"])))
                ids = [d for d, _ in texts.values()]
                yield _batch([(ids[d], *rest) for d, *rest in Search(index, rule)([t for _, t in texts.values()])])

    return run


def leaked_items(documents: DataFrame, items: DataFrame, share: float = 0.4, edit_every: int = 10, shortest: int = 3, small_rows: int = SMALL_ROWS) -> DataFrame:
    """Documents that hold at least ``share`` of a passage's words in one or two stretches: doc_id, item_id, n_stretches, coverage.

    A stretch begins and ends with words that both have and has at most one edit (a word changed, added or dropped) per
    ``edit_every`` of its passage words; stretches of fewer than ``shortest`` words count only where the share itself is
    fewer. Coverage counts the passage words of the stretches, in the bands that share most until the share is reached. Formatting (case, punctuation, white space) doesn't count.
    Whole texts are scanned, once however many passages there are. Null ids, texts and passages take no part; passages
    without words match nothing; repeated passages match each under its own item; of repeated item ids each passage counts
    and the best coverage holds, likewise of repeated document ids.
    """
    spark, rule = documents.sparkSession, Rule(share, edit_every, shortest)
    held = items.where("item_id IS NOT NULL AND passage IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "passage")
    held = staged(held.mapInArrow(_read_items(rule), "item_id long, said string, q int, least long"))
    passages = held.groupBy("said").agg(*(F.min(c).alias(c) for c in ("q", "least"))).withColumn("pid", F.monotonically_increasing_id())
    passages = staged(passages)
    n_grams = passages.agg(F.sum(F.size(F.split("said", " ")))).first()[0] or 0
    texts = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, pid long, n_stretches int, coverage double"
    if not n_grams:
        found = spark.createDataFrame([], schema)
    elif n_grams <= small_rows:
        rows = passages.orderBy("pid").toArrow().to_pydict()  # at most small_rows words
        found = texts.mapInArrow(_scanned(Index(*(rows[c] for c in ("pid", "said", "q", "least")), rule), rule), schema)
    else:
        found = _through_join(texts, passages, rule, schema)
    named = found.join(passages.select("pid", "said"), "pid").join(held.select("item_id", "said"), "said")
    best = named.groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", "n_stretches")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_stretches", F.round("b.coverage", 6).alias("coverage"))


def _through_join(texts: DataFrame, passages: DataFrame, rule: Rule, schema: str) -> DataFrame:
    """Steps 1 and 2 for pairs that a join on the q-gram finds."""
    least = {r["q"]: r["least"] for r in passages.groupBy("q").agg(F.min("least").alias("least")).collect()}  # at most a row per q of the ladder
    grams = staged(passages.select("pid", "said", "q").mapInArrow(_item_grams, "pid long, gram long, n long"))
    sieve = FewestBits(grams, "gram", grams.count())
    held = staged(texts.mapInArrow(_sieved(sieve.packed, least), "doc_id long, text string, grams array<long>").withColumn("rid", F.monotonically_increasing_id()))
    hits = held.select("rid", F.explode("grams").alias("gram"))
    frequent = hits.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    most_first = Window.partitionBy("pid").orderBy(F.desc("df"), "gram").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    aside = F.floor(F.col("least") / 2)  # so many q-grams of a passage are set aside at most; the others must hold the rest of the bound
    index = grams.join(frequent, "gram").join(passages.select("pid", "least"), "pid").withColumn("upto", F.sum("n").over(most_first)).where(F.col("upto") > aside)
    shared = hits.join(index.select("gram", "pid", "n", (F.col("least") - aside).alias("rest")), "gram")
    pairs = shared.groupBy("rid", "pid").agg(F.sum("n").alias("n"), F.first("rest").alias("rest")).where("n >= rest").select("rid", "pid")
    full = pairs.join(held.select("rid", "doc_id", "text"), "rid").join(passages, "pid")
    return full.sortWithinPartitions("pid", "rid").mapInArrow(_paired(rule), schema)
