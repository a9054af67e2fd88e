"""Languages of documents and of their stretches (problem 9): rank-order profiles of character n-grams.

A language's profile ranks its most frequent n-grams. A sentence's n-grams are ranked in the same way, and its distance
from a language is the sum over its most frequent n-grams of how far each is out of place in the profile; one that the
profile lacks costs as much as the profile is long. N-grams that no profile has tell no language from another: they aren't
ranked, but count at that cost. The cheapest division of a document's sentences into stretches of at least two, with a
fixed cost for each change of language, gives the stretches; a stretch that is far from all languages is of none of them.

Languages are those of the labels, and n-grams are of the letters that occur, of whatever script.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROFILE = 400
NONE = "und"  # of none of the profiles' languages
_ORDERS = (1, 2, 3)
_SPACE = 32
_SLOT_BITS = 22
_NO_LANGUAGE = ("un", "xx", "zz", "na")
#: Scripts written without spaces between words: kana, ideographs, hangul, Thai to Khmer. Each letter counts as a word.
_DENSE = "\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff"

_END = re.compile(r"(?<=[.!?…।؟۔])[\"'”’)\]*_]*\s+|(?<=[。！？｡])[」』”’）]*\s*|\n\s*\n")
_ABBREVIATED = re.compile(r"(?:^|[\s.(])[^\W\d_]{1,3}\.[\"'”’)\]]*\s*$")
_LINE = re.compile(r"^\s*(?:>+\s*)?(?:[-*•]\s+)?", re.M)
_GAP = re.compile(r"(?<=\S)\s+(?=\S)")
_WORD = re.compile(rf"[{_DENSE}]|[^\W\d_]{{2,}}")


def _is_letter(code: int) -> bool:
    c = chr(code)
    return c.isalpha() or unicodedata.category(c)[0] == "M"


_LETTER = np.fromiter(map(_is_letter, range(1 << 16)), bool, 1 << 16)


def _pieces(sentence: str, most_words: int, piece_words: int) -> list[str]:
    """A text that runs on without sentence ends, in pieces as long as sentences are."""
    if len(sentence) <= 2 * most_words or len(sentence.split(None, most_words)) <= most_words:  # more words need more characters
        return [sentence]
    gaps = [m.start() for m in _GAP.finditer(sentence)]
    if len(gaps) < most_words:
        return [sentence]
    n = max(2, round((len(gaps) + 1) / piece_words))
    cuts = [0, *(gaps[round(k * len(gaps) / n)] for k in range(1, n)), len(sentence)]
    return [sentence[a:b] for a, b in zip(cuts, cuts[1:])]


def _has_words(part: str, least: int) -> bool:
    """Whether there are ``least`` different words."""
    seen: set[str] = set()
    for m in _WORD.finditer(part):
        seen.add(m[0].lower())
        if len(seen) >= least:
            return True
    return False


def sentences(text: str, least_words: int = 3, most_words: int = 30, piece_words: int = 16) -> list[str]:
    """Sentences of at least ``least_words`` different words; shorter bits go to the sentence before them, or else the one after.

    Text of more than ``most_words`` words without a sentence end is taken in pieces of about ``piece_words`` words.

    A full stop after a word of up to three letters and before a small letter ends none (it is taken as an abbreviation).
    Single line ends are white space; line marks of quotes and lists are dropped.
    """
    text, parts, at = _LINE.sub("", text), [], 0
    for m in _END.finditer(text):
        if "\n" not in m[0][1:] and m.end() < len(text) and text[m.end()].islower() and _ABBREVIATED.search(text[max(0, m.start() - 8) : m.start()]):
            continue
        parts.append(text[at : m.end()])
        at = m.end()
    parts.append(text[at:])
    out, carry = [], ""
    for p in parts:
        p, carry = carry + p, ""
        if _has_words(p, least_words):
            out += _pieces(p, most_words, piece_words)
        elif out:
            out[-1] += p
        else:
            carry = p
    return out


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, n-gram) of each place, an n-gram as its code points and its length; case doesn't count, what is no letter is a space."""
    lower = [t.lower() for t in texts]
    codes = np.frombuffer((" " + " ".join([*lower, ""])).encode("utf-32-le", "surrogatepass"), np.uint32)
    high = codes >= 1 << 16
    if high.any():
        letter = _LETTER[np.where(high, 0, codes)]
        letter[high] = [_is_letter(int(c)) for c in codes[high]]
    else:
        letter = _LETTER[codes]
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) + 1 for t in lower])
    owner = np.concatenate([np.zeros(1, np.int64), owner])[: len(codes)]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]  # one space after letters
    codes = np.where(letter, codes, _SPACE).astype(np.int64)[keep]
    owner = owner[keep]
    out = []
    for n in _ORDERS:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        g = np.full(m, n, np.int64) if n < 3 else codes[:m].copy()
        for k in range(1 if n == 3 else 0, n):
            g = g << 21 | codes[k : k + m]
        same = owner[:m] == owner[n - 1 :] if n > 1 else codes != _SPACE
        out.append((owner[n - 1 :][same], g[same]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([o for o, _ in out]), np.concatenate([g for _, g in out])


def _ranks(text: np.ndarray, count: np.ndarray, n_texts: int) -> np.ndarray:
    """Rank of each n-gram in its text, most frequent first, the mean rank for equal counts."""
    levels, level = np.unique(count, return_inverse=True)
    width = len(levels)
    if n_texts * width > 1 << 23:  # the same by sorting, where counts are very many
        order = np.lexsort((-count, text))
        t, c = text[order], count[order]
        first = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (c[1:] != c[:-1])])) if len(t) else np.zeros(0, int)
        n = np.diff(np.append(first, len(t)))
        out = np.empty(len(t))
        out[order] = np.repeat(first + (n - 1) / 2, n) - np.searchsorted(t, t, "left")
        return out
    at = text * width + level
    n = np.bincount(at, minlength=n_texts * width).reshape(n_texts, width)
    above = n[:, ::-1].cumsum(1)[:, ::-1] - n
    return (above + (n - 1) / 2).ravel()[at]


class Profiles:
    """Ranks of the most frequent n-grams per language, and beyond which distance a text is of none of them."""

    def __init__(self, texts: list[str], labels: list[str], size: int = PROFILE):
        self.size = size
        self.languages = tuple(sorted(set(labels)))
        self._fit(texts, labels)
        # Once more without the texts whose label the first profiles contradict.
        if texts and self.languages:
            near = self.distances(texts).argmin(1)
            kept = [i for i, lab in enumerate(labels) if self.languages[near[i]] == lab]
            self._fit([texts[i] for i in kept], [labels[i] for i in kept])
            own = self.distances([texts[i] for i in kept]).min(1) if kept else np.zeros(1)
            self.limit = (float(own.max()) + 1) / 2
        else:
            self.limit = 1.0

    def _fit(self, texts: list[str], labels: list[str]) -> None:
        tops = []
        for lang in self.languages:
            gram, count = np.unique(_grams([t for t, lab in zip(texts, labels) if lab == lang])[1], return_counts=True)
            tops.append(gram[np.lexsort((gram, -count))[: self.size]])
        self.keys = np.unique(np.concatenate(tops)) if tops else np.zeros(0, np.int64)
        self.ranks = np.full((len(self.keys) + 1, len(self.languages)), self.size, np.float32)
        for j, top in enumerate(tops):
            self.ranks[np.searchsorted(self.keys, top), j] = np.arange(len(top))
        # A table of slots without collisions, found by trying multipliers.
        for seed in range(1, 1000):
            self.factor = np.uint64(0x9E3779B97F4A7C15 * (2 * seed + 1) % (1 << 64))
            at = self._slot(self.keys)
            if len(np.unique(at)) == len(at):
                break
        self.table = np.full(1 << _SLOT_BITS, len(self.keys), np.int32)
        self.table[at] = np.arange(len(self.keys))
        self.padded = np.append(self.keys, -1)

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return (grams.view(np.uint64) * self.factor) >> np.uint64(64 - _SLOT_BITS)

    def distances(self, texts: list[str]) -> np.ndarray:
        """Out-of-place distance of each text from each language, per n-gram counted, between 0 and 1."""
        text, gram = _grams(texts)
        number = self.table[self._slot(gram)]
        known = self.padded[number] == gram
        total = np.bincount(text, minlength=len(texts))
        text, number = text[known], number[known]
        strange = 1 - np.bincount(text, minlength=len(texts)) / np.maximum(total, 1)
        width = len(self.keys)
        if len(texts) * width <= 1 << 24:
            counts = np.bincount(text * width + number, minlength=len(texts) * width)
            at = np.flatnonzero(counts)
            count = counts[at]
        else:
            at, count = np.unique(text * width + number, return_counts=True)
        text, number = at // max(width, 1), at % max(width, 1)
        rank = _ranks(text, count, len(texts))
        use = rank < self.size
        text, number, rank = text[use], number[use], rank[use].astype(np.float32)
        place = self.ranks[number]
        off = np.where(place >= self.size, np.float32(self.size), np.abs(place - rank[:, None]))
        n = np.bincount(text, minlength=len(texts))
        out = np.ones((len(texts), len(self.languages)))
        some = np.flatnonzero(n)
        if len(some):
            ends = np.cumsum(n)
            out[some] = np.add.reduceat(off, (ends - n)[some], axis=0, dtype=np.float64) / (self.size * n[some])[:, None]
        return out * (1 - strange[:, None]) + strange[:, None]


def stretches(cost: np.ndarray, change: float) -> list[tuple[int, int, int]]:
    """The cheapest division into (first, end, language), each of at least two sentences (a lone sentence is one).

    ``cost`` has a row per sentence and a column per language.
    """
    n, k = cost.shape
    best = cost.argmin(1)
    if n < 4 or (best == best[0]).all():
        return [(0, n, int(cost.sum(0).argmin()))] if n else []
    sums = np.vstack([np.zeros(k), np.cumsum(cost, axis=0)])
    # open_[j]: cheapest cost of sentences 0..i-1 in which the last stretch is of language j and has two sentences or more.
    total, back = np.full((n + 1, k), np.inf), np.full((n + 1, k), -1)
    enter = np.full(n + 1, np.inf)
    enter[0] = 0.0
    who = np.full(n + 1, -1)
    for i in range(2, n + 1):
        start = enter[i - 2] + (change if i > 2 else 0.0) + sums[i] - sums[i - 2]
        go = total[i - 1] + cost[i - 1]
        fresh = start < go
        total[i] = np.where(fresh, start, go)
        back[i] = np.where(fresh, i - 2, back[i - 1])
        who[i] = int(total[i].argmin())
        enter[i] = total[i, who[i]]
    out, i = [], n
    while i > 0:
        j = int(who[i])
        s = int(back[i, j])
        if out and out[-1][2] == j:
            out[-1] = (s, out[-1][1], j)
        else:
            out.append((s, i, j))
        i = s
    return out[::-1]


def _divided(profiles: Profiles, change: float, together: int = 50):
    names_ = (*profiles.languages, NONE)
    names = ["doc_id", "label", "seg_no", "lang", "confidence", "n_sentences", "n_segments"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, labels, texts = (b.column(c).to_pylist() for c in ("doc_id", "label", "text"))
            out: list[list] = [[] for _ in names]
            for a in range(0, len(ids), together):
                split = [sentences(t) for t in texts[a : a + together]]
                flat = [s for ss in split for s in ss]
                if not flat:
                    continue
                d = profiles.distances(flat)
                weight = np.array([len(s) for s in flat])[:, None]
                d = np.hstack([d, np.full((len(flat), 1), profiles.limit)])  # the last is none of the languages
                at = 0
                for k, ss in enumerate(split):
                    part, w = d[at : at + len(ss)], weight[at : at + len(ss)]
                    at += len(ss)
                    got = stretches((part - part.min(1, keepdims=True)) * w, change)
                    for seg, (i, j, lang) in enumerate(got):
                        mean = (part[i:j] * w[i:j]).sum(0) / w[i:j].sum()
                        other = np.delete(mean, lang).min(initial=1.0)
                        row = (ids[a + k], labels[a + k], seg + 1, names_[lang], round(float(max(0.0, 1 - mean[lang] / max(other, 1e-9))), 6), j - i, len(got))
                        for column, v in zip(out, row):
                            column.append(v)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32()))], names=names)

    return run


def code(label) -> F.Column:
    """A language label without letter case and region."""
    return F.lower(F.trim(F.regexp_extract(label, r"^\s*([^-_\s]*)", 1)))


def fit_profiles(documents: DataFrame, languages: tuple[str, ...] | None = None, sample_docs: int = 400) -> Profiles:
    """Profiles from at most ``sample_docs`` labelled documents per language, picked by a hash of the id (labels may be wrong).

    Without ``languages``, those of all two-letter labels.
    """
    held = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", code(F.col("lang")).alias("lang"))
    held = held.where(F.col("lang").isin(*languages) if languages else F.col("lang").rlike("^[a-z]{2}$") & ~F.col("lang").isin(*_NO_LANGUAGE))
    counts = {r["lang"]: r["count"] for r in held.groupBy("lang").count().collect()}  # two-letter codes
    cut = F.lit(0)
    for lang, n in counts.items():
        cut = F.when(F.col("lang") == lang, F.lit(int(1_000_000 * min(1.0, sample_docs / n)))).otherwise(cut)
    rows = held.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < cut).select("doc_id", "lang", "text").limit(2 * sample_docs * max(1, len(counts))).toArrow().to_pylist()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return Profiles([r["text"] for r in rows], [r["lang"] for r in rows])


def segments(documents: DataFrame, languages: tuple[str, ...] | None = None, change: float = 5.0, sample_docs: int = 400, profiles: Profiles | None = None) -> DataFrame:
    """Each document's stretches: doc_id, label, seg_no, lang, confidence, n_sentences, n_segments.

    ``lang`` is a language of the labels (or of ``languages``), or ``und`` for a stretch that is further from all of them than
    half-way from the furthest labelled text to no likeness at all. ``confidence`` is how much smaller the distance from
    the language is than from the next one, 0 to 1. A document with sentences too few for two stretches has one. Documents
    with a null id or text or without a sentence have no rows; repeated documents have rows as often as stored; an empty
    table gives none; without any label all is ``und``.
    """
    profiles = profiles or fit_profiles(documents, languages, sample_docs)
    rows = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("label"), "text")
    return rows.mapInArrow(_divided(profiles, change), "doc_id long, label string, seg_no int, lang string, confidence double, n_sentences int, n_segments int")


def mislabelled(segs: DataFrame) -> DataFrame:
    """Stretches of documents whose label is missing or wrong, or that have several: doc_id, seg_no, lang."""
    wrong = F.col("label").isNull() | (code(F.col("label")) != F.col("lang"))
    return segs.where((F.col("n_segments") > 1) | wrong).select("doc_id", F.col("seg_no").cast("long").alias("seg_no"), "lang")


def document_languages(segs: DataFrame) -> DataFrame:
    """One row per document: doc_id, label, lang (of the most sentences, then the first), confidence, n_languages, label_holds."""
    one = segs.groupBy("doc_id", "label").agg(F.max(F.struct("n_sentences", -F.col("seg_no"), "lang", "confidence")).alias("m"), F.count_distinct("lang").alias("n_languages"))
    return one.select("doc_id", "label", "m.lang", "m.confidence", "n_languages", F.coalesce((F.col("n_languages") == 1) & (code(F.col("label")) == F.col("m.lang")), F.lit(False)).alias("label_holds"))
