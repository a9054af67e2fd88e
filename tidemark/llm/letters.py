"""Texts of a batch as one array of letters and digits, and hashes of their parts."""

from __future__ import annotations

import numpy as np

DROPPED, GAP, KEPT = 0, 1, 2
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _kind(code: int) -> int:
    c = chr(code)
    return KEPT if c.isalnum() else GAP if c.isspace() or c in "—–" else DROPPED


_KINDS = np.fromiter(map(_kind, range(1 << 16)), np.uint8, 1 << 16)


def kinds(codes: np.ndarray) -> np.ndarray:
    """Per code point whether it is kept, parts words or is dropped."""
    high = codes >= 1 << 16
    if not high.any():
        return _KINDS[codes]
    out = _KINDS[np.where(high, 0, codes)]
    values, back = np.unique(codes[high], return_inverse=True)
    out[high] = np.array([_kind(int(v)) for v in values], np.uint8)[back]
    return out


def words(text: str) -> list[str]:
    """Case-folded words between white space or dashes, without punctuation."""
    return [w for w in ("".join(filter(str.isalnum, part)) for part in text.casefold().replace("—", " ").replace("–", " ").split()) if w]


class Letters:
    """Case-folded letters and digits of several texts: ``codes``, the text each belongs to (``owner``) and where words begin (``starts``), through all texts."""

    def __init__(self, texts: list[str]):
        folded = [t.casefold() for t in texts]
        codes = np.frombuffer("\n".join([*folded, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = kinds(codes)
        keep = kind == KEPT
        self.codes = codes[keep].astype(np.uint64)
        self.owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 for t in folded])[keep]
        gaps = np.cumsum(kind == GAP, dtype=np.int32)[keep]
        self.starts = np.flatnonzero(np.concatenate([[True], gaps[1:] != gaps[:-1]])) if len(gaps) else np.zeros(0, np.int64)


class Grams:
    """Hashes of stretches of letters by differences of prefix sums of a polynomial modulo 2 ** 64."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            self.up = np.cumprod(np.full(n, _BASE, np.uint64))
            self.down = np.cumprod(np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64))

    def sums(self, letters: Letters) -> np.ndarray:
        self._powers(len(letters.codes))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters.codes * self.up[: len(letters.codes)], dtype=np.uint64)])

    def of_words(self, letters: Letters, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of the letters of each ``n`` successive words of a text."""
        m = len(letters.starts) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        ends, owner = np.append(letters.starts, len(letters.codes))[1:], letters.owner[letters.starts]
        at = np.flatnonzero(owner[:m] == owner[n - 1 :])
        start, end = letters.starts[at], ends[at + n - 1]
        h = (sums[end] - sums[start]) * self.down[start]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (end - start).astype(np.uint64) * np.uint64(16) + np.uint64(n)
        return at, h ^ (h >> np.uint64(32))
