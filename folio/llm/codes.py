"""Whole batches of texts as one array of code points.

The operators of this package look at every character of the corpus, which row-at-a-time Python cannot
afford.  A batch of texts is joined by line feeds into one ``uint32`` array; character classes come from a
lookup table, words and lines are runs in that array, and their 64-bit hashes come from one prefix sum
(sum of c_i * B**i modulo 2**64, multiplied by the inverse of B**start), so the cost is a few numpy passes.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np

OTHER, SPACE, NEWLINE, LOWER, UPPER, CASELESS, DIGIT, MARK, PUNCT, FORMAT = range(10)
_BASE = 0x9E3779B97F4A7C15  # odd, hence invertible modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
CHUNK_CHARS = 1 << 20


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower-case code point of each code point of the basic plane (others: CASELESS, themselves)."""
    kinds, lower = np.zeros(65537, np.uint8), np.arange(65537, dtype=np.uint32)
    by_cat = {"Ll": LOWER, "Lu": UPPER, "Lt": UPPER, "Lo": CASELESS, "Lm": CASELESS, "Nd": DIGIT, "Mn": MARK, "Mc": MARK, "Cf": FORMAT, "Zs": SPACE}
    for c in range(65536):
        ch = chr(c)
        cat = unicodedata.category(ch)
        kinds[c] = PUNCT if cat[0] == "P" else by_cat.get(cat, OTHER)
        if cat == "Lu":
            low = ch.lower()
            if len(low) == 1:
                lower[c] = ord(low)
    for c in (9, 11, 12, 13, 0x2028, 0x2029):
        kinds[c] = SPACE
    kinds[10] = NEWLINE
    kinds[65536] = CASELESS
    return kinds, lower


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(max(1 << 21, 1 << int(n).bit_length()))
    return up[:n], down[:n]


class Codes:
    """A list of texts (None counts as empty) as one code-point array; text k is cp[start[k]:end[k]]."""

    def __init__(self, texts: list[str | None]):
        texts = [t or "" for t in texts]
        self.joined = "\n".join(texts) + "\n"
        self.cp = np.frombuffer(self.joined.encode("utf-32-le", "replace"), np.uint32)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        self.end = np.cumsum(lens + 1) - 1
        self.start = self.end - lens
        kinds, lower = tables()
        small = self._small = np.minimum(self.cp, 65536)
        self._sums = None
        self.kind = kinds[small]
        self.low = np.where(small == 65536, self.cp, lower[small])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """range_hash of the lower-case text, whose prefix sums are made once."""
        if self._sums is None:
            self._sums = prefix_sums(self.low)
        return sums_hash(self._sums, start, end)

    def within(self, chars: str) -> np.ndarray:
        """Which characters are among a few of the basic plane."""
        lut = np.zeros(65537, bool)
        lut[[ord(x) for x in chars]] = True
        return lut[self._small]

    def is_kind(self, *kinds: int) -> np.ndarray:
        lut = np.zeros(10, bool)
        lut[list(kinds)] = True
        return lut[self.kind]

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """start, end, text index and line number of every line (empty ones too)."""
        end = np.flatnonzero(self.cp == 10)
        start = np.concatenate(([0], end[:-1] + 1))
        doc = np.searchsorted(self.end, start, "left")
        first = np.searchsorted(start, self.start, "left")
        return start, end, doc, np.arange(len(start)) - first[doc]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """start and end of the maximal runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(len(values) + 1)[0][:-1], out=total[1:])
    return total


def sums_hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        down = powers(len(total))[1]
        h = (total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _MIX
        h = (h ^ (h >> np.uint64(29))) * _MIX
        return h ^ (h >> np.uint64(32))


def range_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of values[start:end] for every range; equal content gives an equal hash."""
    return sums_hash(prefix_sums(values), start, end)


def hash_words(words: list[str]) -> np.ndarray:
    """The hash that range_hash gives each of these strings."""
    if not words:
        return np.zeros(0, np.uint64)
    cp = np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32)
    end = np.cumsum([len(w) for w in words])
    return range_hash(cp, end - np.array([len(w) for w in words]), end)


def among(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Index of each x in sorted_values, or -1."""
    if not len(sorted_values):
        return np.full(len(x), -1)
    at = np.searchsorted(sorted_values, x)
    at[at == len(sorted_values)] = 0
    return np.where(sorted_values[at] == x, at, -1)


def counts_before(mask: np.ndarray) -> np.ndarray:
    """counts_before(m)[e] - counts_before(m)[s] is the number of True in m[s:e]."""
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def chunks(texts: list[str | None], size: int = CHUNK_CHARS) -> Iterator[slice]:
    """Slices of the list of about ``size`` characters each; a longer text makes a chunk of its own."""
    at = total = 0
    for k, t in enumerate(texts):
        n = len(t or "") + 1
        if total and total + n > size:
            yield slice(at, k)
            at, total = k, 0
        total += n
    if at < len(texts):
        yield slice(at, len(texts))

def unspaced(cp: np.ndarray) -> np.ndarray:
    """Characters of scripts that put no space between words (Thai to Burmese, Khmer, kana, Han)."""
    return ((cp >= 0x0E00) & (cp < 0x0F00)) | ((cp >= 0x1000) & (cp < 0x10A0)) | ((cp >= 0x1780) & (cp < 0x1800)) | ((cp >= 0x3040) & (cp < 0x3100)) | ((cp >= 0x3400) & (cp < 0xA000)) | ((cp >= 0xF900) & (cp < 0xFB00))


def units(c: Codes) -> tuple[np.ndarray, np.ndarray]:
    """start and end of the words; in scripts without spaces every character is one."""
    w = c.is_kind(LOWER, UPPER, CASELESS, MARK)
    u = unspaced(c.cp)
    before_w, before_u = np.concatenate(([False], w[:-1])), np.concatenate(([False], u[:-1]))
    cut = u | before_u
    start = np.flatnonzero(w & (~before_w | cut))
    end = np.flatnonzero(np.concatenate((before_w & (~w | cut), w[-1:])))
    return start, end
