"""Words of many texts at once as arrays: positions and 64-bit hashes, in numpy.

A word is a longest run of letters and digits (Unicode categories L and N) of the lower-cased text.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Sequence
from functools import cache

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2^64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_GRAM = np.uint64(0xD1B54A32D192ED03)

#: Texts are worked on together up to so many characters; a longer text is worked on by itself.
CHUNK_CHARS = 1 << 20


@cache
def _is_word() -> np.ndarray:
    kinds = (unicodedata.category(chr(c))[0] in "LN" for c in range(sys.maxunicode + 1))
    return np.fromiter(kinds, dtype=bool, count=sys.maxunicode + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def words_of(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, text after text, and where each text's words begin (one more than texts).

    Null texts have no words.  Equal words have equal hashes; unequal ones differ but for a chance of 2^-64.
    """
    lowered = [t.lower() if t else "" for t in texts]
    joined = "\n".join(lowered) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = _is_word()[codes]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[0::2], edges[1::2]
    n = len(codes)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), dtype=np.uint64, out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _powers(_INVERSE, n)[starts])
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in lowered], out=bounds[1:])
    return hashes, np.searchsorted(starts, bounds)


def grams_of(words: np.ndarray, lengths: Sequence[int]) -> dict[int, np.ndarray]:
    """By n the hash of every n words in a row, across text bounds too; n itself goes into the hash.

    One pass over the words for each n up to the longest.
    """
    out: dict[int, np.ndarray] = {}
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    for n in range(1, max(lengths, default=0) + 1):
        m = len(words) - n + 1
        if m <= 0:
            break
        sums = sums[:m] * _GRAM + words[n - 1 :]
        if n in lengths:
            out[n] = mix(sums + np.uint64(n))
    return {n: out.get(n, np.zeros(0, dtype=np.uint64)) for n in lengths}


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of every n words in a row."""
    return grams_of(words, [n])[n]


class Known:
    """A set of hashes: a table of their low bits, and the sorted hashes behind it."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes.astype(np.uint64, copy=False))
        self.mask = np.uint64((1 << max(10, int(len(self.sorted) * 64).bit_length())) - 1)
        self.table = np.zeros(int(self.mask) + 1, dtype=bool)
        self.table[(self.sorted & self.mask).astype(np.int64)] = True

    def spots(self, hashes: np.ndarray) -> np.ndarray:
        """Where in ``hashes`` members stand."""
        at = np.flatnonzero(self.table[(hashes & self.mask).astype(np.int64)])
        if not len(at) or not len(self.sorted):
            return at[:0]
        near = np.searchsorted(self.sorted, hashes[at]).clip(max=len(self.sorted) - 1)
        return at[self.sorted[near] == hashes[at]]


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """The positions of the least hash of each window, the rightmost of equals, without repeats.

    Of any ``window`` neighbours at least one is kept, and which one depends on them alone; so two texts that
    share a window's worth of grams keep the same one.  Fewer hashes than a window keep their least.
    """
    if not len(hashes):
        return np.zeros(0, dtype=np.int64)
    window = min(window, len(hashes))
    views = np.lib.stride_tricks.sliding_window_view(hashes[::-1], window)
    picked = len(hashes) - 1 - (np.argmin(views, axis=1) + np.arange(len(views)))
    return np.unique(picked)


def chunked(texts: Sequence[str | None]) -> list[tuple[int, int]]:
    """Bounds of runs of texts of about CHUNK_CHARS characters."""
    out, begin, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= CHUNK_CHARS:
            out.append((begin, i + 1))
            begin, size = i + 1, 0
    if begin < len(texts):
        out.append((begin, len(texts)))
    return out
