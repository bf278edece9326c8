"""Words and word shingles of many texts at once, in numpy.

A word is a maximal run of letters and numbers (``str.isalnum``), lower-cased
code point by code point.  Each has a 64-bit hash; a shingle of ``k``
consecutive words has one too.  A text with fewer than ``k`` words, but one at
least, has one shingle of all its words; a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

POINTS = 0x110000
#: Code points handled at once; a longer text is a piece of its own, so memory follows the longest text.
PIECE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: is it part of a word, is it a letter, its lower case (where that is one code point)."""
    word = np.fromiter((chr(i).isalnum() for i in range(POINTS)), np.bool_, POINTS)
    letter = np.fromiter((chr(i).isalpha() for i in range(POINTS)), np.bool_, POINTS)
    lower = np.arange(POINTS, dtype=np.uint32)
    for i in np.flatnonzero(letter).tolist():
        low = chr(i).lower()
        if len(low) == 1:
            lower[i] = ord(low)
    return word, letter, lower


@cache
def _powers(n: int) -> np.ndarray:
    out = np.full(n, np.uint64(0x9E3779B97F4A7C15) | np.uint64(1), np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@cache
def _char_hash() -> np.ndarray:
    return mix(np.arange(1, POINTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Words:
    """Words of some texts: code points of all words end to end, and for each word its text, start and length in them."""

    def __init__(self, texts: list[str | None], letters_only: bool = False):
        is_word, is_letter, lower = tables()
        joined = "\n".join(t or "" for t in texts)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter((len(t or "") for t in texts), np.int64, len(texts))
        self.ends = np.cumsum(sizes + 1) - 1  # of each text, its separator's place
        self.newlines = np.flatnonzero(cp == 10)  # the texts' own and their separators
        at = np.flatnonzero((is_letter if letters_only else is_word)[cp])
        self.points = lower[cp[at]]
        first = np.ones(len(at), np.bool_)
        first[1:] = np.diff(at) != 1
        self.starts = np.flatnonzero(first)
        self.lengths = np.diff(np.append(self.starts, len(at)))
        self.at = at[self.starts]  # of each word, its place in the joined texts
        self.doc = np.searchsorted(self.ends, self.at, side="right") if len(self.at) else np.zeros(0, np.int64)
        self.n_docs = len(texts)

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)

    def hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        inside = np.arange(len(self.points)) - np.repeat(self.starts, self.lengths)
        longest = 1 << int(self.lengths.max()).bit_length()
        h = _char_hash()[self.points] * _powers(longest)[inside]
        return mix(np.add.reduceat(h, self.starts) + self.lengths.astype(np.uint64))


def shingles(h: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every shingle, in text order; h and doc are those of the words, text by text."""
    n = len(h)
    count = np.bincount(doc, minlength=n_docs)
    if n == 0:
        return h, doc
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += padded[j : j + n] * (mix(np.uint64([j + 1])) | np.uint64(1))
    first = np.cumsum(count) - count
    place = np.arange(n) - first[doc]
    keep = place + k <= count[doc]
    for d in np.flatnonzero((count > 0) & (count < k)).tolist():
        own = h[first[d] : first[d] + count[d]]
        total[first[d]] = sum((own[j : j + 1] * (mix(np.uint64([j + 1])) | np.uint64(1)) for j in range(len(own))), np.zeros(1, np.uint64))[0] + np.uint64(count[d])
        keep[first[d]] = True
    return mix(total[keep]), doc[keep]


def pieces(batch: pa.RecordBatch | pa.Table, text: str = "text", limit: int = PIECE) -> Iterator[tuple[int, int, list[str | None]]]:
    """(from, to, texts) of runs of rows with about ``limit`` bytes of text each."""
    column = batch.column(text)
    n = batch.num_rows
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
    done = np.concatenate([[0], np.cumsum(sizes)])
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(done, done[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j, column.slice(i, j - i).to_pylist()
        i = j
