"""Whole batches of texts as byte arrays: words, word hashes and n-gram hashes without a Python loop over words.

A chunk is some documents' UTF-8 bytes laid end to end with their offsets. Words are maximal runs of word bytes inside
one document. Hashes are polynomials over a table of random 64-bit values, taken from prefix sums modulo 2**64 and then
mixed; they depend on the words alone, so they agree between tasks, batches and runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once. One longer document is a chunk by itself.
CHUNK_BYTES = 1 << 21

U = np.uint64
BYTE = np.arange(256)
SPACES = np.isin(BYTE, [0x20, *range(0x09, 0x0E)])
#: Words of the plain kind: runs without ASCII white space.
PLAIN = ~SPACES
#: Words after lower-casing: digits, a-z, and every byte of characters beyond ASCII.
ALNUM = (BYTE >= 0x80) | np.isin(BYTE, np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyz", np.uint8))
LOWER = np.where((BYTE >= 65) & (BYTE <= 90), BYTE + 32, BYTE).astype(np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


_BYTES = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, extended as needed."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(0, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, x in (("up", self.base), ("down", self.inverse)):
                a = np.full(size, U(x))
                a[0] = 1
                setattr(self, name, np.cumprod(a))
        return self.up, self.down


_LETTERS, _WORDS, _WORDS2 = Powers(0x9E3779B97F4A7C15), Powers(0xD6E8FEB86659FD93), Powers(0xA0761D6478BD642F)


class Chunk:
    """Documents lo..hi of a batch: their bytes, and their words as (first, end) byte positions.

    word_at[i] is the index of document i's first word, word_at[-1] the number of words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, kind: np.ndarray, lower: bool) -> None:
        self.lo, self.hi, self.n = lo, hi, hi - lo
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        word = kind[self.data]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        first[inner] = word[inner]
        last[inner - 1] = word[inner - 1]
        self.first, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.word_at = np.searchsorted(self.first, offsets)
        self._hash: np.ndarray | None = None
        self._sums: np.ndarray | None = None

    @property
    def counts(self) -> np.ndarray:
        """Words by document."""
        return np.diff(self.word_at)

    @property
    def doc(self) -> np.ndarray:
        """Each word's document, from 0 in this chunk."""
        return np.repeat(np.arange(self.n), self.counts)

    @property
    def hashes(self) -> np.ndarray:
        """Each word's hash."""
        if self._hash is None:
            self._hash = self.hash_between(self.first, self.end)
        return self._hash

    def hash_between(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from each first to before each end."""
        up, down = _LETTERS.upto(len(self.data) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, U)
            np.cumsum(_BYTES[self.data] * up[: len(self.data)], out=self._sums[1:])
        return mix((self._sums[end] - self._sums[first]) * down[first])

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Word indices at which n words of one document start, and the hashes of those n words."""
        at = np.flatnonzero(np.arange(len(self.first)) + n <= np.repeat(self.word_at[1:], self.counts))
        return at, gram_hash(self.hashes, at, n)

    def word(self, i: int) -> bytes:
        return self.data[self.first[i] : self.end[i]].tobytes()


def gram_hash(hashes: np.ndarray, at: np.ndarray, n: int | np.ndarray, second: bool = False) -> np.ndarray:
    """Hashes of the n words from each index; second: from another family, for a 128-bit value of both."""
    up, down = (_WORDS2 if second else _WORDS).upto(len(hashes) + 1)
    h = mix(hashes ^ U(0x5851F42D4C957F2D)) if second else hashes
    sums = np.zeros(len(h) + 1, U)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix((sums[at + n] - sums[at]) * down[at])


def chunks(text: pa.Array, kind: np.ndarray, lower: bool, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """A column of texts as chunks; a null text is empty."""
    text = text.cast(pa.large_string()).fill_null("")
    if not len(text):
        return
    _, where, what = text.buffers()
    offsets = np.frombuffer(where, np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(what, np.uint8) if what is not None and what.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield Chunk(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lo, hi, kind, lower)
        lo = hi


def per_doc(at: np.ndarray, chunk: Chunk) -> np.ndarray:
    """How many of the sorted word indices fall into each document, as offsets (n + 1)."""
    return np.searchsorted(at, chunk.word_at)
