"""Byte-level BPE ids of whole batches of texts: pretokens are cut and hashed as arrays, each distinct one is encoded once.

A byte-level BPE never merges across pretokens, so a text's ids are the ids of its pretokens laid end to end. The cut is
the vocabulary's own: a contraction, a run of letters, of numbers or of other characters with at most one space in front,
and white space. Ids always come from the tokenizer itself; what is done here is to ask it once for each distinct
pretoken of a worker instead of once for each place. Pretokens are told apart by 64-bit hashes.

Texts with characters whose class differs between Unicode versions, and texts that hold the string of a special token,
are given to the tokenizer whole.
"""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from tideflow.llm.textarrays import U, Powers, mix

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks already use all cores

LETTER, NUMBER, OTHER, SPACE = range(4)
#: Code points whose classes no Unicode version since 7.0 has changed: the others' texts are encoded whole.
SETTLED = ((0x0000, 0x052F), (0x2000, 0x2063), (0x3041, 0x3096), (0x4E00, 0x9FA5))
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F)
#: Distinct pretokens that a worker keeps; beyond it, it starts anew.
KEPT = 2_000_000
#: Characters that are cut at once.
CHUNK_CHARS = 1 << 20

_POWERS = Powers(0x9E3779B97F4A7C15)


@lru_cache(1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Each BMP code point's class, and whether it is settled."""
    kind, settled = np.full(1 << 16, OTHER, np.uint8), np.zeros(1 << 16, bool)
    for lo, hi in SETTLED:
        settled[lo : hi + 1] = True
        for c in range(lo, hi + 1):
            kind[c] = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER)
    kind[list(WHITE)] = SPACE
    return kind, settled


def starts(code: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pretokens start in texts laid end to end; first: where texts start."""
    n = len(code)
    new = np.zeros(n + 1, bool)
    new[first] = new[n] = True
    change = new.copy()
    change[1:n] |= kind[1:] != kind[:-1]
    begin = change[:n].copy()
    # A run of white space before other characters gives its last one away: to them if it is a space, else to itself.
    last = np.flatnonzero((kind == SPACE) & change[1:] & ~new[1:])
    begin[last] = True
    glued = last[code[last] == 0x20]
    begin[glued + 1] = False
    # A lone apostrophe that no space is glued to, and the letters of a contraction after it.
    lone = np.flatnonzero((code == 0x27) & begin & change[1:] & ~new[1:])
    lone = lone[kind[lone + 1] == LETTER]
    at = lambda i: np.where((i < n) & ~new[np.minimum(i, n)], code[np.minimum(i, n - 1)], 0)
    a = code[lone + 1]
    b = at(lone + 2)
    one = np.isin(a, [ord(x) for x in "stmd"])
    two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    begin[lone[one | two] + 1] = False
    end = lone[one | two] + np.where(one, 2, 3)[one | two]
    end = end[end < n]
    begin[end] = True
    return np.flatnonzero(begin)


class Encoder:
    """A tokenizer with the pretokens that it has encoded: their hashes in order, and where their ids lie."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.place, self.size = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Encode new pretokens, each by itself."""
        got = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        size = np.array([len(g) for g in got])
        new = np.concatenate(got)
        while self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(new)] = new
        place = self.used + np.cumsum(size) - size
        self.used += len(new)
        order = np.argsort(hashes)
        to = np.searchsorted(self.hashes, hashes[order])
        self.hashes, self.place, self.size = np.insert(self.hashes, to, hashes[order]), np.insert(self.place, to, place[order]), np.insert(self.size, to, size[order])

    def _cut(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts of settled characters."""
        whole = "".join(texts)
        code = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        offsets = np.cumsum([0, *map(len, texts)])
        filled = offsets[:-1][np.diff(offsets) > 0]
        begin = starts(code, _classes()[0][code], filled)
        end = np.r_[begin[1:], len(code)]
        up, down = _POWERS.upto(len(code) + 1)
        sums = np.zeros(len(code) + 1, U)
        np.cumsum(mix(code.astype(U) * U(0xD6E8FEB86659FD93) + U(1)) * up[: len(code)], out=sums[1:])
        hashes = mix((sums[end] - sums[begin]) * down[begin])
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) > KEPT:
            self._forget()
        at = np.searchsorted(self.hashes, distinct)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == distinct[known]
        new = np.flatnonzero(~known)
        if len(new):
            self._learn(distinct[new], [whole[begin[i] : end[i]] for i in where[new]])
            at = np.searchsorted(self.hashes, distinct)
        place, size = self.place[at][inverse], self.size[at][inverse]
        upto = np.cumsum(size)
        ids = self.ids[np.repeat(place - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)]
        bounds = np.r_[0, upto][np.searchsorted(begin, offsets)]
        return [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Each text's ids; a null text has those of an empty one."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        kind, settled = _classes()
        batch: list[int] = []
        n = 0

        def flush() -> None:
            for i, ids in zip(batch, self._cut([texts[j] for j in batch]), strict=True):
                out[i] = ids
            batch.clear()

        for i, text in enumerate(texts):
            if not text:
                continue
            code = np.frombuffer(text.encode("utf-32-le"), np.uint32) if not text.isascii() else None
            if (code is not None and (code.max() > 0xFFFF or not settled[code].all())) or any(s in text for s in self.special):
                out[i] = self._ids(text)
                continue
            batch.append(i)
            n += len(text)
            if n > CHUNK_CHARS:
                flush()
                n = 0
        if batch:
            flush()
        return out


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    return Encoder(path)
