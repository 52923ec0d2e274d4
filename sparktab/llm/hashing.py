"""Numbers for words and for runs of words, many at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: Powers of a base that were needed before, for texts of up to ``KEPT`` bytes or words.
KEPT = 1 << 20
_kept: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    known = _kept.get(base)
    if known is not None and len(known) >= n:
        return known[:n]
    out = np.full(max(n, 1 << 14), base, np.uint64)
    out[0] = 1
    out = np.multiply.accumulate(out, dtype=np.uint64)
    if len(out) <= KEPT:
        _kept[base] = out
    return out[:n]


def word_numbers(joined: bytes, ends: np.ndarray) -> np.ndarray:
    """A 64-bit number for each word of a text whose words are joined by one space."""
    raw = np.frombuffer(joined, np.uint8).astype(np.uint64)
    raw += np.uint64(1)
    raw *= _powers(_ODD, len(raw))
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(raw, out=prefix[1:], dtype=np.uint64)
    starts = np.concatenate([[0], ends[:-1] + 1])
    return _mixed((prefix[ends] - prefix[starts]) * _powers(_INVERSE, len(raw))[starts] + (ends - starts).astype(np.uint64))


def grams(numbers: np.ndarray, k: int) -> np.ndarray:
    """A fingerprint for every run of ``k`` words."""
    n = len(numbers) - k + 1
    prefix = np.zeros(len(numbers) + 1, np.uint64)
    np.cumsum(numbers * _powers(_ODD, len(numbers)), out=prefix[1:], dtype=np.uint64)
    return _mixed((prefix[k:] - prefix[:n]) * _powers(_INVERSE, n))


def joined_words(raw: bytes) -> tuple[bytes, np.ndarray]:
    """The words (between space and U+0009 to U+000D) joined by one space, and where each ends."""
    words = raw.split()
    return b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


class Lookup:
    """A fixed map from 64-bit keys to numbers, asked for many keys at once; -1 for unknown ones."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keys = keys.astype(np.int64)
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        self.mask = (1 << (64 - int(self.shift))) - 1
        self.keys = np.zeros(self.mask + 1, np.int64)
        self.values = np.full(self.mask + 1, -1, np.int64)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.values[at[todo]] < 0
            # Of several keys for one free slot the first gets it; the others go on.
            _, first = np.unique(at[todo[free]], return_index=True)
            mine = todo[free][first]
            self.keys[at[mine]], self.values[at[mine]] = keys[mine], values[mine]
            left = np.ones(len(keys), bool)
            left[mine] = False
            todo = todo[left[todo]]
            at[todo] = (at[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(_ODD)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if keys.ndim > 1:
            return self(keys.ravel()).reshape(keys.shape)
        at = self._slot(keys)
        out = self.values[at]
        todo = np.flatnonzero((self.keys[at] != keys) & (out >= 0))
        at, keys = at[todo], keys[todo]
        while len(todo):
            at = (at + 1) & self.mask
            out[todo] = found = self.values[at]
            more = (self.keys[at] != keys) & (found >= 0)
            todo, at, keys = todo[more], at[more], keys[more]
        return out
