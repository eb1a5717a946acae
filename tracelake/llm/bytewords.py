"""Words of Arrow string columns as numpy spans and 64-bit hashes (no Python object per word)."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POW: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def _inverse() -> np.uint64:
    return np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(n: int):
    if "p" not in _POW or len(_POW["p"]) < n:
        m = max(n, 1 << 19)
        one = np.ones(1, np.uint64)
        _POW["p"] = np.concatenate([one, np.multiply.accumulate(np.full(m - 1, _BASE, np.uint64))])
        _POW["i"] = np.concatenate([one, np.multiply.accumulate(np.full(m - 1, _inverse(), np.uint64))])
    return _POW["p"], _POW["i"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of ``data[starts[i]:ends[i]]``, equal bytes giving equal hashes."""
    power, inverse = _powers(len(data) + 1)
    acc = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], out=acc[1:])
    return mix((acc[ends] - acc[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def text_chunks(column, max_bytes: int = 500_000):
    """Yield ``(first row, data, bounds)`` over a string column: ``data`` are the bytes
    of rows ``first ..``, row ``k`` of them at ``bounds[k]:bounds[k+1]``.  Nulls are empty.
    A chunk ends at ``max_bytes``, but never inside a row."""
    import pyarrow as pa

    col = column.cast(pa.large_binary()).fill_null(b"")
    n = len(col)
    if not n:
        return
    _, off, dat = col.buffers()
    offs = np.frombuffer(off, np.int64)[col.offset:col.offset + n + 1]
    raw = np.frombuffer(dat, np.uint8) if dat is not None and dat.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + max_bytes, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, raw[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, bounds: np.ndarray):
    """Spans of the maximal runs without ASCII white space: ``starts, ends, row``."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    cut = _SPACE[data]
    gap = np.empty(len(data), bool)
    gap[0] = True
    np.logical_or(cut[:-1], False, out=gap[1:])
    first = bounds[:-1][bounds[:-1] < len(data)]
    gap[first] = True
    starts = np.flatnonzero(gap & ~cut)
    stop = np.empty(len(data), bool)
    stop[-1] = True
    stop[:-1] = cut[1:]
    stop[first[first > 0] - 1] = True
    ends = np.flatnonzero(stop & ~cut) + 1
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(np.searchsorted(starts, bounds)))
    return starts, ends, row


def word_hashes(data: np.ndarray, bounds: np.ndarray):
    """``hash, row`` of every word, A-Z lower-cased."""
    starts, ends, row = words(data, bounds)
    return span_hashes(_LOWER[data], starts, ends), row


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + lengths[i] - 1``, one run after the other."""
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - first, lengths)


class HashIndex:
    """Open-addressing table from 64-bit hashes to consecutive numbers, all in numpy."""

    def __init__(self, size: int = 1 << 16):
        self.n = 0
        self.keys = np.zeros(size, np.uint64)
        self.vals = np.full(size, -1, np.int32)

    @staticmethod
    def _key(h):
        return np.where(h == 0, np.uint64(1), h)  # 0 marks an empty slot

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each hash, -1 where unknown."""
        h = self._key(h)
        mask = np.uint64(len(self.keys) - 1)
        slot = (h & mask).astype(np.int64)
        got = self.keys[slot]
        out = np.where(got == h, self.vals[slot], np.int32(-1))
        open_ = np.flatnonzero((got != h) & (got != 0))
        while len(open_):
            slot_o = (slot[open_] + 1) & int(mask)
            slot[open_] = slot_o
            got = self.keys[slot_o]
            hit = got == h[open_]
            out[open_[hit]] = self.vals[slot_o[hit]]
            open_ = open_[~hit & (got != 0)]
        return out

    def add(self, h: np.ndarray) -> np.ndarray:
        """Insert distinct unknown hashes; their numbers are consecutive."""
        if 2 * (self.n + len(h)) > len(self.keys):
            used = self.keys != 0
            keys, vals = self.keys[used], self.vals[used]
            size = len(self.keys)
            while 2 * (self.n + len(h)) > size:
                size *= 2
            self.keys, self.vals = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
            self._place(keys, vals)
        numbers = np.arange(self.n, self.n + len(h), dtype=np.int32)
        self._place(self._key(h), numbers)
        self.n += len(h)
        return numbers

    def _place(self, h, vals):
        mask = len(self.keys) - 1
        slot = (h & np.uint64(mask)).astype(np.int64)
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]
            won = free & (self.keys[slot] == h)
            self.vals[slot[won]] = vals[won]
            h, vals, slot = h[~won], vals[~won], (slot[~won] + 1) & mask
