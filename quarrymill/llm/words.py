"""Vectorised words, hashes and shingles over Arrow text columns.

A word is ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; everything works on UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_STEPS = np.array([0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 0x2545F4914F6CDD1D, 0xF1357AEA2E62A9C5, 0x9FB21C651E98DF25], np.uint64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES * 2)
        inverse = pow(_BASE, -1, 1 << 64)
        for k, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a text column; null counts as empty."""
    col = pc.fill_null(col, "") if col.null_count else col
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``size`` bytes of text; a longer text is a run of its own."""
    data, offsets = buffers(batch.column(text))
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        j = min(j, n)
        yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Words:
    """Words of a run of texts: lower-cased bytes, byte bounds, and for each text the range of its words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = _LOWER[data]
        n = len(data)
        space = _SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.ones(n, bool)
        before[1:] = space[:-1]
        self.starts = np.flatnonzero(~space & (before | edge[:-1]))
        after = np.ones(n, bool)
        after[:-1] = space[1:]
        self.ends = np.flatnonzero(~space & (after | edge[1:])) + 1
        self.bounds = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        up, down = _grown(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * down[self.starts])

    def shingles(self, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``k`` words (all words as one run in shorter texts), and the range of each text."""
        h, b = self.hashes(), self.bounds
        counts = np.diff(b)
        m = len(h)
        step = _STEPS if k <= len(_STEPS) else mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
        s = np.zeros(max(m, 0), np.uint64)
        for j in range(k):
            if m > j:
                s[: m - j] += h[j:] * step[j]
        full = np.zeros(m, bool)
        left = np.repeat(b[1:], counts) - np.arange(m)
        full = left >= k
        short = np.flatnonzero((counts > 0) & (counts < k))
        for i in short:
            a, e = b[i], b[i + 1]
            s[a] = (int((h[a:e] * step[: e - a]).sum(dtype=np.uint64)) + int(e - a) * 0x632BE59BD9B4E019) % (1 << 64)
            full[a] = True
        per = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
        return mix(s[full]), np.concatenate([[0], np.cumsum(per)])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
