"""Vectorised work on whole Arrow batches of texts, for the operators that run numpy in tasks."""

from __future__ import annotations

import ctypes
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed odd multiplier of the word hash, and the multipliers of its finaliser.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Bytes of text that are worked on at a time, so that memory doesn't depend on the batch.
CHUNK_BYTES = 2_000_000


def give_back() -> None:
    """Return freed memory to the system, where that can be asked for.

    Python workers live on through later stages, and what one stage has freed but kept adds to what
    the next one takes.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim is not None:
        trim(0)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def chunks(batch: pa.RecordBatch, text: str):
    """Slices of a batch with about CHUNK_BYTES of text each; a longer text is a slice of its own."""
    sizes = batch.column(text)
    lengths = np.asarray(pc.fill_null(pc.binary_length(sizes), 0), dtype=np.int64)
    group = np.cumsum(lengths) // CHUNK_BYTES
    cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else []
    for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
        yield batch.slice(int(a), int(b - a))


class Words:
    """The words of a column of texts: hashes, byte ranges and the row each belongs to.

    Words are runs of bytes other than blank and tab to carriage return; null counts as empty.
    ``fold`` lower-cases A to Z. ``hashes`` are 64 bits of a word's bytes.
    """

    def __init__(self, column: pa.Array, fold: bool = False):
        column = pc.fill_null(column.cast(pa.large_string()), "")
        data = column.buffers()[2]
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
        offsets = offsets - offsets[0]
        self.rows = len(column)
        if fold and len(raw):
            raw = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
        self.raw, self.offsets = raw, offsets
        gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
        first = ~gap
        first[1:] &= gap[:-1]
        edges = offsets[:-1][offsets[:-1] < len(raw)]
        first[edges] = ~gap[edges]
        self.starts = np.flatnonzero(first)
        last = ~gap
        last[:-1] &= gap[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner <= len(raw))] - 1
        last[inner] = ~gap[inner]
        self.ends = np.flatnonzero(last) + 1
        self.row = np.searchsorted(offsets, self.starts, "right") - 1
        self.counts = np.bincount(self.row, minlength=self.rows)
        self.first = np.r_[0, np.cumsum(self.counts)]
        self.hashes = self._hashes(gap)

    def _hashes(self, gap: np.ndarray) -> np.ndarray:
        if not len(self.starts):
            return np.empty(0, np.uint64)
        lengths = self.ends - self.starts
        place = np.arange(len(self.raw), dtype=np.int64)
        inside = np.maximum(np.cumsum(np.bincount(self.starts, minlength=len(self.raw)).astype(np.int32)) - 1, 0)
        place -= self.starts[inside]
        np.maximum(place, 0, out=place)
        place[gap] = 0
        values = (self.raw.astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()) + 1)[place]
        values[gap] = 0
        return mixed(np.add.reduceat(values, self.starts) + lengths.astype(np.uint64) * MIX[1])

    def runs(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of ``width`` words inside one row, and the index of its first word."""
        n = len(self.hashes) - width + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        joined = mixed(self.hashes[:n])
        for j in range(1, width):
            joined = mixed(joined * np.uint64(3) + self.hashes[j : n + j])
        at = np.flatnonzero(self.row[:n] == self.row[width - 1 :])
        return joined[at], at
