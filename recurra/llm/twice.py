"""Fixed-size bit sets of the values that may occur in more than one document.

They only save work: where one fills up, it lets everything through.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurra.llm.common import U64

_SCHEMA = "part long, once binary, twice binary, counts binary"
#: Values that a task holds as a list before it turns to bit sets.
HELD = 1 << 21


def _set(bits: np.ndarray, low: np.ndarray) -> None:
    """Set the bits at sorted places."""
    if len(low):
        at = low >> 3
        first = np.flatnonzero(np.diff(at, prepend=-1))
        bits[at[first]] |= np.bitwise_or.reduceat(np.left_shift(1, low & 7).astype(np.uint8), first)


def _get(bits: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (bits[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1


class _Marks:
    """The places seen once at least, and twice at least."""

    def __init__(self, power: int, cells: int):
        self.power, self.held, self.n, self.bits = power, [], 0, None
        self.cells, self.counts = cells, np.zeros(1 << cells, np.int64)

    def add(self, values: np.ndarray) -> None:
        low = (values & U64((1 << self.power) - 1)).astype(np.int64)
        self.counts += np.bincount((values >> U64(64 - self.cells)).astype(np.int64), minlength=len(self.counts)) if self.cells else len(low)
        self.held.append(low)
        self.n += len(low)
        if self.n > HELD:
            self._fold()

    def _sorted(self) -> tuple[np.ndarray, np.ndarray]:
        low = np.sort(np.concatenate(self.held)) if self.held else np.empty(0, np.int64)
        new = np.diff(low, prepend=-1) > 0
        self.held, self.n = [], 0
        return low[new], np.unique(low[~new])

    def _fold(self) -> None:
        if self.bits is None:
            self.bits = np.zeros((2, 1 << (self.power - 3)), np.uint8)
        once, twice = self._sorted()
        _set(self.bits[1], np.union1d(twice, once[_get(self.bits[0], once)]))
        _set(self.bits[0], once)

    def merge(self, once: bytes, twice: bytes, counts: bytes) -> None:
        self.counts += np.frombuffer(zlib.decompress(counts), np.int64)
        if once[:1] == b"s":
            a, b = (np.cumsum(np.frombuffer(zlib.decompress(x[1:]), "<u4").astype(np.int64)) for x in (once, twice))
            self.held += [a, b]
            self.n += len(a) + len(b)
            if self.n > HELD:
                self._fold()
            return
        self._fold()
        a, b = (np.frombuffer(zlib.decompress(x[1:]), np.uint8) for x in (once, twice))
        self.bits[1] |= b | (self.bits[0] & a)
        self.bits[0] |= a

    def packed(self, part: int) -> pa.RecordBatch:
        if self.bits is None:
            raw = [b"s" + zlib.compress(np.diff(x, prepend=0).astype("<u4").tobytes(), 1) for x in self._sorted()]
        else:
            self._fold()
            raw = [b"d" + zlib.compress(x, 1) for x in self.bits]
        raw.append(zlib.compress(self.counts, 1))
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), *(pa.array([r], pa.binary()) for r in raw)], names=["part", "once", "twice", "counts"])


def met_twice(rows: DataFrame, values: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], power: int, cells: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A bit set of 2 ** power bits over the low bits of all values that two documents may share.

    And a sketch of their counts: 2 ** cells sums by the high bits. `values` yields 64-bit values, each at most once per document. Tasks merge their
    sets in two rounds; the size of what each holds is fixed.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = _Marks(power, cells)
        for v in values(batches):
            marks.add(v)
        yield marks.packed(TaskContext.get().partitionId())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = _Marks(power, cells)
        for batch in batches:
            for sets in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                marks.merge(*sets)
        yield marks.packed(0)

    few = rows.mapInArrow(mark, _SCHEMA).repartition(16, F.col("part") % 16).mapInArrow(merge, _SCHEMA)
    out, counts = np.zeros(1 << (power - 3), np.uint8), np.zeros(1 << cells, np.int64)
    for raw, sums in few.coalesce(1).mapInArrow(merge, _SCHEMA).select("twice", "counts").collect():
        counts = np.frombuffer(zlib.decompress(sums), np.int64)
        if raw[:1] == b"d":
            out = np.frombuffer(zlib.decompress(raw[1:]), np.uint8)
        else:
            _set(out, np.cumsum(np.frombuffer(zlib.decompress(raw[1:]), "<u4").astype(np.int64)))
    return out, counts


def has(bits: np.ndarray, values: np.ndarray, power: int) -> np.ndarray:
    return _get(bits, (values & U64((1 << power) - 1)).astype(np.int64))
