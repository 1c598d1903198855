"""Best-fit packing of documents into fixed-size sequences.

Bounded-space online best-fit: a task keeps a fixed number of open bins in a
bitset keyed by free space. A piece goes to the bin with the least room that
still takes it; when there are too many open bins, the fullest closes. Bins that
are still open when a task ends are packed again, together with those of other
tasks, in rounds over ever fewer tasks.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurra.llm.common import blocks, prepare, written
from recurra.llm.tokenized import RunTokenizer

CAPACITY = 2048
OPEN_BINS = 512
#: Tasks whose open bins one task of the next round packs.
FAN_IN = 32
#: A bin with less room than this part of the capacity counts as full when its task ends.
FULL = 1 / 256

_FIELDS = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_())]
_SCHEMA = "piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, open boolean"


class Packer:
    """Open bins by free space. `put` yields the rows of bins as they close."""

    def __init__(self, capacity: int, limit: int, first: int):
        self.capacity, self.limit, self.next = capacity, limit, first
        self.bits = 0  # bit f is set if some open bin has f free places
        self.bins: dict[int, list[list]] = defaultdict(list)
        self.n_open = 0

    def _take(self, free: int) -> list:
        found = self.bins[free].pop()
        if not self.bins[free]:
            self.bits ^= 1 << free
        self.n_open -= 1
        return found

    def _keep(self, free: int, rows: list) -> None:
        self.bins[free].append(rows)
        self.bits |= 1 << free
        self.n_open += 1

    def _closed(self, rows: list, is_open: bool = False) -> Iterator[tuple]:
        at = 0
        for row in rows:
            yield (*row, self.next, at, is_open)
            at += row[3]
        self.next += 1

    def put(self, row: tuple) -> Iterator[tuple]:
        """row: id, piece, start, length, crc."""
        length = row[3]
        room = self.bits >> length
        if room:
            free = length + (room & -room).bit_length() - 1
            rows = self._take(free)
        else:
            free, rows = self.capacity, []
        rows.append(row)
        if free == length:
            yield from self._closed(rows)
            return
        self._keep(free - length, rows)
        if self.n_open > self.limit:
            fullest = (self.bits & -self.bits).bit_length() - 1
            yield from self._closed(self._take(fullest))

    def finish(self, last: bool) -> Iterator[tuple]:
        for free in sorted(self.bins):
            for rows in self.bins[free]:
                yield from self._closed(rows, not last and free > self.capacity * FULL)


def _batch(rows: list[tuple], id_field: pa.Field) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    types = [id_field.type, *(t for _, t in _FIELDS)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[id_field.name, *(n for n, _ in _FIELDS)])


def _first(level: int) -> int:
    return (level << 56) | (TaskContext.get().partitionId() << 32)


def _rows_out(rows: Iterator[tuple], id_field: pa.Field) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == 8192:
            yield _batch(held, id_field)
            held = []
    if held:
        yield _batch(held, id_field)


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, open_bins: int = OPEN_BINS, end_id: int = 0) -> DataFrame:
    """Cut tokenised documents into pieces of at most `capacity` ids and place them in sequences.

    A document's ids are the tokenizer's, followed by `end_id`. Returns a row per
    piece: id, piece, start, length, ids_crc32, sequence_id, offset. A null text
    counts as empty and gives the end id alone; a null id is kept; repeated rows are
    packed each on its own; an empty table gives no rows; other columns are ignored.
    Bounded memory: `open_bins` bins per task, whatever the size of the table.
    """
    prepare(df.sparkSession)
    docs = df.select(F.col(id_col), F.col(text_col).alias("__text"))
    schema = f"{docs.schema[0].name} {docs.schema[0].dataType.simpleString()}, {_SCHEMA}"

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, packer = RunTokenizer(tokenizer_path), Packer(capacity, open_bins, _first(0))
        end, size, field = np.array([end_id], "<u4").tobytes(), 4 * capacity, None

        def placed() -> Iterator[tuple]:
            nonlocal field
            for block in blocks(batches, "__text"):
                field = block.schema.field(0)
                for doc, text in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True):
                    ids = tokenizer.encode(text or "") + end
                    for i in range(0, len(ids), size):
                        raw = ids[i : i + size]
                        yield from packer.put((doc, i // size, i // 4, len(raw) // 4, zlib.crc32(raw)))
            yield from packer.finish(False)

        # The field is known once the first row is there.
        held = []
        for row in placed():
            held.append(row)
            if len(held) == 8192:
                yield _batch(held, field)
                held = []
        if held:
            yield _batch(held, field)

    def later_round(level: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packer, field = Packer(capacity, open_bins, _first(level)), None
            held = []
            for batch in batches:
                field = batch.schema.field(0)
                columns = [c.to_pylist() for c in batch.columns]
                for row in zip(*columns, strict=True):
                    held += packer.put(row)
                if len(held) > 8192:
                    yield _batch(held, field)
                    held = []
            held += packer.finish(last)
            yield from _rows_out(iter(held), field)

        return run

    level, tasks = 0, max(docs.rdd.getNumPartitions(), 1)
    done = written(docs.mapInArrow(first_round, schema), "packed")
    parts = [done.where("not open")]
    rest = done.where("open")
    while tasks > 0:
        level, tasks = level + 1, -(-tasks // FAN_IN)
        narrow = rest.select(id_col, "piece", "start", "length", "ids_crc32").coalesce(tasks)
        done = narrow.mapInArrow(later_round(level, tasks == 1), schema)
        if tasks == 1:
            parts.append(done)
            break
        done = written(done, "packed")
        parts.append(done.where("not open"))
        rest = done.where("open")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.drop("open")
