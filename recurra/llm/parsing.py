"""Document fingerprints by locally consistent parsing.

A text is a row of symbols, at first its UTF-8 bytes. On each level runs of equal
symbols join; deterministic coin tossing (the lowest bit in which a symbol
differs from the one before, repeated four times) leaves labels below six; phrases
begin at local maxima of the labels and are named by a hash of their symbols.
Whether a phrase begins at a place depends on a few symbols around it, so equal
substrings get equal phrases inside, wherever they stand. A fingerprint keeps the
smallest names of the second and the third level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recurra.llm.common import BLOCK_BYTES, U64, mix, prepare, written

#: Levels whose names a fingerprint keeps, and how many names of each.
LEVELS = (2, 3)
NAMES = 32
#: Leading characters of a text that help to cut ranges where an id repeats; the order within a range is by whole texts.
RANGE_CHARS = 16
_HEX = 8
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_PLACE = mix(np.arange(1000, 1000 + 4096, dtype=np.uint64)) | U64(1)


def _toss(label: np.ndarray, first: np.ndarray) -> np.ndarray:
    """2k + bit k of each label, where k is the lowest bit in which it differs from the one before."""
    before = np.empty_like(label)
    before[1:] = label[:-1]
    before[first] = label[first] ^ label.dtype.type(1)
    differs = label ^ before
    k = np.bitwise_count((differs & (~differs + differs.dtype.type(1))) - differs.dtype.type(1)).astype(label.dtype)
    return ((k << label.dtype.type(1)) | ((label >> k) & label.dtype.type(1))).astype(np.uint8)


def _level(symbol: np.ndarray, starts: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Phrase names of the next level and where each row's begin. Rows without symbols are left out of `starts`."""
    n = len(symbol)
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(symbol[1:], symbol[:-1], out=new[1:])
    new[starts] = True
    at = np.flatnonzero(new)
    run = np.diff(at, append=n)
    kind = symbol[at]
    first = np.searchsorted(at, starts)
    label = kind
    for _ in range(4):
        label = _toss(label, first)
    # A phrase begins at each row's first run and at every local maximum that isn't next to it.
    peak = np.zeros(len(label), bool)
    if len(label) > 2:
        peak[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    ends = np.append(first[1:], len(label)) - 1
    peak[ends] = False
    inner = first + 1
    peak[inner[inner < len(label)]] = False
    peak[first] = True
    begin = np.flatnonzero(peak)
    place = np.arange(len(label)) - np.repeat(begin, np.diff(begin, append=len(label)))
    value = (_BYTE[kind] if kind.dtype == np.uint8 else kind) + run.astype(U64) * U64(0xA0761D6478BD642F)
    value = mix(value) * _PLACE[place % len(_PLACE)]
    name = mix(np.add.reduceat(value, begin) + U64(number))
    return name, np.searchsorted(begin, first)


def fingerprints(texts: list[bytes]) -> list[str]:
    """A fingerprint per text: the smallest names of each level as hexadecimal, levels parted by a colon; equal texts have equal ones."""
    sizes = np.array([len(t) for t in texts], np.int64)
    full = np.flatnonzero(sizes)
    out = [[""] * len(LEVELS) for _ in texts]
    if len(full):
        symbol = np.frombuffer(b"".join(texts), np.uint8)
        starts = (np.cumsum(sizes) - sizes)[full]
        for number in range(1, max(LEVELS) + 1):
            symbol, starts = _level(symbol, starts, number)
            if number in LEVELS:
                names = (symbol >> U64(32)).astype(">u4")
                stops = np.append(starts[1:], len(names))
                for row, a, b in zip(full.tolist(), starts.tolist(), stops.tolist(), strict=True):
                    out[row][LEVELS.index(number)] = np.unique(names[a:b])[:NAMES].astype(">u4").tobytes().hex()
    return [":".join(x) for x in out]


def likeness(a: str, b: str) -> float:
    """The mean over the levels of the estimated Jaccard likeness of their names, 0 to 1; empty texts are alike."""
    total = 0.0
    for x, y in zip(a.split(":"), b.split(":"), strict=True):
        left = {x[i : i + _HEX] for i in range(0, len(x), _HEX)}
        right = {y[i : i + _HEX] for i in range(0, len(y), _HEX)}
        smallest = sorted(left | right)[:NAMES]
        total += sum(s in left and s in right for s in smallest) / len(smallest) if smallest else 1.0
    return total / len(LEVELS)


def edit(text: str, following: str) -> str:
    """The text with its last third (rounded down) replaced by as many leading characters of the following one, or all of it."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _result(rows: list[tuple], following: list[tuple]) -> dict[str, list]:
    """rows and following: (id, text, fingerprint)."""
    changed = [edit(r[1], f[1]) for r, f in zip(rows, following, strict=True)]
    raw = [t.encode() for t in changed]
    prints = fingerprints(raw)
    return {
        "id": [r[0] for r in rows], "n_chars": [len(r[1]) for r in rows], "edited_sha256": [hashlib.sha256(t).hexdigest() for t in raw], "fingerprint": [r[2] for r in rows], "edited_fingerprint": prints,
        "near_edited": [likeness(r[2], p) for r, p in zip(rows, prints, strict=True)], "near_next": [likeness(r[2], f[2]) for r, f in zip(rows, following, strict=True)],
    }


def with_neighbours(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The next document is the one that follows in descending order of id (ties: by
    text; null ids last), after the last the first. Null texts count as empty.
    Repeated rows are kept; a single row follows itself; an empty table gives no
    rows; other columns are ignored. Rows are dealt by ranges of ids and beginnings
    of texts, since whole texts in the sample that cuts the ranges would pass through
    the driver; a task sees the next row of its own range, and the ends of ranges meet
    in a join.
    """
    spark = prepare(df.sparkSession)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("id").desc_nulls_last(), F.col("text")]
    dealt = docs.repartitionByRange(n, order[0], F.substring("text", 1, RANGE_CHARS)).sortWithinPartitions(*order)
    kind = docs.schema["id"].dataType.simpleString()
    # Names and digests are written as bytes, half as long as their text.
    fields = "n_chars long, edited_sha256 binary, fingerprint array<binary>, edited_fingerprint array<binary>, near_edited double, near_next double"

    def batch(got: dict[str, list], id_type: pa.DataType, role: int, part: int, texts: list | None = None) -> pa.RecordBatch:
        size = len(got["id"])
        names = pa.list_(pa.binary())
        types = {"id": id_type, "n_chars": pa.int64(), "edited_sha256": pa.binary(), "fingerprint": names, "edited_fingerprint": names, "near_edited": pa.float64(), "near_next": pa.float64()}
        got = dict(got)
        if "edited_sha256" in got:
            got["edited_sha256"] = [bytes.fromhex(x) for x in got["edited_sha256"]]
        for name in {"fingerprint", "edited_fingerprint"} & set(got):
            got[name] = [[bytes.fromhex(level) for level in x.split(":")] for x in got[name]]
        columns = {k: pa.array(got.get(k) or [None] * size, t) for k, t in types.items()}
        columns |= {"role": pa.array([role] * size, pa.int32()), "part": pa.array([part] * size, pa.int32()), "text": pa.array(texts or [None] * size, pa.string())}
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, started, held, size, id_type = TaskContext.get().partitionId(), False, [], 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal started, held
            fresh = [i for i, r in enumerate(held) if r[2] is None]
            for i, p in zip(fresh, fingerprints([held[i][1].encode() for i in fresh]), strict=True):
                held[i] = (*held[i][:2], p)
            if not started:
                started = True
                yield batch({"id": [held[0][0]], "fingerprint": [held[0][2]]}, id_type, 1, part, [held[0][1]])
            if len(held) > 1:
                yield batch(_result(held[:-1], held[1:]), id_type, 0, part)
            held = held[-1:]

        for incoming in batches:
            id_type = incoming.schema.field(0).type
            for doc, text in zip(incoming.column(0).to_pylist(), incoming.column(1).to_pylist(), strict=True):
                held.append((doc, text, None))
                size += len(text)
                if size >= BLOCK_BYTES:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()
            yield batch({"id": [held[0][0]], "fingerprint": [held[0][2]]}, id_type, 2, part, [held[0][1]])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            rows = list(zip(*(got.column(i).to_pylist() for i in range(3)), strict=True))
            following = list(zip([None] * len(rows), *(got.column(i).to_pylist() for i in (3, 4)), strict=True))
            found = _result(rows, following)
            made = batch(found, got.schema.field(0).type, 0, 0)
            yield made.select([c for c in made.schema.names if c not in ("role", "part", "text")])

    def as_text(name: str) -> Column:
        return F.array_join(F.transform(name, lambda level: F.lower(F.hex(level))), ":")

    found = written(dealt.mapInArrow(run, f"id {kind}, {fields}, role int, part int, text string"), "parsed")
    inside = found.where("role = 0").drop("role", "part", "text")
    # One row per range: the range after it, or the first again.
    ranges = found.where("role = 1").select("part")
    after = ranges.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("next"))
    firsts = found.where("role = 1").select(F.col("part").alias("next"), F.col("text").alias("next_text"), as_text("fingerprint").alias("next_print"))
    ends = found.where("role = 2").select("part", "id", "text", as_text("fingerprint").alias("fingerprint")).join(after, "part").join(firsts, "next").select("id", "text", "fingerprint", "next_text", "next_print")
    rows = inside.unionByName(ends.mapInArrow(meet, f"id {kind}, {fields}"))
    texts = {"edited_sha256": F.lower(F.hex("edited_sha256")), "fingerprint": as_text("fingerprint"), "edited_fingerprint": as_text("edited_fingerprint")}
    return rows.withColumns(texts).withColumnRenamed("id", id_col)
