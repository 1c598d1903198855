"""Removal of passages that stand in an earlier document, by suffix sorting.

A passage is a string of `length` bytes. Each is dealt by the smallest hash of the
16-byte strings in it, so equal passages meet in one shard, and neighbouring
passages with the same smallest hash travel as one context. First only the
hashes travel, to find those that two documents have. A shard keeps each distinct
context once. Contexts that share their key but differ are joined to one
text, whose suffixes are put in order by induced sorting: suffixes at local minima
are ordered first, all others follow from them through one queue per first byte,
which moves to disk when it grows. Runs of neighbours with a common prefix of
`length` bytes are equal passages; each loses to the smallest document id.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from recurra.llm.common import U64, blocks, flat, mix, prepare, run_hashes

LENGTH = 50
#: Bytes whose hash deals a passage; fewer than `length`.
ANCHOR = 16
#: Keys of one shard, about.
SHARD_KEYS = 400_000
#: A key with more than this many contexts that differ is dealt by single passages, so that no shard gets them all.
#: A bucket's equal contexts count once; one longer than UNIT bytes counts once for each UNIT begun, so a key has 2 MiB at most.
HOT = 16384
UNIT = 128
#: Text bytes of one bucket of documents, at least and at most.
BUCKET_BYTES = (1 << 20, 32 << 20)
#: Entries of the queues that stay in memory, over all bytes.
QUEUE_ROWS = 1 << 22
_LAST = np.iinfo(np.int64).max


class Queues:
    """A first-in first-out queue of positions per symbol: a priority queue whose priority is the symbol.

    Beyond `limit` positions in memory the longest queues are appended to a scratch
    file of the task, as a shuffle spills; it goes when the task ends, and a
    retried task makes it anew.
    """

    def __init__(self, symbols: int, limit: int):
        self.parts: list[list] = [[] for _ in range(symbols)]
        self.sizes = np.zeros(symbols, np.int64)
        self.limit, self.file = limit, None

    def push(self, keys: np.ndarray, positions: np.ndarray) -> None:
        """Append positions to the queues of their keys, keeping their order."""
        order = np.argsort(keys, kind="stable")
        keys, positions = keys[order], positions[order]
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for key, part in zip(keys[np.concatenate([[0], cuts])].tolist() if len(keys) else [], np.split(positions, cuts), strict=False):
            self.parts[key].append(part)
            self.sizes[key] += len(part)
        while self.sizes.sum() > self.limit:
            self._spill(int(self.sizes.argmax()))

    def _spill(self, key: int) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for i, part in enumerate(self.parts[key]):
            if isinstance(part, np.ndarray):
                self.parts[key][i] = (self.file.tell(), len(part))
                self.file.write(part.tobytes())
        self.sizes[key] = 0

    def pop(self, key: int) -> np.ndarray:
        out = []
        for part in self.parts[key]:
            if not isinstance(part, np.ndarray):
                self.file.seek(part[0])
                part = np.frombuffer(self.file.read(8 * part[1]), np.int64)
            out.append(part)
        self.parts[key], self.sizes[key] = [], 0
        return np.concatenate(out) if out else np.empty(0, np.int64)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _order_minima(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The given suffixes in order of their first `depth` symbols, eight more at a time among those still equal."""
    word = np.ndarray(len(text) + depth + 8, ">u8", np.concatenate([text, np.zeros(depth + 16, np.uint8)]).tobytes(), strides=(1,))
    order = np.arange(len(at))
    # Those still equal to another: which, their places in the order, and the first place of their equals.
    which, place, rank = order.copy(), order.copy(), np.zeros(len(at), np.int64)
    for step in range(0, depth, 8):
        key = word[at[which] + step].astype(U64)
        sub = np.lexsort((key, rank))
        which, key, rank = which[sub], key[sub], rank[sub]
        order[place] = which
        new = np.ones(len(which), bool)
        new[1:] = (key[1:] != key[:-1]) | (rank[1:] != rank[:-1])
        first = np.flatnonzero(new)
        rank = np.repeat(place[first], np.diff(first, append=len(which)))
        several = ~(new & np.append(new[1:], True))
        which, place, rank = which[several], place[several], rank[several]
        if not len(which):
            break
    return at[order]


def suffix_order(text: np.ndarray, depth: int, queue_rows: int = QUEUE_ROWS) -> np.ndarray:
    """All suffixes in order, up to the order of those that agree in `depth` symbols.

    `text` holds bytes; 0 ends every piece and stands last.
    """
    n = len(text)
    step = np.diff(text.astype(np.int32))
    turns = np.flatnonzero(step)
    small = np.ones(n, bool)  # smaller than the suffix after it
    if len(turns):
        after = np.minimum(np.searchsorted(turns, np.arange(n - 1)), len(turns) - 1)
        small[:-1] = step[turns[after]] > 0
    minima = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    ordered = _order_minima(text, minima, depth)
    starts = ordered[np.argsort(text[ordered], kind="stable")]
    bounds = np.searchsorted(text[starts], np.arange(257))
    large = Queues(256, queue_rows)
    first: list[np.ndarray] = []
    for symbol in range(256):
        done, now = [], large.pop(symbol)
        while len(now):
            done.append(now)
            before = now[now > 0] - 1
            before = before[~small[before]]
            key = text[before]
            large.push(key[key > symbol], before[key > symbol])
            now = before[key == symbol]
        first.append(np.concatenate(done) if done else np.empty(0, np.int64))
        before = starts[bounds[symbol] : bounds[symbol + 1]]
        before = before[before > 0] - 1
        before = before[~small[before]]
        large.push(text[before], before)
    large.close()
    rest = Queues(256, queue_rows)
    out: list[np.ndarray] = []
    for symbol in range(255, -1, -1):
        done, now = [], rest.pop(symbol)
        if symbol == 0:
            now = np.append(now, n - 1)  # the end of the text follows from nothing
        while len(now):
            done.append(now)
            before = now[now > 0] - 1
            before = before[small[before]]
            key = text[before]
            rest.push(key[key < symbol], before[key < symbol])
            now = before[key == symbol]
        before = first[symbol][::-1]
        out += [*done, before]
        before = before[before > 0] - 1
        before = before[small[before]]
        rest.push(text[before], before)
    rest.close()
    return np.concatenate(out)[::-1]


def equal_passages(contexts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Passages of the contexts that are equal: (context, offset, group), groups of two and more numbered from 0.

    Contexts are UTF-8, so no byte is 255 and each can move up by one to leave 0 for the ends.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    text = np.zeros(int(sizes.sum()) + len(contexts), np.uint8)
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    inner = np.ones(len(text), bool)
    inner[ends - 1] = False
    text[inner] = np.frombuffer(b"".join(contexts), np.uint8) + np.uint8(1)
    order = suffix_order(text, length)
    owner = np.searchsorted(ends, order, "right")
    whole = order + length < ends[owner]
    order, owner = order[whole], owner[whole]
    window = np.lib.stride_tricks.sliding_window_view(text, length) if len(text) >= length else np.empty((0, length), np.uint8)
    same = np.zeros(len(order), bool)
    for a in range(1, len(order), 1 << 16):
        b = min(a + (1 << 16), len(order))
        same[a:b] = (window[order[a:b]] == window[order[a - 1 : b - 1]]).all(axis=1)
    group = np.cumsum(~same) - 1
    many = same | np.append(same[1:], False)
    return owner[many], order[many] - starts[owner[many]], np.unique(group[many], return_inverse=True)[1]


def _keys(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of passages with the same key: key, row, first byte, bytes covered; places within all bytes."""
    n = len(data)
    none = np.empty(0, np.int64)
    if n < length:
        return none.astype(U64), none, none, none
    word = np.ndarray(n - 7, "<u8", np.ascontiguousarray(data).tobytes(), strides=(1,))
    m = n - ANCHOR + 1
    key = word[:m] * U64(0x9E3779B97F4A7C15) + (word[8 : m + 8] ^ (word[:m] >> U64(29))) * U64(0xC2B2AE3D27D4EB4F)
    key ^= key >> U64(32)
    key *= U64(0xD6E8FEB86659FD93)
    key ^= key >> U64(29)
    span, want = 1, length - ANCHOR + 1
    while span < want:
        by = min(span, want - span)
        key = np.minimum(key[:-by], key[by:])
        span += by
    begin = np.repeat(offsets[1:], np.diff(offsets))[: len(key)] - np.arange(len(key)) >= length
    new = begin.copy()
    new[1:] &= (key[1:] != key[:-1]) | ~begin[:-1]
    # A document's end makes passages that reach over it unusable, so runs never cross documents.
    at = np.flatnonzero(new)
    stop = np.flatnonzero(begin & np.append(new[1:] | ~begin[1:], True))
    return key[at], np.searchsorted(offsets, at, "right") - 1, at, stop - at + length


def _cut(raw: bytes) -> tuple:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    bucket, docs, n = np.frombuffer(raw, "<i8", 3)
    doc, row = np.frombuffer(raw, "<i8", 2 * docs, 24).reshape(2, -1)
    at = 24 + 16 * docs
    key = np.frombuffer(raw, "<u8", n, at)
    who, start, size = np.frombuffer(raw, "<u4", 3 * n, at + 8 * n).reshape(3, -1)
    return bucket, doc, row, key, who, start, size, raw[at + 20 * n :]


def _shard_spans(blobs: Iterator[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Removed spans (row, bucket, start, end) of one shard."""
    known: dict[bytes, int] = {}
    keys: list[int] = []
    rows: list[tuple[np.ndarray, ...]] = []
    for raw in blobs:
        bucket, doc, row, key, who, start, size, text = _cut(raw)
        ends = np.cumsum(size.astype(np.int64))
        of = np.empty(len(key), np.int64)
        for i, (a, b, k) in enumerate(zip((ends - size).tolist(), ends.tolist(), key.tolist(), strict=True)):
            context = text[a:b]
            c = known.setdefault(context, len(keys))
            if c == len(keys):
                keys.append(k)
            of[i] = c
        rows.append((of, doc[who], row[who], np.full(len(of), bucket), start.astype(np.int64), size.astype(np.int64)))
    if not rows:
        return
    of, doc, row, bucket, start, size = (np.concatenate(x) for x in zip(*rows, strict=True))
    owner = np.full(len(keys), _LAST)
    np.minimum.at(owner, of, doc)
    later = doc > owner[of]
    yield row[later], bucket[later], start[later], start[later] + size[later]
    key = np.array(keys, U64)
    _, of_key, count = np.unique(key, return_inverse=True, return_counts=True)
    chosen = np.flatnonzero(count[of_key] > 1)
    if not len(chosen):
        return
    texts = list(known)
    context, offset, group = equal_passages([texts[i] for i in chosen], length)
    context = chosen[context]
    smallest = np.full(int(group.max()) + 1 if len(group) else 0, _LAST)
    np.minimum.at(smallest, group, owner[context])
    lost = owner[context] > smallest[group]
    if not lost.any():
        return
    context, offset = context[lost], offset[lost]
    order = np.lexsort((offset, context))
    context, offset = context[order], offset[order]
    new = np.ones(len(context), bool)
    new[1:] = (context[1:] != context[:-1]) | (offset[1:] != offset[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(context)) - 1
    spans: dict[int, list[tuple[int, int]]] = {}
    for c, a, b in zip(context[first].tolist(), offset[first].tolist(), (offset[last] + length).tolist(), strict=True):
        spans.setdefault(c, []).append((a, b))
    # Occurrences of a context in its own smallest document; those in later ones are gone already.
    hit = np.flatnonzero((doc == owner[of]) & np.isin(of, list(spans)))
    out = [(int(row[i]), int(bucket[i]), int(start[i]) + a, int(start[i]) + b) for i in hit.tolist() for a, b in spans[int(of[i])]]
    if out:
        yield tuple(np.array(x, np.int64) for x in zip(*out, strict=True))


@dataclass(frozen=True)
class _Spread:
    """Documents dealt by row into buckets of bounded size, once; every step reads the same exchange."""

    docs: DataFrame
    shards: int


def _spread(df: DataFrame, id_col: str, text_col: str, length: int) -> _Spread:
    if not isinstance(df.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col}: passages are ordered by ids of an integer type, not {df.schema[id_col].dataType.simpleString()}")
    total = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    # Buckets grow with the square root of the input, so that a bucket still has several keys for each shard.
    bytes_each = min(max(int((total * 4096) ** 0.5), BUCKET_BYTES[0]), BUCKET_BYTES[1])
    buckets = max(1, -(-total // bytes_each))
    # About two keys for every 36 bytes.
    shards = max(12, int(total * 2 // (length - ANCHOR + 2) // SHARD_KEYS))
    rows = df.withColumn("__row", F.monotonically_increasing_id()).withColumn("__doc", F.coalesce(F.col(id_col).cast("long"), F.lit(int(_LAST))))
    return _Spread(rows.withColumn("__bucket", F.pmod(F.xxhash64("__row"), F.lit(buckets)).cast("int")), shards)


def _shared_keys(spread: _Spread, text_col: str, length: int) -> DataFrame:
    """(bucket, shard, bits): for a bucket's keys in order, which two documents have, and then which are hot."""
    shards = spread.shards
    bucket_at, text_at = spread.docs.columns.index("__bucket"), spread.docs.columns.index(text_col)

    def collect(group: pa.Table) -> pa.Table:
        keys, several, shard, units = _bucket_keys(group.column(text_at), length, shards, sized=True)
        cuts = np.searchsorted(shard, np.arange(shards + 1))
        some = [s for s in range(shards) if cuts[s] < cuts[s + 1]]
        blobs = [zstandard.ZstdCompressor(1).compress(np.diff(keys[cuts[s] : cuts[s + 1]], prepend=U64(0)).tobytes() + units[cuts[s] : cuts[s + 1]].tobytes() + np.packbits(several[cuts[s] : cuts[s + 1]]).tobytes()) for s in some]
        sizes = [int(cuts[s + 1] - cuts[s]) for s in some]
        bucket = group.column(bucket_at)[0].as_py()
        return pa.table({"bucket": pa.array([bucket] * len(some), pa.int32()), "shard": pa.array(some, pa.int32()), "n": pa.array(sizes, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    def count(group: pa.Table) -> pa.Table:
        parts, sizes, flags = [], [], []
        for n, raw in zip(group.column(2).to_pylist(), group.column(3).to_pylist(), strict=True):
            raw = zstandard.ZstdDecompressor().decompress(raw)
            parts.append(np.cumsum(np.frombuffer(raw, U64, n), dtype=U64))
            sizes.append(np.frombuffer(raw, "<u4", n, 8 * n))
            flags.append(np.unpackbits(np.frombuffer(raw, np.uint8, offset=12 * n), count=n).astype(bool))
        keys = np.concatenate(parts)
        _, at, buckets_with = np.unique(keys, return_inverse=True, return_counts=True)
        many, hot = np.concatenate(flags) | (buckets_with[at] > 1), (np.bincount(at, np.concatenate(sizes)) > HOT)[at]
        ends = np.cumsum([len(x) for x in parts])
        bits = [np.packbits(np.concatenate([many[b - len(x) : b], hot[b - len(x) : b]])).tobytes() for x, b in zip(parts, ends.tolist(), strict=True)]
        return pa.table({"bucket": group.column(0), "shard": group.column(1), "bits": pa.array(bits, pa.binary())})

    keys = spread.docs.groupBy("__bucket").applyInArrow(collect, "bucket int, shard int, n int, blob binary")
    return keys.groupBy("shard").applyInArrow(count, "bucket int, shard int, bits binary")


def _bucket_keys(texts: pa.ChunkedArray, length: int, shards: int, sized: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys of a bucket by (shard, key), whether two of its documents have them, their shards, and, if `sized`, the units of their distinct contexts."""
    found = [(np.empty(0, U64), np.empty(0, np.int64), np.empty(0, U64), np.empty(0, np.uint32))]
    row_before = 0
    for chunk in texts.chunks:
        for part in blocks([pa.RecordBatch.from_arrays([chunk], names=["t"])], "t"):
            data, offsets = flat(part.column(0))
            key, row, begin, covered = _keys(data, offsets, length)
            context = run_hashes(data, begin, begin + covered) if sized and len(key) else np.zeros(len(key), U64)
            found.append((key, row + row_before, context, (-(-covered // UNIT)).astype(np.uint32)))
            row_before += part.num_rows
    key, row, context, units = (np.concatenate(x) for x in zip(*found, strict=True))
    shard = (mix(key) % U64(shards)).astype(np.int64)
    if not len(key):
        return key, np.zeros(0, bool), shard, units
    order = np.lexsort((context, key, shard))
    key, row, context, units, shard = key[order], row[order], context[order], units[order], shard[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    new[1:] |= context[1:] != context[:-1]
    several = np.minimum.reduceat(row, first) != np.maximum.reduceat(row, first)
    return key[first], several, shard[first], np.add.reduceat(np.where(new, units, 0).astype(np.uint32), first, dtype=np.uint32)


def find(spread: _Spread, text_col: str, length: int) -> DataFrame:
    """(__row, __bucket, start, end): byte spans, not merged, that are covered by passages of earlier documents.

    A null id counts as later than all others; rows with the same id don't take from each other.
    """
    shards = spread.shards
    at = {c: i for i, c in enumerate(spread.docs.columns)}
    flagged = _shared_keys(spread, text_col, length)

    def deal(group: pa.Table, bits: pa.Table) -> pa.Table:
        """The bucket's contexts with shared keys: one compressed blob per shard, each context once per id; and what is certain already."""
        out = {"shard": [], "kind": [], "blob": []}
        if group.num_rows and bits.num_rows:
            keys, _, shard, _ = _bucket_keys(group.column(at[text_col]), length, shards)
            cuts = np.searchsorted(shard, np.arange(shards + 1))
            many, hot = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
            for s, raw in zip(bits.column(1).to_pylist(), bits.column(2).to_pylist(), strict=True):
                n = int(cuts[s + 1] - cuts[s])
                both = np.unpackbits(np.frombuffer(raw, np.uint8), count=2 * n)
                many[cuts[s] : cuts[s + 1]], hot[cuts[s] : cuts[s + 1]] = both[:n], both[n:]
            wanted, hot = np.sort(keys[many]), np.sort(keys[hot])
            doc, row = group.column(at["__doc"]).to_numpy(), group.column(at["__row"]).to_numpy()
            bucket = group.column(at["__bucket"])[0].as_py()
            _contexts(group.column(at[text_col]), doc, row, bucket, wanted, hot, length, shards, out)
        return pa.table({"shard": pa.array(out["shard"], pa.int32()), "kind": pa.array(out["kind"], pa.int32()), "blob": pa.array(out["blob"], pa.binary())})

    dealt = spread.docs.groupBy("__bucket").cogroup(flagged.groupBy("bucket")).applyInArrow(deal, "shard int, kind int, blob binary")
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "kind")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feed = (r for batch in batches for r in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
        ahead = [next(feed, None)]

        def one(shard: int, kind: int) -> Iterator[bytes]:
            while ahead[0] is not None and ahead[0][:2] == (shard, kind):
                yield ahead[0][2]
                ahead[0] = next(feed, None)

        def given(blobs: Iterator[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
            for raw in blobs:
                yield tuple(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "<i8").reshape(4, -1))

        while ahead[0] is not None:
            shard, kind = ahead[0][:2]
            for spans in given(one(shard, kind)) if kind else _shard_spans(one(shard, kind), length):
                for a in range(0, len(spans[0]), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(x[a : a + (1 << 16)], pa.int64()) for x in spans], names=["__row", "__bucket", "start", "end"])

    return dealt.mapInArrow(remove, "__row long, __bucket long, start long, end long")


def _contexts(texts: pa.ChunkedArray, doc: np.ndarray, row_id: np.ndarray, bucket: int, wanted: np.ndarray, hot: np.ndarray, length: int, shards: int, out: dict[str, list]) -> None:
    keys, whos, starts, sizes, contexts = [], [], [], [], []
    before = 0
    for chunk in texts.chunks:
        for part in blocks([pa.RecordBatch.from_arrays([chunk], names=["t"])], "t"):
            data, offsets = flat(part.column(0))
            key, row, begin, covered = _keys(data, offsets, length)
            if len(wanted):
                keep = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key)
                raw = data.tobytes()
                key, row, begin, covered = key[keep], row[keep], begin[keep], covered[keep]
                if len(hot):
                    split = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
                    n = np.where(split, covered - length + 1, 1)
                    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    key, row, begin = np.repeat(key, n), np.repeat(row, n), np.repeat(begin, n) + step
                    single = np.repeat(split, n)
                    covered = np.where(single, length, np.repeat(covered, n))
                    which = np.flatnonzero(single)
                    key[which] = np.array([int.from_bytes(hashlib.blake2b(raw[a : a + length], digest_size=8).digest(), "little") for a in begin[which].tolist()], U64)
                keys.append(key)
                whos.append(row + before)
                starts.append(begin - offsets[row])
                sizes.append(covered)
                contexts += [raw[a:b] for a, b in zip(begin.tolist(), (begin + covered).tolist(), strict=True)]
            before += part.num_rows
    if not contexts:
        return
    key, who, start, covered = (np.concatenate(x) for x in (keys, whos, starts, sizes))
    # A context that an earlier document of the bucket has as well is gone; the others go on.
    known: dict[bytes, int] = {}
    of = np.array([known.setdefault(t, len(known)) for t in contexts], np.int64)
    owner = np.full(len(known), _LAST)
    np.minimum.at(owner, of, doc[who])
    later = doc[who] > owner[of]
    shard = (mix(key) % U64(shards)).astype(np.int64)
    gone = np.flatnonzero(later)
    if len(gone):
        a, b, w = start[gone], start[gone] + covered[gone], who[gone]
        new = np.ones(len(gone), bool)
        new[1:] = (w[1:] != w[:-1]) | (a[1:] > b[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(gone)) - 1
        spans = np.stack([row_id[w[first]], np.full(len(first), bucket), a[first], b[last]])
        out["shard"].append(bucket % shards)
        out["kind"].append(1)
        out["blob"].append(zstandard.ZstdCompressor(3).compress(spans.astype("<i8").tobytes()))
    rest = np.flatnonzero(~later)
    order = rest[np.argsort(shard[rest], kind="stable")]
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.unique(shard[order]).tolist():
        some = order[cuts[s] : cuts[s + 1]]
        used, local = np.unique(who[some], return_inverse=True)
        raw = b"".join([np.array([bucket, len(used), len(some)], "<i8").tobytes(), doc[used].tobytes(), row_id[used].tobytes(), key[some].tobytes(), local.astype("<u4").tobytes(), start[some].astype("<u4").tobytes(), covered[some].astype("<u4").tobytes(), *[contexts[i] for i in some.tolist()]])
        out["shard"].append(s)
        out["kind"].append(0)
        out["blob"].append(zstandard.ZstdCompressor(3).compress(raw))


def _merged(df: DataFrame, id_col: str, text_col: str, length: int, emit: Callable[[pa.Table, list], pa.Table], schema: str) -> DataFrame:
    """`emit` on every bucket with the spans of each of its rows."""
    prepare(df.sparkSession)
    spread = _spread(df, id_col, text_col, length)
    spans = find(spread, text_col, length)
    row_at = spread.docs.columns.index("__row")

    def run(group: pa.Table, found: pa.Table) -> pa.Table:
        row, spans_of = group.column(row_at).to_numpy(), [None] * group.num_rows
        if found.num_rows:
            who, start, end = (found.column(i).to_numpy() for i in (0, 2, 3))
            order = np.argsort(who, kind="stable")
            who, edges = who[order], np.stack([start, end], axis=1)[order]
            cuts = np.searchsorted(who, row), np.searchsorted(who, row, "right")
            spans_of = [edges[a:b] if a < b else None for a, b in zip(*(c.tolist() for c in cuts), strict=True)]
        return emit(group, spans_of)

    return spread.docs.groupBy("__bucket").cogroup(spans.withColumn("__bucket", F.col("__bucket").cast("int")).groupBy("__bucket")).applyInArrow(run, schema)


def _kept(text: bytes, spans: np.ndarray | None) -> tuple[bytes, int]:
    """The bytes outside all spans, and the number of maximal removed runs."""
    if spans is None:
        return text, 0
    cover = np.zeros(len(text) + 1, np.int32)
    np.add.at(cover, spans[:, 0], 1)
    np.add.at(cover, spans[:, 1], -1)
    gone = np.cumsum(cover[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), runs


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for every row.

    Every byte covered by a `length`-byte string that also starts in a document with
    a smaller id goes, judged on the input. Null texts count as empty; short texts lose
    nothing; null ids and repeated rows are kept (see `find`); an empty table gives no
    rows; other columns are ignored. Ids are integers; others raise TypeError.
    """
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def emit(group: pa.Table, spans_of: list) -> pa.Table:
        out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for text, spans in zip(group.column(1).to_pylist(), spans_of, strict=True):
            text = (text or "").encode()
            left, n = _kept(text, spans)
            out["n_bytes"].append(len(text))
            out["n_removed"].append(len(text) - len(left))
            out["n_spans"].append(n)
            out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
        return pa.table({"id": group.column(0)} | {k: pa.array(v, pa.int64() if k != "kept_sha256" else pa.string()) for k, v in out.items()})

    kind = narrow.schema["id"].dataType.simpleString()
    return _merged(narrow, "id", "text", length, emit, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)


def remove(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """The rows with repeated passages cut out of the text, as `digests` counts them.

    A span may begin or end inside a character; the bytes of such characters that
    remain are left out, so the text stays valid. Null texts stay null, texts may become
    empty; repeated rows and null ids are kept (a null is larger than any id); an empty
    table gives no rows; all columns are kept, whatever their names. Ids are integers.
    """
    text_at, id_at, width = df.columns.index(text_col), df.columns.index(id_col), len(df.columns)
    # Names of its own, so that no column of the rows has a name used on the way.
    plain = df.toDF(*(f"column{i}" for i in range(width)))

    def emit(group: pa.Table, spans_of: list) -> pa.Table:
        texts = [t if spans is None else _kept(t.encode(), spans)[0].decode("utf-8", "ignore") for t, spans in zip(group.column(text_at).to_pylist(), spans_of, strict=True)]
        return group.select(range(width)).set_column(text_at, f"column{text_at}", pa.array(texts, pa.string()))

    return _merged(plain, f"column{id_at}", f"column{text_at}", length, emit, plain.schema).toDF(*df.columns)
