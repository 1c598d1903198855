"""Frequent phrases and their cohesion by dynamic itemset counting.

Texts are lower-cased (A-Z), cut into pieces, and dealt into SHARDS shards. A step
scans one shard, in a cycle. Single words are counted in the first cycle. A longer
phrase becomes active in the step after the counters of both its subphrases (without
its last and without its first word) have reached the threshold, whatever has been
scanned by then, and counts for one full cycle from there; so lengths interleave,
and its count is exact. A phrase is never more frequent than its subphrases, so
none above the threshold is missed.

A counter is one number, of 48 bits of the phrase's hash, its length and the step it counts
since; phrases that share it count together, never too low. A last scan spells out the phrases
whose counters have reached the threshold and counts them by their words alone.

A counter is at the threshold when one shard alone, or its whole cycle, brings it there.
Tasks learn of it by a table of 2**CELLS cells per length, by hash: a cell holds the
step since which a phrase in it is at the threshold. Where phrases share a cell, one may
become active early and is counted for nothing, but the step is the same for all tasks,
so counts stay whole. The table has a fixed size, in tasks and on the driver, whatever the
corpus; with more frequent phrases than cells, more phrases are counted that turn out rare.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recurra.llm.common import BLOCK_BYTES, U64, blocks, flat, mix, release, run_hashes, written
from recurra.session import materialize

LONGEST, LEAST, SHARDS, CELLS = 4, 30, 3, 23
#: A phrase is inside a longer one if that has this share of its occurrences, in per cent.
INSIDE_PERCENT, SCORE_SCALE, TOP = 80, 2_000_000, 2_000
#: Text bytes whose phrases are counted together before they leave a task.
COUNT_BYTES = 1 << 22
#: Bytes of word hashes that are counted together, for the same reason.
HASH_BYTES = 1 << 23
#: The lowest bits of a counter hold the step, the next ones the length.
FIELD = 8
MASK = (1 << FIELD) - 1
NEVER = 255
#: What is left of a hash after this shift is its cell.
SHIFT = U64(64 - CELLS)
#: Rows of a batch that leaves a task.
ROWS = 1 << 16

_KIND = np.zeros(256, np.uint8)
# Bytes between words, and bytes between pieces.
_KIND[[0x20, 0x09]] = 1
_KIND[[0x2E, 0x2C, 0x3B, 0x3A, 0x21, 0x3F, 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and piece of each word of lower-cased bytes."""
    kind = _KIND[data]
    inner = kind == 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inner.copy()
    begins[1:] &= ~inner[:-1] | edge[1:-1]
    ends = inner.copy()
    ends[:-1] &= ~inner[1:] | edge[1:-1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    cuts = np.cumsum(kind == 2)
    return starts, stops, row, cuts[starts] + row if len(starts) else row


def _hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the phrases of k words, from those of words."""
    n = max(len(words) - k + 1, 0)
    total = np.zeros(n, U64)
    for j in range(k):
        total += words[j : n + j] * (mix(np.array([j + 1], U64)) | U64(1))
    return mix(total + U64(k))


def _coded(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.DictionaryArray:
    """The words by number; what lies between words is numbered, too."""
    offsets = np.stack([starts, stops], 1).ravel().astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    return pa.DictionaryArray.from_arrays(pa.array(coded.indices.to_numpy()[::2]), coded.dictionary)


def _salts(langs: pa.Array) -> np.ndarray:
    """A 64-bit salt of each row's language."""
    coded = langs.dictionary_encode()
    known = [zlib.crc32(x.encode()) for x in coded.dictionary.to_pylist()]
    return mix(np.array(known, U64) + U64(1))[coded.indices.to_numpy(zero_copy_only=False)] if len(langs) else np.empty(0, U64)


def _active(first: np.ndarray, words: np.ndarray, piece: np.ndarray, step: int, shards: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(length, step of activation, hashes) of the phrases that count in this step; `first` has the steps since which subphrases are at the threshold."""
    if step < shards:
        yield 1, 0, _hashes(words, 1)
    before = max(step - shards, 0)
    for k, cells in enumerate(first, 2):
        if not ((cells > before) & (cells <= step)).any():
            # No phrase of this length is in its cycle.
            continue
        since = cells[(_hashes(words, k - 1) >> SHIFT).astype(np.int64)]
        since = np.maximum(since[:-1], since[1:])
        at = np.flatnonzero((since > before) & (since <= step) & (piece[: len(since)] == piece[k - 1 :]))
        here, since = _hashes(words, k)[at], since[at]
        for s in range(before + 1, step + 1):
            yield k, s, here[since == s]


def _hashed(batch: pa.RecordBatch) -> tuple[np.ndarray, tuple[np.ndarray, ...], np.ndarray] | None:
    """Lower-cased bytes, the words' starts, ends, rows and pieces, and their hashes by language; nothing where there are no words."""
    data, offsets = flat(batch.column("text"))
    data = _LOWER[data]
    tokens = _tokens(data, offsets) if len(data) else ((),) * 4
    if not len(tokens[0]):
        return None
    return data, tokens, mix(run_hashes(data, *tokens[:2]) ^ _salts(batch.column("lang"))[tokens[2]])


def _count(shard: DataFrame, first: Broadcast, shape: tuple[int, int], step: int, shards: int) -> DataFrame:
    """(counter, n) of the phrases that count in this step; rows of one counter are not yet summed."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(zlib.decompress(first.value), np.uint8).reshape(shape)
        for batch in _joined(batches, HASH_BYTES):
            words = flat(batch.column("hashes"))[0].view(U64)
            inner = words != 0
            piece = np.cumsum(~inner)[inner]
            words = words[inner]
            for k, since, hashes in _active(known, words, piece, step, shards):
                counters = np.sort((hashes >> U64(2 * FIELD) << U64(2 * FIELD)) | U64(k << FIELD | since))
                new = np.flatnonzero(np.diff(counters, prepend=~counters[:1]))
                n = np.diff(np.append(new, len(counters)))
                for i in range(0, len(new), ROWS):
                    one = counters[new[i : i + ROWS]].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(n[i : i + ROWS], pa.int64())], names=["counter", "n"])

    return shard.mapInArrow(task, "counter bigint, n bigint")


def _summed(rows: DataFrame) -> DataFrame:
    """(counter, n) by counter. Rows meet first, since a task seldom has two of one counter."""
    return rows.repartition("counter").groupBy("counter").agg(F.sum("n").alias("n"))


class _Held:
    """Words of many blocks whose phrases are counted together."""

    def __init__(self) -> None:
        self.langs, self.parts, self.size = {}, [], 0

    def add(self, batch: pa.RecordBatch, known: np.ndarray) -> None:
        """The words of a block; `known` has the cells whose phrases count, by length."""
        if (found := _hashed(batch)) is None:
            return
        data, (starts, stops, row, piece), hashes = found
        # How many words the longest phrase has that counts from here; all its subphrases do, too.
        reach, whole = np.zeros(len(hashes), np.uint8), np.ones(len(hashes) + 1, bool)
        for k, cells in enumerate(known, 1):
            here = _hashes(hashes, k)
            whole = whole[:-1] & whole[1:] & (piece[: len(here)] == piece[k - 1 :])
            at = np.flatnonzero(whole)
            whole[at] = cells[(here[at] >> SHIFT).astype(np.int64)]
            reach[: len(whole)] += whole
        langs = batch.column("lang").dictionary_encode()
        lang = np.array([self.langs.setdefault(x, len(self.langs)) for x in langs.dictionary.to_pylist()], np.int32)[langs.indices.to_numpy()]
        self.parts.append((_coded(data, starts, stops), lang[row], reach))
        self.size += len(data)

    def rows(self, longest: int) -> Iterator[pa.RecordBatch]:
        """(lang, phrase, words, n) of what is held, each phrase once, and the number of all words as n of no words."""
        if not self.parts:
            return
        coded, front, reach = zip(*self.parts, strict=True)
        coded, front, reach = pa.chunked_array(coded).unify_dictionaries(), np.concatenate(front), np.concatenate(reach)
        word, words = np.concatenate([c.indices.to_numpy() for c in coded.chunks]), coded.chunk(0).dictionary
        langs = pa.array(list(self.langs), pa.string())
        phrases, n = pa.array([b""] * len(langs), pa.large_binary()), np.bincount(front, minlength=len(langs))
        for k in range(longest + 1):
            if k:
                # A phrase is told by the number of its first words and that of its last one; no words have the language's.
                at = np.flatnonzero(reach >= k)
                told = pa.array(front[at].astype(np.int64) << 32 | word[at + k - 1]).dictionary_encode()
                front[at], one = told.indices.to_numpy(), told.dictionary.to_numpy()
                n, before, last = np.bincount(told.indices.to_numpy(), minlength=len(one)), pa.array(one >> 32), words.take(pa.array(one & 0xFFFFFFFF))
                phrases, langs = pc.binary_join_element_wise(phrases.take(before), last, pa.scalar(b" ", pa.large_binary())) if k > 1 else last, langs.take(before)
            strings = phrases.view(pa.large_string())
            for i in range(0, len(n), ROWS):
                some = n[i : i + ROWS]
                yield pa.RecordBatch.from_arrays([langs.slice(i, ROWS), strings.slice(i, ROWS).cast(pa.string()), pa.array(np.full(len(some), k, np.int8)), pa.array(some, pa.int64())], names=["lang", "phrase", "words", "n"])


def _spelled(docs: DataFrame, met: Broadcast, shape: tuple[int, int]) -> DataFrame:
    """(lang, phrase, words, n) of the phrases in cells that are set in `met`, as all their subphrases are, and the number of all words as n of no words; rows of one phrase are not yet summed."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(np.frombuffer(zlib.decompress(met.value), np.uint8)).astype(bool).reshape(shape)
        held = _Held()
        for batch in blocks(_joined(batches, BLOCK_BYTES), "text", BLOCK_BYTES):
            held.add(batch, known)
            if held.size >= COUNT_BYTES:
                yield from held.rows(shape[0])
                held = _Held()
        yield from held.rows(shape[0])

    return docs.mapInArrow(task, "lang string, phrase string, words tinyint, n bigint")


def _joined(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Batches of `least` bytes at least, so that repeats are counted together."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= least:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _cells(counters: DataFrame, lengths: int) -> np.ndarray:
    """Which cells the counters of phrases of up to `lengths` words are in, by length. Fixed-size bit sets meet in tasks, in two rounds."""

    def pack(bits: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([zlib.compress(bits, 1)], pa.binary())], names=["bits"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(lengths << CELLS, bool)
        for batch in batches:
            k, cell = (batch.column(i).to_numpy().astype(np.int64) for i in range(2))
            met[cell + ((k - 1) << CELLS)] = True
        if met.any():
            yield pack(np.packbits(met))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(lengths << (CELLS - 3), np.uint8)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                bits |= np.frombuffer(zlib.decompress(raw), np.uint8)
        if bits.any():
            yield pack(bits)

    cell = F.shiftrightunsigned("counter", int(SHIFT)).cast("int")
    words = F.shiftright("counter", FIELD).bitwiseAND(MASK).cast("int")
    parts = counters.select(words.alias("words"), cell.alias("cell")).where(F.col("words") <= lengths).mapInArrow(task, "bits binary")
    out = np.zeros(lengths << (CELLS - 3), np.uint8)
    for (raw,) in parts.repartition(8).mapInArrow(merge, "bits binary").coalesce(1).mapInArrow(merge, "bits binary").collect():
        out = np.frombuffer(zlib.decompress(raw), np.uint8)
    return np.unpackbits(out).astype(bool).reshape(lengths, 1 << CELLS)


def _word_hashes(docs: DataFrame) -> DataFrame:
    """(hashes, shard): the hashes of each text's words, eight bytes each, with a zero before each piece."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks([batch], "text", BLOCK_BYTES):
                if (found := _hashed(block)) is None:
                    continue
                _, (_, _, row, piece), words = found
                new = np.flatnonzero(np.diff(piece, prepend=piece[0] - 1))
                held = np.insert(np.maximum(words, U64(1)), new, U64(0))
                sizes = np.bincount(row, minlength=len(block)) + np.bincount(row[new], minlength=len(block))
                offsets = np.concatenate([[0], np.cumsum(sizes * 8)]).astype(np.int64)
                hashes = pa.Array.from_buffers(pa.large_binary(), len(block), [None, pa.py_buffer(offsets), pa.py_buffer(held)])
                yield pa.RecordBatch.from_arrays([hashes.cast(pa.binary()), block.column("shard")], names=["hashes", "shard"])

    return docs.mapInArrow(task, "hashes binary, shard int")


def count(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, a): the phrases of one to `longest` words with a >= `least` occurrences; and (lang, n): all words.

    Occurrences lie within pieces and may overlap. A null language counts as und, a null
    text as empty; repeated rows count each; other columns are not read. An empty table
    gives empty ones. A text of any length is counted whole. The
    documents are read twice and must be the same both times.
    """
    shard = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"), shard.alias("shard")).where(F.length("text") > 0)
    # The words are told once; the steps read their hashes.
    table = materialize(_word_hashes(rows), "llm-phrase-shards", partition_by=["shard"])
    context = docs.sparkSession.sparkContext
    first = np.full((longest - 1, 1 << CELLS), NEVER, np.uint8)
    steps, complete, step, last = {}, [], 0, shards
    while step < last:
        part = table.where(F.col("shard") == step % shards).select("hashes")
        # Compressed, as few cells are set; and gone after the step.
        shared = context.broadcast(zlib.compress(first, 1))
        steps[step] = written(_summed(_count(part, shared, first.shape, step, shards)), "phrase-counts")
        shared.destroy()
        reached = steps[step].where(F.col("n") >= least).select("counter")
        begun = step - shards + 1
        if begun >= 0:
            # These counters end their cycle with this step.
            cycle = reduce(DataFrame.unionByName, (steps[i] for i in range(begun, step + 1)))
            whole = _summed(cycle.where(F.col("counter").bitwiseAND(MASK) == begun)).where(F.col("n") >= least)
            complete.append(written(whole.select("counter"), "phrase-hashes"))
            reached = reached.unionByName(complete[-1])
            release(steps.pop(begun))
        first[_cells(reached, longest - 1) & (first == NEVER)] = step + 1
        known = first[first != NEVER]
        # A phrase counts for a cycle from the later of its subphrases' steps.
        last = max(last, int(known.max()) + shards) if len(known) else last
        step += 1
    # Hashes only say which phrases may be frequent; these are spelled out and counted by themselves.
    met = _cells(reduce(DataFrame.unionByName, complete), longest)
    shared = context.broadcast(zlib.compress(np.packbits(met), 1))
    spelled = _spelled(rows.select("lang", "text"), shared, met.shape)
    counted = written(spelled.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("a")).where((F.col("words") == 0) | (F.col("a") >= least)), "phrases")
    shared.destroy()
    for old in (table, *steps.values(), *complete):
        release(old)
    return counted.where("words > 0"), counted.where("words = 0").select("lang", F.col("a").alias("n"))


def _cut(words: Column, k: int) -> tuple[Column, Column]:
    return F.array_join(F.slice(words, 1, k), " "), F.array_join(F.slice(words, F.lit(k + 1), F.size(words) - k), " ")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = TOP, shards: int = SHARDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language, by score, a and phrase.

    a counts the phrase, l and r the two parts of its weakest cut, n all words. See `count` for nulls and repeats.
    """
    frequent, sizes = count(docs, text, lang, longest, least, shards)
    longer = frequent.where("words > 1").withColumn("w", F.split("phrase", " "))
    cuts = F.array(*(F.when(F.col("words") > k, F.struct(F.lit(k).alias("k"), *(c.alias(x) for c, x in zip(_cut(F.col("w"), k), ("left", "right"), strict=True)))) for k in range(1, longest)))
    cut = longer.select("lang", "phrase", "a", F.explode(F.filter(cuts, lambda c: c.isNotNull())).alias("c")).select("lang", "phrase", "a", "c.*")
    parts = frequent.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l"))
    cut = cut.join(parts, ["lang", "left"]).join(parts.select("lang", F.col("left").alias("right"), F.col("l").alias("r")), ["lang", "right"])
    score = F.expr(f"cast(a as decimal(20,0)) * {SCORE_SCALE} div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    weakest = cut.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("words") - k + 1), lambda i: F.array_join(F.slice("w", i, k), " "))))
    outer = longer.where("words > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    inside = F.expr(f"cast(most as decimal(20,0)) * 100 >= cast(a as decimal(20,0)) * {INSIDE_PERCENT}")
    kept = weakest.join(outer, ["lang", "phrase"], "left").where(~F.coalesce(inside, F.lit(False))).drop("most")
    # Each of many parts of a language gives its first ones, so that no task sorts a whole language.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
