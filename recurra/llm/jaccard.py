"""Jaccard join of word-shingle sets with adaptive multi-match prefixes.

Shingles are ordered by a count sketch of all documents, rare ones first. If two
sets are similar enough, their first `size - needed + m` shingles share at least m.
Each set chooses its own m by the estimated cost of its candidates: a longer prefix
reads more lists, but asks for more shared shingles before a pair is verified.

Equal sets are one node. In every list two nodes, one of them the set with the most
frequent shingles, are compared with all others first; nodes found similar are in one component, and then
only pairs of different components remain. So a crowd of near copies costs two
comparisons per node and list instead of all its pairs, and no link between
components is lost. Each set has a signature: bit i tells whether an odd number of its
shingles hash to i. Two signatures differ in no more bits than the sets differ in
shingles, so pairs whose signatures differ too often are left out unseen.
Fixed-size bit sets say which shingles and which nodes can matter; where they or the
signatures fill up they let everything through, and results stay the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from recurra.llm.common import U64, blocks, mix, prepare, release, shingle_sets, spare, sum_vectors, written
from recurra.llm.components import components
from recurra.llm.twice import has, met_twice

#: Cells of the count sketch, bits of the set of shared prefix shingles and of the set of candidate nodes, as powers of two.
SKETCH, SHARED, NODES = 22, 26, 23
#: The most shared shingles that a set may ask for.
MOST = 8
#: Shingles of a set that are compared in the time that one entry of a list takes.
PER_ENTRY = 64
#: Words of 64 bits in a set's signature.
WORDS = 4


def _node(shingles: np.ndarray) -> int:
    """The identity of a set: a 64-bit hash as a signed number."""
    if not len(shingles):
        return 0
    return int(mix(mix(shingles ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64, keepdims=True) + U64(len(shingles))).view(np.int64)[0])


def _signature(shingles: np.ndarray) -> np.ndarray:
    """For each hash value whether an odd number of the shingles have it, as signed words."""
    odd = np.bincount((shingles & U64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def _ordered(shingles: np.ndarray, sketch: np.ndarray, noise: float) -> tuple[np.ndarray, np.ndarray]:
    count = sketch[(shingles >> U64(64 - SKETCH)).astype(np.int64)]
    order = np.lexsort((shingles, count))
    return shingles[order], np.maximum(count[order] - noise, 1.0)


def prefix(shingles: np.ndarray, sketch: np.ndarray, noise: float, percent: int) -> tuple[np.ndarray, int, int]:
    """The set's adaptive prefix, how many of its shingles a similar set must share, and how frequent the prefix is."""
    n = len(shingles)
    needed = -(-percent * n // 100)
    ordered, frequency = _ordered(shingles, sketch, noise)
    # Cost of each m: entries read, and sets compared.
    read = np.cumsum(frequency)
    m = np.arange(1, min(MOST, needed) + 1)
    entries = read[n - needed + m - 1]
    # A candidate that shares m shingles uses up m entries, so there are at most entries / m of them.
    cost = entries + entries / m * (n / PER_ENTRY)
    best = int(m[np.argmin(cost)])
    size = n - needed + best
    return ordered[:size], best, int(16 * read[size - 1] / size)


class _Sets:
    """Distinct shingle sets of the documents that a task sees, block by block."""

    def __init__(self, words: int):
        self.words, self.seen = words, set()

    def fresh(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        for s in shingle_sets(column, self.words):
            if len(s) and (node := _node(s)) not in self.seen:
                self.seen.add(node)
                yield node, s


def _bits_of(df: DataFrame, column: str, power: int) -> np.ndarray:
    """A bit set of fixed size with the low `power` bits of each value, put together in tasks."""
    low = F.col(column).bitwiseAND(F.lit((1 << power) - 1))
    found = df.select(F.shiftright(low, 6).cast("int").alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), low.bitwiseAND(F.lit(63)).cast("int")).alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << (power - 6), np.int64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint8)


def _similar(rows: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    spark = rows.sparkSession
    ends = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node")))
    wanted = spark.sparkContext.broadcast(_bits_of(ends, "node", NODES))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, bits = _Sets(words), wanted.value
        for block in blocks(batches, "__text"):
            found = [(node, s) for node, s in kept.fresh(block.column(0)) if has(bits, np.array([node]).astype(U64), NODES)[0]]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1].tobytes() for f in found], pa.binary())], names=["node", "shingles"])

    # Both sides below read the one exchange by node in which repeats go.
    known = rows.mapInArrow(sets, "node long, shingles binary").dropDuplicates(["node"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sides = [known.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab"]
    joined = pairs.select("a", "b").join(sides[0], "a").join(sides[1], "b").select("a", "b", "set_a", "set_b")
    return written(joined.mapInArrow(verify, "a long, b long"), "similar")


def join(df: DataFrame, words: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row: the components of documents similar by at least `percent`.

    See `groups` for what the components are.
    """
    found = groups(df, words, percent, id_col, text_col)
    smallest = found.where("component is not null").groupBy("component").agg(F.min("id").alias("smallest"))
    together = found.where("component is not null").join(smallest, "component").select("id", "n_shingles", F.col("smallest").alias("component_id"))
    out = together.unionAll(found.where("component is null").select("id", "n_shingles", F.col("id").alias("component_id")))
    return out.withColumnRenamed("id", id_col)


def keep_one(df: DataFrame, words: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with one document of each component: the one with the smallest id (a null is larger), then by text.

    Rows without words link with nothing and all stay. Of equal rows of a component one stays;
    an empty table gives no rows; all columns are kept, whatever their names.
    """
    found = groups(df, words, percent, id_col, text_col)
    # Columns beside the rows' own have names that the rows lack.
    id_, hash_, alone_, mine, nth = spare(df, "id", "hash", "alone", "mine", "nth")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")
    first = found.where("component is not null").groupBy("component").agg(F.min(place).alias("first")).select(F.col("first.id").alias(id_), F.col("first.text_hash").alias(hash_), F.lit(False).alias(alone_))
    alone = found.where("component is null").select(F.col("id").alias(id_), F.col("text_hash").alias(hash_), F.lit(True).alias(alone_)).distinct()
    hashed = df.withColumn(mine, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    kept = hashed.join(first.unionAll(alone), F.col(id_col).eqNullSafe(F.col(id_)) & (F.col(mine) == F.col(hash_)))
    numbered = kept.withColumn(nth, F.row_number().over(Window.partitionBy(id_col, mine).orderBy(F.lit(0))))
    return numbered.where(F.col(alone_) | (F.col(nth) == 1)).select(*df.columns)


def groups(df: DataFrame, words: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, n_shingles, component) for every row; the component is any number, and null where nothing can link.

    The set of a document holds the distinct `words`-word shingles of its lower-cased
    words (A-Z; separated by space and characters 9 to 13); with fewer words the whole
    sequence is one. Documents link when 100 * intersection >= percent * union;
    component_id is the smallest id reachable. A null text, or one without words, has
    no shingles and links with nothing (component_id: its own id). Equal sets always link. Null ids and
    repeated rows are kept (a null is no smallest id unless there is no other); an
    empty table gives no rows; other columns are ignored. Ids may have any type that can
    be ordered. Shingles and sets are compared by 64-bit hashes.
    """
    spark = prepare(df.sparkSession)
    texts = df.select(F.col(text_col).alias("__text"))

    def size_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH, np.int64)
        for block in blocks(batches, "__text"):
            sets = shingle_sets(block.column(1), words)
            for s in sets:
                # Shingles are distinct but cells may repeat.
                np.add.at(total, (s >> U64(64 - SKETCH)).astype(np.int64), 1)
            signs = np.array([_signature(s) for s in sets], np.int64).reshape(len(sets), WORDS)
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([_node(s) for s in sets], pa.int64()), *(pa.array(w) for w in np.ascontiguousarray(signs.T)), pa.nulls(len(sets), pa.int64()), pa.nulls(len(sets), pa.binary())], names=names)
        none = pa.nulls(1, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.nulls(1, id_arrow), *[none] * (3 + WORDS), pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([zlib.compress(total, 1)], pa.binary())], names=names)

    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("__text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"))
    id_type = docs.schema["id"].dataType.simpleString()
    id_arrow = to_arrow_type(docs.schema["id"].dataType)
    words_of = [f"sign{i}" for i in range(WORDS)]
    names = ["id", "text_hash", "n_shingles", "node", *words_of, "part", "counts"]
    sized = written(docs.mapInArrow(size_up, f"id {id_type}, text_hash long, n_shingles long, node long, {', '.join(f'{w} long' for w in words_of)}, part long, counts binary"), "sized")
    sketch = sum_vectors(sized.where("counts is not null").select(F.lit("all").alias("name"), "part", "counts"), "name", 16).get("all")
    narrow = sized.where("counts is null").select("id", "text_hash", "n_shingles", "node")
    if sketch is None:
        return narrow.select("id", "text_hash", "n_shingles", F.lit(None).cast("long").alias("component"))
    shared: Broadcast = spark.sparkContext.broadcast(np.minimum(sketch, np.iinfo(np.int32).max).astype(np.int32))
    noise = float(sketch.mean())

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, int, int, int]]:
        kept, counts = _Sets(words), shared.value
        for block in blocks(batches, "__text"):
            for node, s in kept.fresh(block.column(0)):
                yield node, *prefix(s, counts, noise, percent), len(s)

    twice = spark.sparkContext.broadcast(met_twice(texts, lambda batches: (p[1] for p in prefixes(batches)), SHARED)[0])

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            sizes = [len(h[1]) for h in held]
            columns = [np.concatenate([h[1] for h in held]).astype(np.int64), np.repeat(np.array([h[0] for h in held], np.int64), sizes), np.repeat(np.array([h[3] for h in held], np.int32), sizes), np.repeat(np.array([h[2] for h in held], np.int32), sizes), np.concatenate([h[4] for h in held]).astype(np.int32), np.repeat(np.array([h[5] for h in held], np.int64), sizes)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shingle", "node", "n", "need", "at", "frequent"])

        for node, shingles, need, frequent, n in prefixes(batches):
            at = np.flatnonzero(has(twice.value, shingles, SHARED))
            held.append((node, shingles[at], need, n, at, frequent))
            if len(held) == 1024:
                yield out()
                held = []
        if held:
            yield out()

    all_lists = written(texts.mapInArrow(postings, "shingle long, node long, n int, need int, at int, frequent long"), "postings")
    # Most shingles that the bit set lets through turn out to have one node; only two numbers per shingle travel to learn it.
    several = all_lists.groupBy("shingle").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("shingle")
    lists = written(all_lists.join(several, "shingle", "left_semi"), "lists")
    release(all_lists)
    entry = F.struct("node", "n", "need", "at")
    # In a crowd of edited copies the one closest to all others has the fewest rare shingles.
    ends = lists.groupBy("shingle").agg(F.max_by(entry, F.struct("frequent", "node")).alias("first"), F.min_by(entry, "node").alias("last"))
    ends = written(ends.select("shingle", F.explode(F.array("first", "last")).alias("end")), "ends")

    def wanted(n: str, m: str) -> Column:
        """The least intersection of similar sets of these sizes."""
        return F.ceil(F.lit(percent) * (F.col(n) + F.col(m)) / (100 + percent))

    def possible(x: str, y: str) -> Column:
        """Whether a shingle that two sets share at these places of their order speaks for their similarity.

        Similar sets share `need` of the first `size - wanted + need` shingles of each, and
        shingles before the shared one are before it in both sets.
        """
        least = wanted(f"{x}.n", f"{y}.n")
        first = least - F.least(f"{x}.need", f"{y}.need")
        early = (F.col(f"{x}.at") < F.col(f"{x}.n") - first) & (F.col(f"{y}.at") < F.col(f"{y}.n") - first)
        sizes = 100 * F.least(f"{x}.n", f"{y}.n") >= percent * F.greatest(f"{x}.n", f"{y}.n")
        places = 1 + F.least(f"{x}.at", f"{y}.at") + F.least(*(F.col(f"{p}.n") - F.col(f"{p}.at") - 1 for p in (x, y))) >= least
        return sizes & early & places

    def close(x: str, y: str, n: str, m: str) -> Column:
        """Whether the signatures x and y of sets of n and m shingles differ in no more bits than similar sets may."""
        differing = reduce(Column.__add__, (F.bit_count(F.col(f"{x}.{w}").bitwiseXOR(F.col(f"{y}.{w}"))) for w in words_of))
        return differing <= F.col(n) + F.col(m) - 2 * wanted(n, m)

    # Equal sets have equal signatures.
    signs = sized.where("counts is null and n_shingles > 0").groupBy("node").agg(F.struct(*(F.min(w).alias(w) for w in words_of)).alias("sign"), F.min("n_shingles").alias("n"))
    signs = written(signs, "signatures")

    def candidates(met: DataFrame, x: str, y: str) -> DataFrame:
        """Pairs (a, b) that share enough prefix shingles and whose signatures are close, of rows (x, y), one per shared shingle."""
        rows = met.where(possible(x, y)).select(F.least(f"{x}.node", f"{y}.node").alias("a"), F.greatest(f"{x}.node", f"{y}.node").alias("b"), F.least(f"{x}.need", f"{y}.need").alias("need"))
        counted = rows.groupBy("a", "b").agg(F.count("*").alias("met"), F.min("need").alias("need"))
        pairs = counted.where("met >= need").select("a", "b")
        for end in "ab":
            pairs = pairs.join(signs.select(F.col("node").alias(end), F.col("sign").alias(f"sign_{end}"), F.col("n").alias(f"n_{end}")), end)
        return pairs.where(close("sign_a", "sign_b", "n_a", "n_b")).select("a", "b")

    one = lists.select("shingle", entry.alias("x"))
    first = written(candidates(one.join(ends, "shingle").where("x.node != end.node"), "x", "end"), "candidates")
    similar = _similar(texts, first, words, percent)
    found = components(similar, "a", "b")
    # What is left: pairs of one list, in different components, neither of them compared with the other yet.
    placed = one.join(found.select(F.col("node").alias("of"), "component"), F.col("x.node") == F.col("of"), "left").select("shingle", "x", F.coalesce("component", F.col("x.node")).alias("c"))
    mixed = placed.groupBy("shingle").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("shingle")
    placed = placed.join(mixed, "shingle", "left_semi").join(signs.select(F.col("node").alias("of"), F.col("sign").alias("sx")), F.col("x.node") == F.col("of")).drop("of")
    placed = written(placed, "placed")
    release(lists)
    release(ends)
    other = placed.select("shingle", F.col("x").alias("y"), F.col("c").alias("d"), F.col("sx").alias("sy"))
    rest = placed.join(other, "shingle").where(F.expr("x.node < y.node and c != d") & possible("x", "y") & close("sx", "sy", "x.n", "y.n"))
    second = written(candidates(rest, "x", "y").join(first, ["a", "b"], "left_anti"), "candidates")
    links = similar
    if not second.isEmpty():
        links = similar.unionAll(_similar(texts, second, words, percent))
        found = components(links, "a", "b")
    named = narrow.join(found, "node", "left")
    return named.select("id", "text_hash", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")).alias("component"))
