"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recurra.session import materialize

#: Text bytes that the numpy code works on at a time; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
#: Rows of one Arrow batch. Texts may be long, so batches stay short.
ARROW_ROWS = 256

U64 = np.uint64
_LUT = np.random.default_rng(20).integers(1 << 62, size=256, dtype=np.uint64) * U64(2) + U64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_MULT = 0x9E3779B97F4A7C15
_POW = [np.ones(1, U64), np.ones(1, U64)]


def prepare(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches short: one batch of whole texts must fit a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, written to the shared folder and read again: later steps scan it instead of computing it twice."""
    return materialize(df, f"llm-{name}")


def release(df: DataFrame) -> None:
    """Delete the files of a table from `written` that no later step reads."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes for df to have no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def id_remainder(col: str, n: int) -> Column:
    """crc32 of an id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def blocks(batches: Iterable[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of about `limit` text bytes; a text is never cut."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(int(np.searchsorted(ends, before + limit, "right")), start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each row's begin (one more entry than rows); null counts as empty."""
    col = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) <= n:
        size = 1 << (n + 1).bit_length()
        for i, base in enumerate((_MULT, pow(_MULT, -1, 1 << 64))):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _POW[i] = np.cumprod(steps, dtype=U64)
    return _POW[0], _POW[1]


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs without white space (space, 9 to 13): start, end, row and 64-bit hash; A-Z hash as a-z if `lower`."""
    n = len(data)
    if not n:
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, U64)
    inner = (data != 32) & ((data < 9) | (data > 13))
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begins = inner.copy()
    begins[1:] &= ~inner[:-1] | first[1:n]
    ends = inner.copy()
    ends[:-1] &= ~inner[1:] | first[1:n]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    power, inverse = _powers(n)
    sums = np.empty(n + 1, U64)
    sums[0] = 0
    np.cumsum((_LUT[_LOWER] if lower else _LUT)[data] * power[:n], out=sums[1:])
    hashes = mix((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(U64) * U64(0xD6E8FEB86659FD93))
    return starts, stops, np.searchsorted(offsets, starts, "right") - 1, hashes


def run_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of bytes, wherever they stand."""
    n = len(data)
    power, inverse = _powers(n)
    sums = np.empty(n + 1, U64)
    sums[0] = 0
    np.cumsum(_LUT[data] * power[:n], out=sums[1:])
    return mix((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles.

    With fewer words the whole sequence is one shingle; without words the set is empty.
    """
    data, offsets = flat(column)
    _, _, row, word = words(data, offsets)
    counts = np.bincount(row, minlength=len(column))
    ends = np.cumsum(counts)
    steps = mix(np.arange(1, k + 1, dtype=U64)) | U64(1)
    n = max(len(word) - k + 1, 0)
    whole = np.zeros(n, U64)
    for j in range(k):
        whole += word[j : n + j] * steps[j]
    salts = np.arange(k + 1, dtype=U64) * U64(_MULT)
    whole = mix(whole + salts[k])
    out = []
    for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
        if count >= k:
            out.append(np.unique(whole[end - count : end - k + 1]))
        elif count:
            out.append(mix((word[end - count : end] * steps[:count]).sum(dtype=U64, keepdims=True) + salts[count]))
        else:
            out.append(np.empty(0, U64))
    return out


def map_batches(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def sum_vectors(df: DataFrame, key: str, tasks: int = 64) -> dict:
    """Sum compressed vectors (zlib) of 64-bit counts by key: rows (key, part, counts) become one vector per key on the driver.

    Vectors travel compressed. Partial sums stream through two rounds of tasks, so no task holds more than one vector per key.
    The caller bounds the number of keys and the length of the vectors.
    """
    schema = df.select(key, "counts").schema

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = np.frombuffer(zlib.decompress(v.as_buffer()), np.int64)
                total[k] = total[k] + v if k in total else v.copy()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(total, batch.schema.field(0).type), pa.array([zlib.compress(v, 1) for v in total.values()], pa.binary())], names=[key, "counts"])

    salted = df.repartition(tasks, F.col(key), F.col("part") % tasks).select(key, "counts")
    once = salted.mapInArrow(add, schema).repartition(key).mapInArrow(add, schema)
    return {r[0]: np.frombuffer(zlib.decompress(r[1]), np.int64) for r in once.collect()}


def quiet_tokenizers() -> None:
    """One thread per task: Spark already runs a task per core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
