"""Shards of bounded size by extendible hashing.

The directory maps prefixes of a key's hash to shards. A bucket over the byte
limit splits on one more bit, others stay as they are. Six bits are tried at a
time over a table of cells (prefix, bytes, rows), so only cells are shuffled, and
only rows of oversized buckets take part in the next round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recurra.llm.common import prepare, written

#: Hash bits of the key; rows that agree in all of them split further by as many bits of a row hash.
BITS = 60
#: Bits that a round may split on.
STEP = 6
LIMIT_BYTES = 1 << 20


def hash_bits(text: Column) -> Column:
    """The first 60 bits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _cell(depth: int) -> list[Column]:
    """The prefix of `depth` bits, as key part and row part."""
    if depth <= BITS:
        return [F.shiftright("h1", BITS - depth).alias("c1"), F.lit(0).cast("long").alias("c2")]
    return [F.col("h1").alias("c1"), F.shiftright("h2", 2 * BITS - depth).alias("c2")]


def assign(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """(key, n_bytes, shard, depth, shard_bytes, shard_rows) for every row.

    `shard` is the bucket's hash prefix as a string of bits, `n_bytes` the UTF-8 size
    of the text (null: 0). A shard is within the limit unless one row alone exceeds
    it; that row then has a shard of its own. A null key hashes as empty text. Rows
    that share a key (a hot key, repeated rows) stay together while they fit and are
    split by row beyond that. An empty table gives no rows; other columns are ignored.
    """
    prepare(df.sparkSession)
    text = F.col(text_col)
    rows = df.select(F.col(key_col).alias("key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), hash_bits(F.coalesce(F.col(key_col).cast("string"), F.lit(""))).alias("h1"), hash_bits(F.monotonically_increasing_id().cast("string")).alias("h2"))
    live, done = written(rows, "hashed"), []
    for at in range(0, 2 * BITS, STEP):
        top, deep = _cell(at), _cell(at + STEP)
        part = 1 if at < BITS else 2
        cells = live.groupBy(*deep).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows"))
        parent = [F.shiftright("c1", STEP).alias("p1"), F.lit(0)] if part == 1 else [F.col("c1").alias("p1"), F.shiftright("c2", STEP)]
        cells = cells.select("*", parent[0], parent[1].alias("p2"))
        # Splits only happen below an oversized parent; the first round may find that all rows fit one shard.
        best = F.lit(None)
        for depth in range(STEP, 0 if at else -1, -1):
            group = Window.partitionBy("p1", "p2", F.shiftright(f"c{part}", STEP - depth))
            size, n = F.sum("bytes").over(group), F.sum("rows").over(group)
            best = F.when((size <= limit_bytes) | (n == 1), F.struct(F.lit(at + depth).alias("depth"), size.alias("shard_bytes"), n.alias("shard_rows"))).otherwise(best)
        last = at + STEP >= 2 * BITS
        if last:
            best = F.coalesce(best, F.struct(F.lit(at + STEP).alias("depth"), F.col("bytes").alias("shard_bytes"), F.col("rows").alias("shard_rows")))
        found = written(cells.select("c1", "c2", best.alias("s")), "directory")
        bits = F.concat(F.lpad(F.bin("h1"), BITS, "0"), F.lpad(F.bin("h2"), BITS, "0"))
        joined = live.select("*", *deep).join(found, ["c1", "c2"])
        done.append(joined.where("s is not null").select(F.col("key").alias(key_col), "n_bytes", bits.substr(F.lit(1), F.col("s.depth")).alias("shard"), "s.*"))
        if found.where("s is null").isEmpty():
            break
        live = joined.where("s is null").select("key", "n_bytes", "h1", "h2")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def write_shards(docs: DataFrame, shards: DataFrame, path: str, key_col: str = "doc_id") -> None:
    """Write documents with unique keys as one folder per shard; each shard is written by one task."""
    placed = docs.join(shards.select(key_col, "shard"), key_col)
    placed.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)
