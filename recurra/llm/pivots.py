"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its nearest reference points (pivots) in order. Inverted
lists hold, for each pivot, the vectors that have it among their nearest. Two
vectors meet in the list of the first pivot that they share, become candidates if they
share enough pivots in a similar order, and are then verified by exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurra.llm.common import prepare, written
from recurra.llm.components import components

#: Pivots at most. They are taken from four times as many distinct vectors, first in the order of a hash of
#: their components, leaving out those close to one taken before: a crowd of near copies gets few pivots,
#: since its members would rank many of them at random.
PIVOTS = 256
APART = 0.9
#: Pivots that describe a vector, and how many of them two candidates share at least.
NEAREST = 10
SHARED = 3
#: Candidates' ranks differ by at most this share of the greatest sum of differences, in which a pivot that the
#: other lacks counts as one place after its last: pairs that share only their farthest pivots are left out.
RANKS = 0.82
THRESHOLD = 0.98
#: Rows of a list that one task compares with as many others; longer lists are cut into blocks.
BLOCK = 512


def _unit(raw: list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), dim)
    # Scaling by the largest component first keeps the squares finite.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _apart(sample: np.ndarray, n: int) -> np.ndarray:
    close = sample @ sample.T > APART
    free, taken = np.ones(len(sample), bool), []
    for i in range(len(sample)):
        if free[i] and len(taken) < n:
            taken.append(i)
            free &= ~close[i]
    return sample[taken]


def _smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the links (a, b) lead to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def link(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, n_pivots: int = PIVOTS, nearest: int = NEAREST, shared: int = SHARED, ranks: float = RANKS) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Rows are compared when their labels are equal and not null and their vectors
    have equal length. A vector that is null, empty, zero, or holds null or
    non-finite components links with nothing, as does a row with a null id (its
    component is null and it is kept). Equal vectors with equal label are one node
    with a weight; each counts the others as links. The pivots are a bounded
    sample; every row is indexed. Verification is exact, so no link is false; pairs
    that share fewer than `shared` of their nearest pivots, or rank them further
apart than `ranks`, are missed.
    Rows that repeat an id are vectors of their own; an empty table gives no rows; other
    columns are ignored.
    """
    spark = prepare(df.sparkSession)
    vector = F.col(vector_col).cast("array<double>")
    usable = F.coalesce((F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False)) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    rows = written(df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.when(usable, vector).alias("v")), "vectors")
    nodes = written(rows.where("v is not null").groupBy("label", "v").agg(F.min("row").alias("node"), F.count("*").alias("weight")), "nodes")
    found = nodes.groupBy("v").agg(F.lit(1)).orderBy(F.xxhash64("v"), "v").limit(4 * n_pivots).select("v").collect()
    by_dim: dict[int, list] = {}
    for r in found:
        by_dim.setdefault(len(r.v), []).append(np.array(r.v, "<f8").tobytes())
    pivots = spark.sparkContext.broadcast({d: _apart(_unit(v, d), n_pivots) for d, v in by_dim.items()})

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pivots.value
        for batch in batches:
            node, weight = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            vectors = [np.array(x, "<f8") for x in batch.column(3).to_pylist()]
            out = {k: [] for k in ("at", "dim", "pivot", "near", "raw")}
            for dim in sorted({len(x) for x in vectors}):
                at = [i for i, x in enumerate(vectors) if len(x) == dim]
                raw = [vectors[i].tobytes() for i in at]
                if dim in known:
                    near = np.argsort(-(_unit(raw, dim) @ known[dim].T), axis=1, kind="stable")[:, :nearest].astype("<u2")
                else:  # no pivot of this length in the sample: all such vectors meet in one list
                    near = np.zeros((len(at), 1), "<u2")
                for i, r, x in zip(at, near, raw, strict=True):
                    out["at"] += [i] * len(r)
                    out["dim"] += [dim] * len(r)
                    out["pivot"] += r.tolist()
                    out["near"] += [r.tobytes()] * len(r)
                    out["raw"] += [x] * len(r)
            at = np.array(out["at"], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(out["dim"], pa.int32()), pa.array(out["pivot"], pa.int32()), pa.array(node[at]), pa.array(weight[at]), pa.array(out["near"], pa.binary()), pa.array(out["raw"], pa.binary())], names=["label", "dim", "pivot", "node", "weight", "near", "raw"])

    label_type = nodes.schema["label"].dataType.simpleString()
    lists = nodes.select("label", "node", "weight", "v").mapInArrow(describe, f"label {label_type}, dim int, pivot int, node long, weight long, near binary, raw binary")
    lists = written(lists, "lists")
    sizes = lists.groupBy("label", "dim", "pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("cuts")).where("cuts > 0")
    # Row block b meets block c in the group (min, max): every two rows of a list are together in exactly one.
    block = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
    met = lists.join(sizes, ["label", "dim", "pivot"]).withColumn("b", block).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    met = met.select("label", "dim", "pivot", F.least("b", "c").alias("low"), F.greatest("b", "c").alias("high"), F.col("b").alias("mine"), "node", "weight", "near", "raw")

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        dim, pivot, low, high = (k.as_py() for k in key[1:])
        mine, node, weight = (group.column(c).to_numpy() for c in ("mine", "node", "weight"))
        order = np.argsort(node, kind="stable")
        x = _unit(group.column("raw").to_pylist(), dim)[order]
        n = len(node)
        near = np.frombuffer(b"".join(group.column("near").to_pylist()), "<u2").reshape(n, -1)[order].astype(np.intp)
        mine, node, weight = mine[order], node[order], weight[order]
        # Vectors of one length have equally many pivots; those without rank stand one place after the last.
        k = near.shape[1]
        rank = np.full((n, n_pivots), k, np.int16)
        np.put_along_axis(rank, near, np.arange(k, dtype=np.int16)[None, :], axis=1)
        has = (rank < k).astype(np.float32)
        need, far = min(shared, k), ranks * k * (k + 1) / 2
        links, ends = np.zeros(n, np.int64), []
        for start in range(0, n, BLOCK):
            part = slice(start, start + BLOCK)
            candidate = has[part] @ has.T >= need
            candidate &= has[part, :pivot] @ has[:, :pivot].T == 0
            candidate &= np.arange(start, min(start + BLOCK, n))[:, None] < np.arange(n)[None, :]
            if low != high:
                candidate &= mine[part][:, None] != mine[None, :]
            i, j = np.nonzero(candidate)
            i += start
            for s in range(0, len(i), 1 << 16):
                a, b = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                alike = np.abs(rank[b[:, None], near[a]] - np.arange(k)).sum(axis=1) <= far
                a, b = a[alike], b[alike]
                sure = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
                a, b = a[sure], b[sure]
                np.add.at(links, a, weight[b])
                np.add.at(links, b, weight[a])
                ends.append(np.stack([a, b]))
        a, b = np.concatenate(ends, axis=1) if ends else np.zeros((2, 0), np.int64)
        root, some = _smallest(n, a, b), links > 0
        return pa.table({"node": pa.array(node[some], pa.int64()), "links": pa.array(links[some], pa.int64()), "root": pa.array(node[root[some]], pa.int64())})

    linked = written(met.groupBy("label", "dim", "pivot", "low", "high").applyInArrow(compare, "node long, links long, root long"), "linked")
    counts = linked.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(linked.select("node", "root"), "node", "root")
    least_id = rows.where("v is not null").groupBy("label", "v").agg(F.min("row").alias("node"), F.min("id").alias("least"), F.count("*").alias("weight"))
    known = least_id.join(counts, "node", "left").join(groups, "node", "left").select("label", "v", F.coalesce("component", "node").alias("component"), "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    known = written(known, "known")
    smallest = known.groupBy("component").agg(F.min("least").alias("component_id"))
    answer = known.join(smallest, "component").select("label", "v", "n_links", "component_id")
    alone = rows.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = rows.where("v is not null").join(answer, ["label", "v"]).select("id", "n_links", "component_id").unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
