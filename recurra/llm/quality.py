"""Quality scores by nearest-neighbour voting in a latent-semantic space.

Terms are hashed patterns of character classes plus counts of repetition. Their
document frequencies come from all documents; a truncated decomposition of a
bounded sample of labelled documents gives the latent space. The labelled
vectors are broadcast; each document's cosines with all of them are one blocked
matrix product, and its nearest neighbours vote with the weight of their cosine.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recurra.llm.common import blocks, flat, mix, prepare, sum_vectors, words

TERMS = 2048
LATENT = 48
#: Labelled documents that the model holds: the bound of what is fitted and broadcast.
LABELLED = 4096
NEIGHBOURS = 25
#: A neighbour's vote weighs its cosine to this power.
SHARPNESS = 8
#: The last terms count repetition: words like the one before, and three-word sequences seen before in the document.
_AGAIN = (TERMS - 2, TERMS - 1)

_CLASS = np.zeros(256, np.uint64)
_CLASS[33:127] = np.arange(33, 127)
_CLASS[48:58] = 1
_CLASS[65:91] = 2
_CLASS[97:123] = 3
_CLASS[128:] = 3
_CLASS[[9, 11, 12, 13, 32]] = 4
_CLASS[10] = 5


def term_counts(column: pa.Array) -> np.ndarray:
    """Counts of terms, a row per text. All of a text counts, none of its neighbours."""
    data, offsets = flat(column)
    rows = len(column)
    out = np.zeros((rows, TERMS), np.float32)
    if not len(data):
        return out
    kind = _CLASS[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    new = np.empty(len(data), bool)
    new[0] = True
    new[1:] = (kind[1:] != kind[:-1]) | first[1:-1]
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, len(data)))
    symbol = kind[at] * np.uint64(4) + np.minimum(length, 3).astype(np.uint64)
    row = np.searchsorted(offsets, at, "right") - 1
    for n in (1, 2, 3):
        m = len(symbol) - n + 1
        if m <= 0:
            break
        same = row[:m] == row[n - 1 :]
        name = np.zeros(m, np.uint64)
        for j in range(n):
            name = name * np.uint64(512) + symbol[j : m + j]
        term = (mix(name + np.uint64(n << 40)) % np.uint64(TERMS - 2)).astype(np.int64)
        out += np.bincount(row[:m][same] * TERMS + term[same], minlength=rows * TERMS).reshape(rows, TERMS)
    _, _, of, word = words(data, offsets)
    if len(word) > 1:
        again = (word[1:] == word[:-1]) & (of[1:] == of[:-1])
        out[:, _AGAIN[0]] = np.bincount(of[1:][again], minlength=rows)
    if len(word) > 2:
        inside = of[2:] == of[:-2]
        three = mix(word[:-2] + mix(word[1:-1] + mix(word[2:])))[inside] ^ mix(of[2:][inside].astype(np.uint64))
        order = np.argsort(three, kind="stable")
        seen = np.zeros(len(three), bool)
        seen[order[1:]] = three[order[1:]] == three[order[:-1]]
        out[:, _AGAIN[1]] = np.bincount(of[2:][inside][seen], minlength=rows)
    return out


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts) * idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 1e-9, norm, 1)


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    axes: np.ndarray  # terms x latent
    vectors: np.ndarray  # labelled x latent
    labels: np.ndarray
    prior: float


def document_frequencies(df: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """Documents that hold each term, and their number, over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TERMS + 1, np.int64)
        for block in blocks(batches, "__text"):
            total[:-1] += (term_counts(block.column(0)) > 0).sum(axis=0)
            total[-1] += block.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(["df"]), pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([zlib.compress(total, 1)], pa.binary())], names=["name", "part", "counts"])

    rows = df.select(F.col(text_col).alias("__text"))
    found = sum_vectors(rows.mapInArrow(count, "name string, part long, counts binary"), "name", 8).get("df", np.zeros(TERMS + 1, np.int64))
    return found[:-1], int(found[-1])


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit the space and take the voters.

    `labels` holds the rows to learn from. Ids with a null label are left out, and
    an id with contradicting labels counts by their mean, rounded up. The voters are
    the LABELLED ids first in the order of a hash, so the choice doesn't depend on
    the layout of the tables. Without labelled documents every score is 0.5.
    """
    spark = prepare(df.sparkSession)
    hits, n = document_frequencies(df, text_col)
    idf = (np.log((n + 1) / (hits + 1)) + 1).astype(np.float32)
    clean = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg((F.avg(label_col) >= 0.5).cast("int").alias("__label"))
    rate = clean.agg(F.avg("__label")).first()[0]
    voters = clean.orderBy(F.xxhash64(id_col), id_col).limit(LABELLED)
    texts = df.select(F.col(id_col), F.col(text_col).alias("__text")).join(F.broadcast(voters), id_col).select(id_col, "__label", "__text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "__text"):
            x = weigh(term_counts(block.column(2)), idf)
            raw = [(np.flatnonzero(r).astype("<u2"), r[r > 0]) for r in x]
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array([i.tobytes() for i, _ in raw], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in raw], pa.binary())], names=["id", "label", "terms", "weights"])

    kind = texts.schema[0].dataType.simpleString()
    # A repeated document votes once, so the number of voters stays within the bound.
    got = texts.mapInArrow(vectors, f"id {kind}, label int, terms binary, weights binary").groupBy("id", "label").agg(F.max(F.struct("terms", "weights")).alias("x")).select("label", "x.*").orderBy("label", "terms", "weights").collect()
    if not got:
        return Model(idf, np.zeros((TERMS, LATENT), np.float32), np.zeros((0, LATENT), np.float32), np.zeros(0), 0.5)
    x = np.zeros((len(got), TERMS), np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r.terms, "<u2")] = np.frombuffer(r.weights, "<f4")
    basis = np.random.default_rng(8).standard_normal((TERMS, LATENT + 16)).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    _, _, right = np.linalg.svd(x @ basis, full_matrices=False)
    axes = (basis @ right.T)[:, :LATENT].astype(np.float32)
    return Model(idf, axes, unit(x @ axes), np.array([r.label for r in got], np.float32), float(rate))


def vote(model: Model, counts: np.ndarray) -> np.ndarray:
    """The share of label 1 among each row's nearest voters, weighted by similarity; the base rate for an empty text."""
    score = np.full(len(counts), model.prior)
    k = min(NEIGHBOURS, len(model.labels))
    if not k or not len(counts):
        return score
    cosine = unit(weigh(counts, model.idf) @ model.axes) @ model.vectors.T
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** SHARPNESS
    total = weight.sum(axis=1)
    some = (total > 1e-12) & (counts.sum(axis=1) > 0)
    score[some] = np.clip((weight * model.labels[near]).sum(axis=1)[some] / total[some], 0, 1)
    return score


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: list[Column] | None = None) -> DataFrame:
    """(id, carried columns, score) for every row, from the text alone.

    Score is 0 to 1, higher where label 1 is likelier. Null and empty texts get the
    base rate of the labels. Repeated rows and null ids are kept.
    """
    spark = prepare(df.sparkSession)
    rows = df.select(F.col(id_col), *(carry or []), F.col(text_col).alias("__text"))
    shared = spark.sparkContext.broadcast(model)
    names = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "__text"):
            found = vote(shared.value, term_counts(block.column(len(names))))
            yield pa.RecordBatch.from_arrays([*block.columns[: len(names)], pa.array(found)], names=[*names, "score"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(run, f"{kept}, score double")


def keep(df: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose text scores at least `threshold`, with all their columns. A null text scores as an empty one."""
    spark = prepare(df.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text_col):
            good = vote(shared.value, term_counts(block.column(text_col))) >= threshold
            yield block.filter(pa.array(good))

    return df.mapInArrow(run, df.schema)
