"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recurra.llm.common import blocks, prepare, sum_vectors

#: n-grams of one to three characters share 2 ** BITS counters.
BITS = 16
ORDERS = 3
SMOOTHING = 0.5
UNKNOWN = "und"
#: Languages whose log-probabilities are looked up together.
LANGS_AT_ONCE = 8
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Counters of the n-grams that start at each character, by order; sizes of the lower-cased texts.

    An n-gram that would reach into the next text gets counter 0 of its order's first character instead, so
    every text gives the same counters whatever stands around it.
    """
    low = [t.lower() for t in texts]
    sizes = np.array([len(t) for t in low], np.int64)
    chars = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.repeat(np.cumsum(sizes), sizes)
    left = np.minimum(ends - np.arange(len(chars)), ORDERS).astype(np.uint8)
    out, whole = [], np.zeros(len(chars), np.uint32)
    for n in range(ORDERS):
        shifted = np.zeros(len(chars), np.uint32)
        shifted[: len(chars) - n] = chars[n:] + np.uint32(1)
        shifted[left <= n] = 0
        whole = (whole ^ shifted) * _MULT[n]
        whole ^= whole >> np.uint32(15)
        out.append((whole * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS))
    return out, sizes


@dataclass(frozen=True)
class Model:
    """Languages in alphabetical order, their log priors, and log probabilities by counter and language."""

    langs: list[str]
    prior: np.ndarray
    table: np.ndarray


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts over all given rows with text and language, summed in tasks; one vector per language reaches the driver.

    The number of languages bounds the model: 2 ** BITS counters each. Rows with a
    null text or language are left out; without any row the model knows no language.
    """
    prepare(df.sparkSession)
    rows = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("__text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, totals = 1 << BITS, {}
        for block in blocks(batches, "__text"):
            of = block.column(0).to_pylist()
            names = sorted(set(of))
            row = np.array([names.index(x) for x in of], np.int64)
            found, sizes = grams(block.column(1).to_pylist())
            at = np.repeat(row * size, sizes)
            sums = sum(np.bincount(at + g, minlength=len(names) * size) for g in found)
            for i, name in enumerate(names):
                part = np.append(sums[i * size : (i + 1) * size], (row == i).sum())
                totals[name] = totals[name] + part if name in totals else part
        part = TaskContext.get().partitionId()
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals)), pa.array([part] * len(totals), pa.int64()), pa.array([zlib.compress(v.astype(np.int64), 1) for v in totals.values()], pa.binary())], names=["lang", "part", "counts"])

    counts = sum_vectors(rows.mapInArrow(count, "lang string, part long, counts binary"), "lang")
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros(0), np.zeros((1 << BITS, 0)))
    grams_of = np.array([counts[x][:-1] for x in langs]) + SMOOTHING
    docs = np.array([counts[x][-1] for x in langs], float)
    table = np.log(grams_of) - np.log(grams_of.sum(axis=1, keepdims=True))
    return Model(langs, np.log(docs / docs.sum()), np.ascontiguousarray(table.T))


def score_texts(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text and its posterior probability."""
    found, sizes = grams(texts)
    likelihood = np.tile(model.prior, (len(texts), 1))
    full = sizes > 0
    starts = (np.cumsum(sizes) - sizes)[full]
    for a in range(0, len(model.langs), LANGS_AT_ONCE):
        part = np.ascontiguousarray(model.table[:, a : a + LANGS_AT_ONCE])
        for g in found if full.any() else []:
            likelihood[full, a : a + LANGS_AT_ONCE] += np.add.reduceat(part[g], starts, axis=0)
    best = likelihood.argmax(axis=1)
    top = likelihood.max(axis=1, keepdims=True)
    posterior = 1 / np.exp(likelihood - top).sum(axis=1)
    return [model.langs[i] for i in best], posterior


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: list[Column] | None = None) -> DataFrame:
    """(id, carried columns, lang_pred, score) for every row, from the text alone.

    A text that is null or has no letter is `und` with score 0, as is every text if
    the model knows no language. Equal texts get equal results; ties go to the
    language first in the alphabet. Repeated rows and null ids are kept.
    """
    spark = prepare(df.sparkSession)
    rows = df.select(F.col(id_col), *(carry or []), F.col(text_col).alias("__text"))
    shared = spark.sparkContext.broadcast(model)
    names = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for block in blocks(batches, "__text"):
            texts = block.column(len(names)).to_pylist()
            spoken = [i for i, t in enumerate(texts) if known.langs and t and next(filter(str.isalpha, t), None)]
            langs, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if spoken:
                best, posterior = score_texts(known, [texts[i] for i in spoken])
                score[spoken] = posterior
                for i, lang in zip(spoken, best, strict=True):
                    langs[i] = lang
            yield pa.RecordBatch.from_arrays([*block.columns[: len(names)], pa.array(langs, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(run, f"{kept}, lang_pred string, score double")
