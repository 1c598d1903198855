"""A training corpus from raw documents: quality, near duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage
before it kept; all but the last return the columns of documents. Where a stage
changes texts, n_chars follows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recurra.llm import jaccard, packing, pii, quality, suffixes
from recurra.llm.common import prepare, table, written

#: Near duplicates share word shingles of five words by 80 per cent.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least one half; the labels of sf_dir say what quality is."""
    prepare(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.keep(docs, model)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; those without words all stay, and no documents give none (see jaccard.keep_one)."""
    return jaccard.keep_one(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 bytes that an earlier document has. A document may become empty; it stays."""
    return _counted(suffixes.remove(docs), docs.columns)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; null texts, null ids and repeated rows stay (see pii.redact)."""
    return _counted(pii.redact(docs), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("passages", passages_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]

#: The stages learn, group and cut in ways that SQL can't express; tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
