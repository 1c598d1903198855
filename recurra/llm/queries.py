"""Named queries of the operators in this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recurra.llm import bpe, chat, jaccard, langid, packing, parsing, phrases, pii, pivots, quality, runs, sharding, suffixes
from recurra.llm.common import id_remainder, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of at most 1 MiB."""
    return sharding.assign(table(spark, sf_dir, "documents"))


def op2_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate embeddings within each label."""
    return pivots.link(table(spark, sf_dir, "embeddings"))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, and decoded again."""
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.find(table(spark, sf_dir, "documents"))

    def count(i: int) -> Column:
        # The lambda has one parameter only: a second one would be the element's place.
        return F.size(F.filter("strict", lambda s: s["kind"] == i)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.as_text("strict"), 256).alias("base_sha256"), pii.as_text("spans").alias("spans"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes that an earlier document has, removed from every document."""
    return suffixes.digests(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from three folds in four."""
    docs = table(spark, sf_dir, "documents")
    held_out = (id_remainder("doc_id", 4) == 2).alias("held_out")
    model = langid.train(docs.where(~held_out))
    return langid.predict(docs, model, carry=[held_out])


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose four-word shingles are similar by 85 per cent."""
    return jaccard.join(table(spark, sf_dir, "documents"), 4, 85)


def op8_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learnt from labels of two folds in three."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = id_remainder("doc_id", 3) == 1
    model = quality.train(docs, labels.where(~held_out))
    scored = quality.score(docs, model, carry=[held_out.alias("held_out")])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_parsing_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return parsing.with_neighbours(table(spark, sf_dir, "documents"))


def op11_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted in windows, and read back."""
    return chat.digests(chat.with_control_strings(table(spark, sf_dir, "conversations")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, and digests of the texts without repeats."""
    return runs.digests(table(spark, sf_dir, "documents"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language by the cohesion of their weakest cut."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {q.__name__: q for q in (op1_extendible_shards, op2_pivot_index, op3_bpe_round_trip, op4_pii_boosting, op5_suffix_dedup, op6_language_id, op7_jaccard_join, op8_quality_votes, op9_best_fit_packing, op10_parsing_fingerprints, op11_chat_windows, op12_periodic_runs, op13_phrase_collocations)}

#: DuckDB twins, where SQL can express the result.
ORACLES: dict[str, str] = {
    "op1_extendible_shards": f"""
        WITH hashed AS (
            SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
                   CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
            FROM documents),
        tried AS (
            SELECT doc_id, n_bytes, h, depth,
                   sum(n_bytes) OVER (PARTITION BY depth, h >> (60 - depth)) AS shard_bytes,
                   count(*) OVER (PARTITION BY depth, h >> (60 - depth)) AS shard_rows
            FROM hashed, (SELECT unnest(range(0, 61)) AS depth)),
        fitting AS (
            SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS nth
            FROM tried WHERE shard_bytes <= {sharding.LIMIT_BYTES} OR shard_rows = 1)
        SELECT doc_id, n_bytes,
               CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h >> (60 - depth)), CAST(depth AS INT), '0') END AS shard,
               CAST(depth AS INT) AS depth, CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_rows
        FROM fitting WHERE nth = 1""",
}
