"""Whole rows pass through operators whatever their columns are called; what the trees of op4 decide."""

import pytest
from pyspark.sql import functions as F

from recurra.llm import jaccard, pii, suffixes
from recurra.llm.common import spare

OWN = ["id", "hash", "alone", "mine", "nth", "spans", "merged", "__row", "__doc", "__bucket", "component", "node", "column0"]
LONG = "one two three four five six seven eight nine ten eleven twelve and mail a@b.cd"


@pytest.fixture(scope="module")
def wide(spark):
    rows = [(1, LONG), (2, LONG), (2, LONG), (3, None), (4, ""), (None, "other words")]
    return spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in OWN))


def _intact(df):
    rows = df.collect()
    assert df.columns == ["doc_id", "text", *OWN]
    assert all(r[c] == f"{c} of {'none' if r.doc_id is None else r.doc_id}" for r in rows for c in OWN)
    return sorted((str(r.doc_id), r.text) for r in rows if r.text)


def test_clashing_columns(wide):
    assert _intact(jaccard.keep_one(wide, 5, 80)) == [("1", LONG), ("None", "other words")]
    assert _intact(suffixes.remove(wide)) == [("1", LONG), ("None", "other words")]
    assert _intact(pii.redact(wide)) == [(i, LONG.replace("a@b.cd", "[email]")) for i in "122"] + [("None", "other words")]


def test_spare_names(wide):
    assert spare(wide, "ID", "id", "free") == ["ID_", "id__", "free"]


def test_id_types(wide):
    got = jaccard.join(wide.select(F.col("doc_id").cast("double").alias("doc_id"), "text"), 4, 85).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == [("1.0", 12, "1.0"), ("2.0", 12, "1.0"), ("2.0", 12, "1.0"), ("3.0", 0, "3.0"), ("4.0", 0, "4.0"), ("None", 1, "None")]
    with pytest.raises(TypeError, match="integer"):
        suffixes.remove(wide.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_trees_select_every_addition(spark, monkeypatch):
    df = spark.createDataFrame([(1, "mail name [at] host [dot] com or a@b.cd")], "doc_id long, text string")
    monkeypatch.setattr(pii.Trees, "probability", lambda self, rows: rows.withColumn("score", F.lit(0.0)))
    assert [r.s for r in pii.find(df).select(pii.as_text("spans").alias("s")).collect()] == ["email:33:39"]


def test_thresholds():
    row = lambda kind, form, at, hits, n: {"kind": kind, "format": form, "bin": at, "hits": hits, "n": n, "distinct": n}
    assert pii._thresholds([]) == {(-1, -1): 0.5}
    got = pii._thresholds([row(0, 1, 90, 200, 200), row(0, 1, 60, 0, 50), row(0, 2, 80, 3, 3), row(2, 0, 70, 0, 150), row(3, 0, 10, 120, 120)])
    # Format 2 has its kind's threshold, no score of cards is precise enough, and none goes below a half.
    assert got == {(-1, -1): 0.8, (0, 1): 0.9, (0, -1): 0.8, (2, 0): 2.0, (2, -1): 2.0, (3, 0): 0.5, (3, -1): 0.5}
