"""Every stage of the pipeline as a stage, over all that the one before it kept, against a plain version."""

import re
from itertools import combinations

import corpus_pipeline as pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recurra.llm import pii, quality
from recurra.llm.common import table, written

SF_DIR = "/root/testdata/sf0.001"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def kept(spark):
    """The documents and, by name, what each stage but the last keeps of them; the last stage's places."""
    docs = table(spark, SF_DIR, "documents")
    out = {"documents": docs}
    for name, stage in pipeline.STAGES[:-1]:
        docs = out[name] = written(stage(spark, docs, SF_DIR), f"test-{name}")
        assert docs.columns == out["documents"].columns
    out["packing"] = pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    return out


def _texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def _shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def test_quality(spark, kept):
    docs = kept["documents"]
    model = quality.train(docs, table(spark, SF_DIR, "labels"))
    good = {r.doc_id for r in quality.score(docs, model).where("score >= 0.5").collect()}
    texts = _texts(docs)
    assert _texts(kept["quality"]) == {i: texts[i] for i in good} and 0 < len(good) < len(texts)


def test_near_duplicates(kept):
    texts, left = _texts(kept["quality"]), _texts(kept["near_duplicates"])
    sets = {i: _shingles(t) for i, t in texts.items()}
    group = {i: i for i in texts}
    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and group[a] != group[b]:
            old, new = group[a], group[b]
            group = {i: new if g == old else g for i, g in group.items()}
    assert left == {i: texts[i] for i in left} and len(left) < len(texts)
    assert sorted(group[i] for i in left) == sorted(set(group.values()))


def test_passages(kept):
    texts, seen = _texts(kept["near_duplicates"]), set()
    left = _texts(kept["passages"])
    assert set(left) == set(texts)
    for i in sorted(texts):
        raw = (texts[i] or "").encode()
        windows = [raw[s : s + 50] for s in range(len(raw) - 49)]
        out = {at for s, w in enumerate(windows) if w in seen for at in range(s, s + 50)}
        seen.update(windows)
        expected = bytes(b for at, b in enumerate(raw) if at not in out).decode(errors="ignore")
        assert (left[i] or "") == expected


def test_personal_data(kept):
    before, after = _texts(kept["passages"]), _texts(kept["personal_data"])
    assert set(before) == set(after)
    assert any(EMAIL.search(t or "") for t in before.values())
    assert not any(EMAIL.search(t or "") for t in after.values())
    changed = {i for i in before if before[i] != after[i]}
    assert all(re.search(r"\[(?:email|ip|card|phone)\]", after[i]) for i in changed)
    assert all(r.n_chars == len(r.text or "") for r in kept["personal_data"].collect())


def test_personal_data_thresholds_count_every_proposal(spark, monkeypatch):
    binned, thresholds = [], pii._thresholds
    monkeypatch.setattr(pii, "_thresholds", lambda bins: binned.extend(bins) or thresholds(bins))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.format_string("id %05d/0000/0000", "id").alias("text"), F.lit(0).cast("long").alias("n_chars"))
    n = pii.candidates(docs).where("kind >= 0 and not strict").count()
    assert pipeline.personal_data_stage(spark, docs, SF_DIR).count() == 300
    assert n >= 300 and sum(b["distinct"] for b in binned) == n


def test_packing(kept):
    tokens = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens.no_truncation()
    tokens.no_padding()
    texts = _texts(kept["personal_data"])
    rows = kept["packing"].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in rows} == {i: len(tokens.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    assert kept["packing"].groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_run_is_the_stages(spark, kept):
    rows = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert rows(pipeline.run(spark, SF_DIR)) == rows(kept["packing"])


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_empty_tables(spark, name, stage):
    docs = table(spark, SF_DIR, "documents")
    assert stage(spark, docs.where("false"), SF_DIR).collect() == []
