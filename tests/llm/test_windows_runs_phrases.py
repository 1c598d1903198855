"""Chat windows, periodic runs and phrases against plain versions, with the rows that tend to break things."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recurra.llm import chat, phrases, queries, runs

SMALL = "/root/testdata/sf0.001"
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "<\\s>", "[\\\\/INST]", "\\", "<", "[", "a\n", " ", "é😀", "]", "s>"]


def _conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def _plain_chat(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def _made_up_conversations(seed=5, long=60):
    random.seed(seed)
    said = lambda: "".join(random.choice(CONTROL) for _ in range(random.randint(0, 12)))
    rows = [(c, t, random.choice(["user", "assistant", "system", "to ol\n%", ""]), said()) for c in range(40) for t in range(random.randint(1, 12))]
    rows += [(100, t, "system" if t == 0 else ("user", "assistant")[t % 2], said()) for t in range(long)]
    rows += [(101, t - 9, ("user", "assistant")[t % 2], "x " * 40) for t in range(20)]
    rows += [(102, None, "user", "no turn"), (102, 0, None, None), (102, 0, "assistant", "same"), (102, 0, "assistant", "same"), (None, 0, "user", "no id"), (None, 1, "assistant", "no id")]
    rows += [(103, 0, "system", "s " * 100), (103, 1, "assistant", "long " * 5000), (103, 2, "user", ""), (104, 50, "assistant", "late only")]
    return rows


@pytest.mark.parametrize("block", [1024, 4])
def test_chat_reads_back(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK_TURNS", block)
    rows = _made_up_conversations()
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digests(_conversations(spark, rows)).collect()}
    assert got == _plain_chat(rows)


@pytest.mark.parametrize("block", [1024, 4])
def test_chat_windows_hold_the_budget(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK_TURNS", block)
    rows = _made_up_conversations()
    sized = chat.windows(_conversations(spark, rows), budget=60, history_turns=2, history_tokens=20)
    found = sized.withColumn("back", chat.read_back(F.col("text"))).orderBy("conv_id", "part", "window").collect()
    for r in found:
        assert len(r.back) == r.turns > r.repeated
        if r.turns - r.repeated > 1:
            assert r.tokens <= 60
        said = [t.text for t in r.back[r.repeated :] if t.role == "assistant"]
        assert len(said) == len(r.loss)
        assert all("</s>" not in r.text[s.start : s.end] for s in r.loss)
    # Of the long conversation every window but the first repeats the system turn, and some repeat history.
    long = [r for r in found if r.conv_id == 100]
    assert len(long) > 3 and all(r.back[0].role == "system" for r in long) and all(r.repeated for r in long[1:]) and max(r.repeated for r in long) > 1


def test_chat_keeps_one_window_within_the_budget(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], "a b c") for t in range(6)]
    (row,) = chat.windows(_conversations(spark, rows)).collect()
    assert row.tokens == 6 * (3 + chat.TURN_TOKENS) and row.repeated == 0 and len(row.loss) == 3


def test_chat_without_rows_and_with_other_columns(spark):
    assert chat.digests(_conversations(spark, [])).count() == 0
    df = _conversations(spark, [(1, 0, "assistant", "x")]).withColumns({n: F.lit(1) for n in ("part", "window", "loss", "own", "old", "more")})
    assert chat.digests(df).first().n_turns == 1


def test_chat_uses_no_python(spark):
    plan = queries.op11_chat_windows(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan


def _words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def _plain_digests(doc_id, text):
    w = _words(text)
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = runs.brute_force_runs(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = (None, None, None)
    for r in found:
        if best[0] is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def _made_up_repeats(seed=3):
    random.seed(seed)
    rows = []
    for i in range(150):
        letters = random.choice([1, 2, 3, 50])
        w = [f"w{random.randrange(letters)}" for _ in range(random.randint(0, 200))]
        if i % 2:
            block = [f"b{random.randrange(letters)}" for _ in range(random.randint(1, 30))]
            at = random.randint(0, len(w))
            w = w[:at] + (block * 12)[: random.randint(0, 150)] + w[at:]
        rows.append((i, random.choice([" ", "\n", " \t"]).join(w)))
    return [*rows, (1000, None), (1001, ""), (1002, " \n "), (1001, ""), (None, "no id " * 30), (1003, "é x " * 30)]


def test_runs_against_brute_force(spark):
    rows = _made_up_repeats()
    got = Counter(tuple(r) for r in runs.digests(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == Counter((i, *_plain_digests(i, t)) for i, t in rows)
    assert sum(n[1] for n in got) > 100


def test_runs_of_the_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where(F.length("text") < 6000)
    got = {r.doc_id: tuple(r)[1:] for r in runs.digests(docs).collect()}
    assert got == {r.doc_id: _plain_digests(r.doc_id, r.text) for r in docs.collect()}


def test_automaton_against_brute_force():
    random.seed(9)
    for _ in range(300):
        w = [random.randrange(random.choice([1, 2, 3])) for _ in range(random.randint(0, 70))]
        for least, periods in ((2, 2), (5, 3), (24, 3)):
            assert sorted(runs.runs_of(w, least, periods), key=lambda r: (r[0], r[2])) == runs.brute_force_runs(w, least, periods)


def test_collapse_keeps_columns_and_rows(spark):
    df = spark.createDataFrame([(1, "x " * 30, 7, 8, 9), (2, None, 1, 2, 3)], "doc_id int, text string, runs int, collapsed int, c0 int")
    assert [tuple(r) for r in runs.collapse(df).collect()] == [(1, "x", 7, 8, 9), (2, "", 1, 2, 3)]
    assert runs.collapse(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.find(df, carry=("runs",))


def _plain_phrases(docs, least, top, longest=4):
    f, n = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
        c = f.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                c.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        most = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    most[p[i : i + k]] = max(most[p[i : i + k]], a)
        rows = []
        for p, a in found.items():
            if p in most and 100 * most[p] >= 80 * a:
                continue
            s, _, left, right = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows.append((-s, -a, " ".join(p).encode(), left, right))
        rows.sort()
        out |= {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(rows[:top])}
    return out


def test_phrases_against_brute_force(spark):
    random.seed(4)
    words = ["A", "b", "É", "d,", "e.", "f\n", "g\t", "h\x01", "i\x0b", "x"]
    docs = [(random.choice(["en", "fr", None, "und"]), " ".join(random.choice(words[: random.choice([3, 6, 10])]) for _ in range(random.randint(0, 60)))) for _ in range(120)]
    docs += [("en", None), ("en", ""), (None, " . ")] + [("fr", "one two three four five")] * 40
    df = spark.createDataFrame(docs, "lang string, text string").withColumns({c: F.lit(0) for c in ("phrase", "words", "n", "a", "shard")})
    for least, top in ((30, 2000), (5, 12)):
        got = {tuple(r) for r in phrases.collocations(df, least=least, top=top).collect()}
        assert got == _plain_phrases(docs, least, top) and got


def test_phrases_of_an_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_counters_of_phrases_are_numbers(spark):
    first = np.full((3, 1 << phrases.CELLS), phrases.NEVER, np.uint8)
    shared = spark.sparkContext.broadcast(zlib.compress(first, 1))
    words = phrases._word_hashes(spark.createDataFrame([("en", "a b a", 0)], "lang string, text string, shard int"))
    counted = phrases._count(words, shared, first.shape, 0, 3)
    assert set(dict(counted.dtypes).values()) <= {"bigint", "smallint", "tinyint"}
    assert sorted(r.n for r in counted.collect()) == [1, 2]


class _Here:
    """Stands for a table and for a broadcast; its tasks run in the test, which can replace what they call."""

    def __init__(self, *batches, value=None):
        self.batches, self.value = batches, value

    def mapInArrow(self, task, schema):
        return [tuple(r.values()) for b in task(iter(self.batches)) for r in b.to_pylist()]


def test_phrases_that_share_a_hash_count_apart(monkeypatch):
    monkeypatch.setattr(phrases, "_hashes", lambda words, k: np.zeros(max(len(words) - k + 1, 0), np.uint64))
    docs = [("en", "a b a b a. b c"), ("fr", "a b"), ("en", "A b, d"), ("fr", " "), ("en", "x")]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*docs, strict=True)], names=["lang", "text"])
    met = np.ones((4, 1 << phrases.CELLS), bool)
    got, expected = Counter(), Counter()
    for lang, phrase, k, n in phrases._spelled(_Here(batch), _Here(value=zlib.compress(np.packbits(met))), met.shape):
        got[lang, phrase, k] += n
    for lang, text in docs:
        for piece in re.split("[.,]", text.lower()):
            w = piece.split()
            expected[lang, "", 0] += len(w)
            expected.update((lang, " ".join(w[i : i + k]), k) for k in range(1, 5) for i in range(len(w) - k + 1))
    assert got == expected


def test_last_scan_counts_blocks_together(monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 8)
    docs = [("en", "a b a"), ("fr", "a b"), (" ", "b é. \x01 b"), ("en", "A b, d"), ("fr", " , "), ("en", ""), ("fr", "a b a")]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*part, strict=True)], names=["lang", "text"]) for part in (docs[:3], docs[3:])]
    met = np.ones((4, 1 << phrases.CELLS), bool)
    expected = Counter()
    for lang, text in docs:
        for piece in re.split("[.,]", text.lower()):
            w = [x for x in piece.split(" ") if x]
            expected[lang, "", 0] += len(w)
            expected.update((lang, " ".join(w[i : i + k]), k) for k in range(1, 5) for i in range(len(w) - k + 1))
    shared = _Here(value=zlib.compress(np.packbits(met)))
    rows = [tuple(r) for r in phrases._spelled(_Here(*batches), shared, met.shape)]
    assert len({r[:3] for r in rows}) == len(rows)
    # A task whose words are held in several goes gives several rows of a phrase, of the same sum.
    monkeypatch.setattr(phrases, "COUNT_BYTES", 8)
    for found in (rows, phrases._spelled(_Here(*batches), shared, met.shape)):
        got = Counter()
        for lang, phrase, k, n in found:
            got[lang, phrase, k] += n
        assert got == expected


def test_a_counter_is_one_number(spark):
    first = np.full((3, 1 << phrases.CELLS), phrases.NEVER, np.uint8)
    # All single words have been at the threshold since step 1, all pairs since step 2.
    first[0], first[1] = 1, 2
    shared = spark.sparkContext.broadcast(zlib.compress(first, 1))
    words = phrases._word_hashes(spark.createDataFrame([("en", "a b a. b a b a", 0)], "lang string, text string, shard int"))
    counted = phrases._count(words, shared, first.shape, 2, 3)
    assert counted.columns == ["counter", "n"]
    got = Counter((r.counter >> phrases.FIELD & phrases.MASK, r.counter & phrases.MASK, r.n) for r in counted.collect())
    assert got == Counter({(1, 0, 4): 1, (1, 0, 3): 1, (2, 1, 3): 1, (2, 1, 2): 1, (3, 2, 2): 1, (3, 2, 1): 1})
    twice = {r.counter: r.n for r in phrases._summed(counted.unionByName(counted)).collect()}
    assert twice == {r.counter: 2 * r.n for r in counted.collect()}
