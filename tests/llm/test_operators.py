"""Each operator against a plain version, and on nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recurra.llm import bpe, jaccard, langid, packing, parsing, pii, pivots, quality, queries, sharding, suffixes
from recurra.llm.components import components

SHARED = "a passage of more than fifty bytes that stands in several of these documents, word for word "
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def texts():
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdeinorst") for _ in range(draw.randint(2, 8)))
    out = [None, "", " ", "one", "One two", "ÉÈ é́ 中文字 😀", "a\x1cb <|endoftext|> c", "x" * 3000, "lone \n\n  lines\n"]
    base = [" ".join(word() for _ in range(60)) for _ in range(6)]
    for b in base:
        w = b.split()
        out += [b, b.upper(), " ".join([*w[:58], "other", "end"]), f"{b[:90]} {SHARED}{b[90:]}"]
    out += [base[0], base[0], (SHARED * 40).strip(), " ".join(word() for _ in range(6000))]
    out.append(f"{base[1]} mail a.b@c.de or 10.0.0.1 and 300.1.1.1 card 4111 1111 1111 1111 or 4111 1111 1111 1112 call +1 (743) 555-3824")
    return out


@pytest.fixture(scope="module")
def rows():
    # An id twice with different texts, one row twice, a null id.
    out = [(i, t) for i, t in enumerate(texts())]
    return [*out, out[9], (3, "another text under the same id"), (None, out[10][1])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    # Further columns with names that the operators use themselves.
    wide = [(i, t, "x", 1, 2, "s") for i, t in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, node string, row long, part long, spans string").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_shards(spark, docs, none, rows):
    got = sharding.assign(docs, limit_bytes=4000).collect()
    assert sorted((str(r.doc_id), r.n_bytes) for r in got) == sorted((str(i), len((t or "").encode())) for i, t in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    for shard, members in by.items():
        assert members[0].shard_bytes == sum(r.n_bytes for r in members) and members[0].shard_rows == len(members)
        assert members[0].shard_bytes <= 4000 or len(members) == 1
        assert not any(other != shard and other.startswith(shard) for other in by)
    assert sharding.assign(none).count() == 0
    hot = spark.createDataFrame([(7, "y" * 100)] * 50, "doc_id long, text string")
    split = sharding.assign(hot, limit_bytes=1000).collect()
    assert len(split) == 50 and max(r.shard_bytes for r in split) <= 1000


def test_components(spark):
    draw = random.Random(2)
    links = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 440)] + [(500, None)]
    got = dict(components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect())
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if b is not None and find(a) != find(b):
            up[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for x in up if any(find(y) == find(x) for y in up if y != x)}


def test_pivots(spark):
    draw = np.random.default_rng(1)
    base = draw.standard_normal((30, 16))
    vectors = [(b + 0.03 * draw.standard_normal(16)).tolist() for b in base for _ in range(6)] + [base[0].tolist()] * 5
    rows = [(i, v, i // 60) for i, v in enumerate(vectors)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, vectors[0], None), (None, vectors[0], 0), (904, [1.0, None], 1), (905, [], 1), (906, [1e300] * 3, 1), (907, [2e300] * 3, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, node string")
    got = {r.vec_id: r for r in pivots.link(df).collect()}
    good = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    unit = {}
    for i, v, _ in good:
        v = np.array(v) / max(map(abs, v))
        unit[i] = v / np.sqrt(v @ v)
    near = {i: {j for j, w, m in good if j != i and m == label and len(w) == len(v) and unit[i] @ unit[j] >= 0.98} for i, v, label in good}
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert got[i].n_links == len(near.get(i, ()))
        assert got[i].component_id == (min(seen) if i is not None else None)
        assert got[i].kept == (i is None or min(seen) == i)
    assert pivots.link(df.where("false")).count() == 0
    # The order of pivots decides: with no room for other ranks, links between vectors that rank them differently go.
    strict = {r.vec_id: r.n_links for r in pivots.link(df, ranks=0.0).collect()}
    assert all(strict[i] <= got[i].n_links for i in got) and sum(strict.values()) < sum(r.n_links for r in got.values())
    assert strict[180] == 4  # repeats of one vector have no ranks to differ in


def test_bpe(docs, none, rows):
    library = Tokenizer.from_file(BYTE)
    expected = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        expected.append((str(i), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    got = bpe.round_trip_digests(docs, BYTE).collect()
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == sorted(expected)
    again = bpe.decode(bpe.encode(docs, BYTE), BYTE).collect()
    assert sorted((str(r.doc_id), r.text) for r in again) == sorted((str(i), t or "") for i, t in rows)
    assert bpe.round_trip_digests(none, BYTE).count() == 0


def test_language(spark, docs, none):
    sample = [(f"the {w} of the house", "en") for w in "abcdefgh"] + [(f"der {w} und das haus", "de") for w in "abcdefgh"] + [("x", None), (None, "en")]
    model = langid.train(spark.createDataFrame(sample, "text string, lang string"))
    assert model.langs == ["de", "en"]
    tests = spark.createDataFrame([(1, "the end of the day"), (2, "das ende und der tag"), (3, None), (4, "12 34!"), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(tests, model).collect()}
    assert [got[i].lang_pred for i in range(1, 6)] == ["en", "de", "und", "und", "und"]
    # The same by a plain sum over the counters.
    counters, _ = langid.grams(["the end of the day"])
    plain = model.prior + sum(model.table[c] for g in counters for c in g)
    assert got[1].score == pytest.approx(1 / np.exp(plain - plain.max()).sum())
    assert langid.predict(docs, model).count() == docs.count() and langid.predict(none, model).count() == 0
    empty = langid.train(none.withColumn("lang", F.lit("en")))
    assert empty.langs == [] and {r.lang_pred for r in langid.predict(docs, empty).collect()} == {"und"}


def test_quality(spark, docs, none):
    draw = random.Random(9)
    clean = [" ".join(draw.choice(["the", "house", "stands", "on", "hills"]) for _ in range(40)).capitalize() + "." for _ in range(60)]
    junk = [" ".join(f"{w.upper()}!!" for w in t.split()) for t in clean]
    rows = [(i, t, int(i < 60)) for i, t in enumerate(clean + junk)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.train(df, df.where("doc_id % 2 = 0").select("doc_id", "quality"))
    got = quality.score(df, model, carry=[F.col("quality")]).collect()
    assert len(got) == 120 and all((r.score >= 0.5) == bool(r.quality) for r in got)
    counts = quality.term_counts(df.select("text").toArrow().column(0).combine_chunks())
    x = quality.unit(quality.weigh(counts, model.idf) @ model.axes)
    cosine = (x @ model.vectors.T).astype(float)
    near = np.argsort(-cosine, axis=1)[:, : quality.NEIGHBOURS]
    weight = np.take_along_axis(cosine, near, 1) ** quality.SHARPNESS
    assert np.allclose((weight * model.labels[near]).sum(1) / weight.sum(1), quality.vote(model, counts), atol=0.05)
    assert quality.keep(df, model).count() == 60 and quality.keep(docs, model).columns == docs.columns
    blank = quality.train(docs, df.where("false").select("doc_id", "quality"))
    assert {r.score for r in quality.score(docs, blank).collect()} == {0.5} and quality.score(none, blank).count() == 0


def _sets(rows, k):
    low = {c: c + 32 for c in range(65, 91)}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(low))
        yield i, frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def _components(rows, k, percent):
    sets = list(_sets(rows, k))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[max(find(a), find(b))] = min(find(a), find(b))
    groups = defaultdict(list)
    for a, (i, _) in enumerate(sets):
        groups[find(a)].append(i)
    smallest = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return [(i, len(s), smallest[find(a)]) for a, (i, s) in enumerate(sets)]


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_jaccard(docs, none, rows, k, percent):
    got = jaccard.join(docs, k, percent).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, _components(rows, k, percent)))
    if k == 5:
        return
    assert jaccard.join(none, k, percent).count() == 0


def test_one_of_each_group(docs, rows):
    kept = jaccard.keep_one(docs, 5, 80)
    assert kept.columns == docs.columns
    got = sorted(str((r.doc_id, r.text)) for r in kept.collect())
    expected, seen = [], set()
    order = sorted(zip(rows, _components(rows, 5, 80), strict=True), key=lambda x: (x[0][0] is None, x[0][0] or 0))
    hashed = dict(zip(map(str, rows), _components(rows, 5, 80), strict=True))
    assert len(hashed) <= len(rows)
    for (i, t), (_, n, component) in order:
        if n == 0 or component not in seen or i is None and component is None:
            expected.append((i, t))
            if n:
                seen.add(component)
    # Id 3 has two texts in two components of the same smallest id, so both stand.
    extra = [r for r in rows if r[0] == 3 and str(r) not in map(str, expected)]
    assert got == sorted(map(str, expected + extra))


def _removed(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    first = {}
    for i, t in order:
        b = (t or "").encode()
        for j in range(len(b) - 49):
            first.setdefault(b[j : j + 50], i)
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] != i:
                gone[j : j + 50] = True
        kept = bytes(x for x, g in zip(b, gone[:-1], strict=True) if not g)
        yield str(i), len(b), len(b) - len(kept), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("hot", [4096, 0])
def test_passages(docs, none, rows, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", (4096, 4096))
    got = [(str(r.doc_id), *r[1:]) for r in suffixes.digests(docs).collect()]
    assert sorted(got) == sorted(_removed(rows)) and any(r[2] for r in got)
    if hot:
        cut = suffixes.remove(docs)
        assert cut.columns == docs.columns and cut.count() == len(rows)
        assert suffixes.digests(none).count() == 0


def test_hot_keys_by_contexts(spark, monkeypatch):
    # One phrase among differing surroundings, in one bucket.
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdeinorst") for _ in range(40))
    rows = [(i, f"{word()} the very same phrase of a source {word()}") for i in range(200)]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(300)] + [(2000 + i, f"once for each copy: {rows[0][1]}") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(suffixes, "HOT", 100)
    spread = suffixes._spread(df, "doc_id", "text", 50)
    bits = {r.shard: r.bits for r in suffixes._shared_keys(spread, "text", 50).collect()}
    keys, _, shard, *_ = suffixes._bucket_keys(pa.chunked_array([pa.array([t for _, t in rows])]), 50, spread.shards)
    contexts = defaultdict(set)
    for _, t in rows:
        raw = np.frombuffer(t.encode(), np.uint8)
        for k, _, a, n in zip(*(x.tolist() for x in suffixes._keys(raw, np.array([0, len(raw)]), 50)), strict=True):
            contexts[k].add(t[a : a + n])
    hot = {k for k, c in contexts.items() if len(c) > 100}
    got = set()
    for s, raw in bits.items():
        mine = keys[shard == s]
        got |= set(mine[np.unpackbits(np.frombuffer(raw, np.uint8), count=2 * len(mine))[len(mine) :].astype(bool)].tolist())
    assert got == hot and hot
    assert sorted((str(r.doc_id), *r[1:]) for r in suffixes.digests(df).collect()) == sorted(_removed(rows))


@pytest.mark.parametrize("queue", [4, 1 << 20])
def test_suffix_order(queue):
    draw = random.Random(queue)
    pieces = [bytes(draw.choice(b"abc") for _ in range(draw.randint(1, 40))) for _ in range(60)] + [b"a" * 50, b"ab" * 30]
    text = np.frombuffer(b"".join(p + b"\0" for p in pieces), np.uint8)
    raw = text.tobytes()
    assert suffixes.suffix_order(text, len(raw), queue).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


def _base_spans(text):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        return sum(v - 9 * (v > 9) for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0

    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 13 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                yield f"{kind}:{m.start()}:{m.end()}"


def test_personal_data(spark, none):
    odd = [None, "", "é a@b@c.d a@b.c_d@e.f x@y x@y.z..w", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.255 1.2.3", "4111 1111-1111 1111 41111111111111111111 4111-1111-1111-1112", "+1 (743) 555-3824 ++49 30 1234567 +12 +1().", "\x01a@b.cd\x01 +1 743 555 3824", "a" * 5000, "1" * 4000, "a@" + "b." * 3000 + "c"]
    rows = [(i, t) for i, t in enumerate(odd)] + [(2, odd[2]), (None, odd[5])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, kind string, row long").repartition(2)
    got = pii.find(df).select("doc_id", pii.as_text("strict").alias("s")).collect()
    assert sorted((str(r.doc_id), r.s) for r in got) == sorted((str(i), ",".join(_base_spans(t or ""))) for i, t in rows)
    clean = {r.doc_id: r.text for r in pii.redact(df).where("doc_id is not null").collect()}
    assert clean[6] == "\x01[email]\x01 [phone]" and clean[7] == odd[7] and clean[0] is None
    assert pii.find(none).count() == 0


def test_separated_digits(spark):
    texts = ["41 11 11 11 11 11 11 11", "pay 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 now", "4-1-1-1 1-1-1-1 1-1-1-1 1-1-1-1", "+1 2 3 4 5 6 7 8 9 0", "call +1.2.3(4)5-6 7 8 9, 1.2.3.4"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(pii.find(df).select("doc_id", pii.as_text("strict")).collect())
    assert got == {i: ",".join(_base_spans(t)) for i, t in enumerate(texts)} and all(got.values())
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[0] == "[card]" and clean[1] == "pay [card] now" and clean[3] == "[phone]"


def test_personal_data_query(spark, tmp_path):
    texts = [None, "", "a@b.cd e@f.gh", "1.2.3.4 5.6.7.8 9.9.9.9 card 4111 1111 1111 1111", "+1 743 555 3824 a@b.cd +1 743 555 3825 +1 743 555 3826 4111111111111111 4111-1111-1111-1111", "none"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[3])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = []
    for i, t in rows:
        spans = list(_base_spans(t or ""))
        expected.append((str(i), *(sum(s.startswith(k) for s in spans) for k in pii.KINDS), hashlib.sha256(",".join(spans).encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:6]) for r in queries.op4_pii_boosting(spark, str(tmp_path)).collect()) == sorted(expected)


OBFUSCATED = ["mail name [at] host [dot] com", "write to joe(at)mail(dot)org now", "contact a @ b . c", "server 10[.]0[.]0[.]1 is up", "host 2001:db8::7 here", "addr fe80:0:0:0:1:2:3:4 end", "card 4111.1111.1111.1111 paid", "visa 5500/0000/0000/0004", "call 743 555 3824 today"]
HARMLESS = ["at 12:30:45 on 2024-01-02", "we meet @ noon. We wait", "order 1234.5678.9012.3456", "version 300[.]1[.]2[.]3", "00:1a:2b:3c:4d:5e"]


@pytest.mark.parametrize("strict", [0, 600])
def test_obfuscated_personal_data(spark, strict):
    draw = random.Random(strict)
    number = lambda n: "".join(draw.choice("123456789") for _ in range(n))
    texts = OBFUSCATED + HARMLESS
    for i in range(strict):
        texts += [f"mail u{number(4)}@h{number(3)}.com or server 10.{i // 250}.0.{i % 250} or card 4111 1111 1111 1111 or call +1 {number(3)} {number(3)} {number(4)}", f"at {i % 24}:10:{i % 60} on 2024-01-{i % 28 + 1}, order {number(4)}.{number(4)}.{number(3)}, {number(4)} @ x. Y"]
    got = dict(pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", pii.as_text("spans")).collect())
    assert [t for i, t in enumerate(OBFUSCATED) if not got[i]] == []
    assert [t for i, t in enumerate(HARMLESS, len(OBFUSCATED)) if got[i]] == []


def test_copies_teach_once(spark, monkeypatch):
    monkeypatch.setattr(pii, "TRAIN_ROWS", 60)
    kept = []
    monkeypatch.setattr(pii, "written", lambda df, name: kept.append((name, df)) or df)
    texts = ["at 12:30:45 x"] * 400 + [f"card 4111 1111 1111 1111 or {1000 + i}.0000.0000.0000" for i in range(60)]
    pii.fit(pii.candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    sample = next(df for name, df in kept if name == "sample").select("kind", "span", "before", "after").collect()
    assert len(sample) == len(set(sample)) == 60


def test_every_proposal_teaches(spark, monkeypatch):
    taught, binned = [], []
    fit, thresholds = GBTClassifier.fit, pii._thresholds
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, rows: taught.append(rows) or fit(self, rows))
    monkeypatch.setattr(pii, "_thresholds", lambda bins: binned.extend(bins) or thresholds(bins))
    texts = spark.range(21_000).select(F.col("id").alias("doc_id"), F.format_string("id %05d/0000/0000", "id").alias("text"))
    found = pii.candidates(texts)
    n = found.where("kind >= 0 and not strict").count()
    pii.fit(found)
    # Each document proposes its own number, or more; all teach the trees that score, and all count for the thresholds.
    assert n >= 21_000 and taught[-1].count() == n + len(pii.EXAMPLES)
    assert sum(b["distinct"] for b in binned) == sum(b["n"] for b in binned) == n
    # Without features to cut freely, MLlib samples no rows for cuts.
    assert set(taught[-1].schema["features"].metadata["ml_attr"]["attrs"]) == {"binary"}


def test_packing(docs, none, rows):
    library = Tokenizer.from_file(WORD)
    got = packing.pack(docs, WORD, capacity=128, open_bins=4).collect()
    expected = []
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for a in range(0, len(ids), 128):
            part = ids[a : a + 128]
            expected.append((str(i), a // 128, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((str(r.doc_id), *r[1:5]) for r in got) == sorted(expected)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 128
    assert len(by) <= 1.1 * sum(r.length for r in got) / 128 + 1
    assert packing.pack(none, WORD).count() == 0


def test_fingerprints(spark, docs, none, rows):
    order = sorted(rows, key=lambda r: ((0, -r[0]) if r[0] is not None else (1, 0), r[1] or ""))
    got = parsing.with_neighbours(docs, partitions=4).collect()
    expected = []
    for (i, t), (_, following) in zip(order, [*order[1:], order[0]], strict=True):
        changed = parsing.edit(t or "", following or "")
        a, b, c = parsing.fingerprints([(t or "").encode(), changed.encode(), (following or "").encode()])
        expected.append((str(i), len(t or ""), hashlib.sha256(changed.encode()).hexdigest(), a, b, parsing.likeness(a, b), parsing.likeness(a, c)))
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(expected)
    assert parsing.with_neighbours(none).count() == 0
    # What lies inside a phrase's surroundings doesn't depend on the offset.
    long = texts()[-2]
    moved = parsing.fingerprints([long.encode(), ("zz " + long).encode(), long[::-1].encode()])
    assert parsing.likeness(moved[0], moved[1]) > 0.9 and parsing.likeness(moved[0], moved[2]) < 0.2
