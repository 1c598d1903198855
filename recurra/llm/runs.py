"""Periodic runs of words by a suffix automaton with link-cut access.

A run is a longest stretch of consecutive words with smallest period q whose
length is at least max(LEAST_WORDS, LEAST_PERIODS * q).

Method, per text: build the suffix automaton; then access the states of its
prefixes one after another in a link-cut forest over the suffix links. Each
access recolours the path to the root with the prefix's end. The segments it
meets have the end of the last earlier occurrence as colour, and the longest
such suffix as length: where the distance of the two ends is within that length,
the suffix and its earlier copy overlap or touch, which is a square. The longest
suffix reaches as far left as it can; it is a run where the next word breaks the
period. A primitive root occurs in its square only at both halves, so a run's
end meets its period as the last occurrence, once.

The automaton is slow in Python, and most texts repeat little. Two words apart by
the period carry the same GRAM words after them, all along a run but its last
period: in a run of LEAST_WORDS words and LEAST_PERIODS periods each of its GRAM
word windows occurs twice within it. So the automaton gets the stretches whose
windows all repeat inside the stretch. That leaves out no run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from recurra.llm.common import U64, blocks, flat, mix, words

LEAST_WORDS, LEAST_PERIODS, GRAM = 24, 3, 8
#: Consecutive windows of a run of LEAST_WORDS words.
_WINDOWS = LEAST_WORDS - GRAM + 1

Run = tuple[int, int, int]


def _automaton(word: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix links and lengths of the states (0 is the root), and the state of each prefix."""
    after: list[dict[int, int]] = [{}]
    link, length, prefix = [-1], [0], []
    last = 0
    for n, w in enumerate(word, 1):
        new = len(link)
        after.append({})
        link.append(0)
        length.append(n)
        at = last
        while at >= 0 and w not in after[at]:
            after[at][w] = new
            at = link[at]
        if at >= 0:
            to = after[at][w]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                copy = len(link)
                after.append(dict(after[to]))
                link.append(link[to])
                length.append(length[at] + 1)
                while at >= 0 and after[at].get(w) == to:
                    after[at][w] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
        prefix.append(new)
    return link, length, prefix


def _splay(x: int, up: list[int], low: list[int], high: list[int], colour: list[int]) -> None:
    """Make x the root of its tree; the colour of a tree is kept at its root."""
    p = up[x]
    if p < 0 or (low[p] != x and high[p] != x):
        return
    top = x
    while True:
        p = up[top]
        if p < 0 or (low[p] != top and high[p] != top):
            break
        top = p
    shade = colour[top]
    while True:
        p = up[x]
        if p < 0:
            break
        left = low[p] == x
        if not left and high[p] != x:
            break
        g = up[p]
        outer = g >= 0 and (low[g] == p or high[g] == p)
        if outer and (low[g] == p) == left:
            # Turn the grandparent below the parent first.
            if left:
                child = low[g] = high[p]
                high[p] = g
            else:
                child = high[g] = low[p]
                low[p] = g
            if child >= 0:
                up[child] = g
            far = up[g]
            up[p], up[g] = far, p
            if far >= 0:
                if low[far] == g:
                    low[far] = p
                elif high[far] == g:
                    high[far] = p
            turns = 1
        else:
            turns = 2 if outer else 1
        for _ in range(turns):
            p = up[x]
            if low[p] == x:
                child = low[p] = high[x]
                high[x] = p
            else:
                child = high[p] = low[x]
                low[x] = p
            if child >= 0:
                up[child] = p
            far = up[p]
            up[x], up[p] = far, x
            if far >= 0:
                if low[far] == p:
                    low[far] = x
                elif high[far] == p:
                    high[far] = x
    colour[x] = shade


def runs_of(word: list[int], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[Run]:
    """(start, length, period) of each run of a sequence; `least_periods` is two or more."""
    link, length, prefix = _automaton(word)
    n = len(word)
    up = list(link)
    low, high, colour = [-1] * len(link), [-1] * len(link), [-1] * len(link)
    found = []
    for i, state in enumerate(prefix):
        following = word[i + 1] if i + 1 < n else None
        deeper, x = -1, state
        while x >= 0:
            _splay(x, up, low, high, colour)
            end = colour[x]
            if end >= 0:
                d, reach = i - end, length[x]
                if reach >= d * (least_periods - 1) and reach + d >= least_words and (following is None or word[i + 1 - d] != following):
                    found.append((i - reach - d + 1, reach + d, d))
            if high[x] >= 0:
                colour[high[x]] = end
            high[x] = deeper
            deeper, x = x, up[x]
        colour[deeper] = i
        _splay(state, up, low, high, colour)
    return found


def _stretches(row: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last word (exclusive) of the stretches of a row whose windows of GRAM words all repeat within."""
    none = np.empty(0, np.int64)
    n = len(word) - GRAM + 1
    if n < _WINDOWS:
        return none, none
    whole = np.zeros(n, U64)
    for j in range(GRAM):
        whole += word[j : n + j] * (mix(np.array([j + 1], U64)) | U64(1))
    at = np.flatnonzero(row[:n] == row[GRAM - 1 :])
    part, whole = row[at].astype(U64), mix(whole[at])
    while len(at):
        key = mix(part * U64(0x9E3779B97F4A7C15) + U64(1)) ^ whole
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        again = np.zeros(len(at), bool)
        again[order[1:]] = same
        again[order[:-1]] |= same
        kept_at, kept_part = at[again], part[again]
        breaks = np.ones(len(kept_at), bool)
        breaks[1:] = (np.diff(kept_at) != 1) | (kept_part[1:] != kept_part[:-1])
        group = np.cumsum(breaks) - 1
        size = np.bincount(group, minlength=1)
        long = size[group] >= _WINDOWS if len(group) else np.empty(0, bool)
        if long.all() and again.all():
            first = np.flatnonzero(breaks)
            last = np.append(first[1:], len(kept_at)) - 1
            return kept_at[first], kept_at[last] + GRAM
        at, part, whole = kept_at[long], group[long].astype(U64), whole[again][long]
    return none, none


def _texts_runs(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[bytes], list[Run]]]:
    """(row, words, runs) of each row of a batch that has runs."""
    data, offsets = flat(batch.column(column))
    starts, stops, row, hashes = words(data, offsets, lower=False)
    firsts = np.searchsorted(row, np.arange(batch.num_rows + 1))
    begins, ends = _stretches(row, hashes)
    by_row: dict[int, list[Run]] = {}
    raw = data.tobytes() if len(begins) else b""
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        names: dict[bytes, int] = {}
        ids = [names.setdefault(raw[s:e], len(names)) for s, e in zip(starts[a:b].tolist(), stops[a:b].tolist(), strict=True)]
        r = int(row[a])
        moved = a - int(firsts[r])
        by_row.setdefault(r, []).extend((s + moved, n, p) for s, n, p in runs_of(ids))
    for r, runs in by_row.items():
        if runs:
            a, b = firsts[r], firsts[r + 1]
            yield r, [raw[s:e] for s, e in zip(starts[a:b].tolist(), stops[a:b].tolist(), strict=True)], sorted(runs, key=lambda x: (x[0], x[2]))


def _collapsed(word: list[bytes], runs: list[Run]) -> bytes:
    cover = np.zeros(len(word) + 1, np.int64)
    for start, length, period in runs:
        cover[start + period] += 1
        cover[start + length] -= 1
    gone = np.cumsum(cover)[:-1] > 0
    return b" ".join(w for w, g in zip(word, gone.tolist(), strict=True) if not g)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _found(docs: DataFrame, text: str, carry: list[str]) -> DataFrame:
    """c0, c1, ... (the columns `carry`), runs, collapsed."""
    inner = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)), F.col(f"`{text}`").alias("t"))
    held = len(carry)
    names = [*inner.columns[:-1], "runs", "collapsed"]
    run = StructType([StructField(n, LongType()) for n in ("start", "length", "period")])
    schema = StructType([*inner.schema.fields[:-1], StructField("runs", ArrayType(run)), StructField("collapsed", StringType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "t"):
            texts, runs = [None] * batch.num_rows, [[]] * batch.num_rows
            for r, word, found in _texts_runs(batch, "t"):
                texts[r] = _collapsed(word, found)
                runs[r] = [{"start": s, "length": n, "period": p} for s, n, p in found]
            for r, raw in enumerate(batch.column(held).to_pylist()):
                if texts[r] is None:
                    texts[r] = b" ".join((raw or "").encode().split())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(held)), pa.array(runs, pa.list_(_RUN)), pa.array(texts, pa.binary()).cast(pa.string())], names=names)

    return inner.mapInArrow(task, schema)


def find(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `carry`, `runs` (array of start, length, period by start and period) and `collapsed`: the text's words without repeats.

    Words are runs without space and characters 9 to 13. `collapsed` leaves out each
    word that a run contains after its first period, and joins the rest by one space.
    A null or empty text has no runs and collapses to an empty one. Repeated rows each
    give their result; no text has one run twice; other columns are not read, so their
    names don't matter, but `carry` can't hold columns called runs or collapsed. An empty
    table gives an empty one. A text of any length is searched whole; a task holds the
    automaton of one stretch of one text.
    """
    if {"runs", "collapsed"} & set(carry):
        raise ValueError("columns called runs or collapsed can't be carried")
    found = _found(docs, text, list(carry))
    return found.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)), "runs", "collapsed")


def collapse(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with the repeats of their runs removed; every row and column stays, whatever its name. See `find`."""
    rest = [c for c in docs.columns if c != text]
    found = _found(docs, text, rest)
    return found.select(*(F.col("collapsed" if c == text else f"c{rest.index(c)}").alias(c) for c in docs.columns))


def with_planted(docs: DataFrame) -> Column:
    """The text of the contract: in a tenth of the documents the words from a place on repeat the words there."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    word = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    n = F.size(word)
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    place = F.struct(word.alias("word"), a.cast("int").alias("a"), p.cast("int").alias("p"))

    def planted(x: Column) -> Column:
        kept = F.slice(x["word"], 1, x["a"])
        period = F.slice(x["word"], x["a"] + 1, x["p"])
        times = F.ceil((F.size(x["word"]) - x["a"]) / x["p"]).cast("int")
        return F.array_join(F.slice(F.concat(kept, F.flatten(F.array_repeat(period, times))), 1, F.size(x["word"])), " ")

    # An array of one place, so that it is computed once.
    text = F.element_at(F.transform(F.array(place), planted), 1)
    return F.when((h % 10 == 0) & (n > 0), text).otherwise(F.col("text"))


def digests(docs: DataFrame) -> DataFrame:
    """Per document the contract's columns of `find` over the planted texts."""
    found = find(docs.select("doc_id", with_planted(docs).alias("planted")), "planted")

    def better(best: Column, run: Column) -> Column:
        one, other = (x["length"].cast("decimal(19,0)") * y["period"].cast("decimal(19,0)") for x, y in ((run, best), (best, run)))
        # Runs come by start and period, so the first of equal ones stays.
        return F.when(best.isNull() | (one > other), run).otherwise(best)

    best = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), listed.alias("listed"), "collapsed").select(
        "doc_id", "n_runs", "b.start", "b.length", "b.period",
        F.expr("1000 * b.length div b.period").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def brute_force_runs(word: list, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[Run]:
    """Runs by trying every period: for tests of the queries on small texts."""
    n, found = len(word), {}
    for q in range(1, n // least_periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and word[j] == word[j + q]:
                j += 1
            if j > i and j - i + q >= max(least_words, least_periods * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda x: (x[0], x[2]))
