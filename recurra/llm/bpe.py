"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words stand in one flat array. A round finds the rank of
every neighbouring pair by binary search over sorted pair keys, takes the lowest
rank of each word, merges all its occurrences and drops words without a pair.
Each distinct unit of text (white space and the run after it) is encoded once
per Python worker, or per block of texts once the worker's cache is full.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recurra.llm.common import blocks, prepare

# Unicode white space, the pre-tokenizer's pattern, the byte alphabet of byte-level vocabularies.
WHITE = "\t-\r \x85\xa0  -     　"
PRETOKEN = rf"'(?:[stmd]|re|ve|ll)| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: Longer words (in bytes) take a heap instead of rounds, whose number grows with the word.
ROUND_BYTES = 256
#: Units kept for good; later ones are kept for their block of texts only, so memory is bounded.
CACHE_UNITS = 400_000
#: Text bytes whose new words merge together.
ENCODE_BYTES = 4 << 20
_NONE = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file."""
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in PRINTABLE:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class Codec:
    """Encoder and decoder for one tokenizer file. Cheap to pickle by its path."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        of_letter = {c: i for i, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that strip or match whole words are not supported")
        table = {i: bytes(of_letter[c] for c in token) for token, i in vocab.items() if token not in self.special}
        table |= {i: token.encode() for token, i in self.special.items()}
        size = max(table) + 1
        self.token_length = np.array([len(table.get(i, b"")) for i in range(size)], np.int64)
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.token_bytes = np.frombuffer(b"".join(table.get(i, b"") for i in range(size)), np.uint8)
        self.of_byte = np.array([vocab[c] for c in letters], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int32), made[order]
        # All occurrences of a pair may merge at once only if no merge makes a part of an earlier one.
        latest = np.full(size, -1, np.int64)
        np.maximum.at(latest, made, np.arange(len(made)))
        self.ordered = bool((np.maximum(latest[left], latest[right]) < np.arange(len(made))).all())
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.units = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
        self.pretokens = regex.compile(PRETOKEN)
        self.id_text = [str(i) for i in range(size)]
        self.cache: dict[str, tuple[bytes, str]] = {t: (np.array([i], "<u4").tobytes(), str(i)) for t, i in self.special.items()}

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NONE), at

    def merge_words(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word (not empty), by rounds over all words at once."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(words)
        short = self.ordered and [i for i, w in enumerate(words) if len(w) <= ROUND_BYTES] or []
        if len(short) < len(words):
            for i in set(range(len(words))) - set(short):
                out[i] = self._merge_long(words[i])
        if not short:
            return out
        name = np.array(short)
        sizes = np.array([len(words[i]) for i in short])
        symbol = self.of_byte[np.frombuffer(b"".join(words[i] for i in short), np.uint8)]
        starts = np.cumsum(sizes) - sizes
        rank, at = np.full(len(symbol), _NONE, np.int32), np.zeros(len(symbol), np.int64)
        inner = np.ones(len(symbol), bool)
        inner[starts + sizes - 1] = False
        fresh = np.flatnonzero(inner)
        while True:
            rank[fresh], at[fresh] = self._look(symbol[fresh], symbol[fresh + 1])
            low = np.minimum.reduceat(rank, starts)
            ended = low == _NONE
            if ended.any():
                stops = starts + sizes
                for i, a, b in zip(name[ended].tolist(), starts[ended].tolist(), stops[ended].tolist(), strict=True):
                    out[i] = symbol[a:b].copy()
                go = ~ended
                keep = np.repeat(go, sizes)
                symbol, rank, at = symbol[keep], rank[keep], at[keep]
                name, sizes, low = name[go], sizes[go], low[go]
                if not len(name):
                    return out
                starts = np.cumsum(sizes) - sizes
            chosen = rank == np.repeat(low, sizes)
            follows = chosen.copy()
            follows[1:] &= chosen[:-1]
            follows[0] = False
            if follows.any():  # in a run of the same pair, every second one merges
                begin = np.flatnonzero(chosen & ~follows)
                position = np.flatnonzero(chosen)
                since = position - begin[np.searchsorted(begin, position, "right") - 1]
                chosen[position[since % 2 == 1]] = False
            hit = np.flatnonzero(chosen)
            symbol[hit] = self.made[at[hit]]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            sizes = sizes - np.add.reduceat(chosen.astype(np.int64), starts)
            place = np.cumsum(keep) - 1
            hit = place[hit]
            symbol, rank, at = symbol[keep], rank[keep], at[keep]
            starts = np.cumsum(sizes) - sizes
            last = np.zeros(len(symbol), bool)
            last[starts + sizes - 1] = True
            first = np.zeros(len(symbol), bool)
            first[starts] = True
            rank[last] = _NONE
            before = hit[~first[hit]] - 1
            fresh = np.unique(np.concatenate([hit[~last[hit]], before]))

    def _merge_long(self, word: bytes) -> np.ndarray:
        """The ids of one word with a heap of pairs, lowest rank and leftmost first."""
        symbol = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(symbol)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        ranks, at = self._look(np.array(symbol[:-1], np.int64), np.array(symbol[1:], np.int64))
        heap = [(r, i, symbol[i], symbol[i + 1], self.made[p]) for i, (r, p) in enumerate(zip(ranks.tolist(), at.tolist(), strict=True)) if r != _NONE]
        heapq.heapify(heap)

        def push(i: int) -> None:
            j = after[i]
            key = symbol[i] << 32 | symbol[j]
            p = int(np.searchsorted(self.keys, key))
            if p < len(self.keys) and self.keys[p] == key:
                heapq.heappush(heap, (int(self.rank[p]), i, symbol[i], symbol[j], self.made[p]))

        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != a or j < 0 or symbol[j] != b:
                continue
            symbol[i], symbol[j] = int(new), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([s for s in symbol if s >= 0], np.int64)

    def _learn(self, units: list[str]) -> None:
        cut = [self.pretokens.findall(u) for u in units]
        distinct = {w: i for i, w in enumerate(dict.fromkeys(w for ws in cut for w in ws))}
        ids = self.merge_words([w.encode() for w in distinct])
        names = self.id_text
        text = [",".join([names[i] for i in x.tolist()]) for x in ids]
        raw = [x.astype("<u4").tobytes() for x in ids]
        for unit, ws in zip(units, cut, strict=True):
            of = [distinct[w] for w in ws]
            self.cache[unit] = (b"".join(raw[i] for i in of), ",".join(text[i] for i in of))

    def encode(self, texts: list[str]) -> list[list[tuple[bytes, str]]]:
        """For each text its units' ids, as little-endian unsigned 32-bit bytes and as decimal text."""
        cut = []
        for text in texts:
            if self.split_special and self.split_special.search(text):
                cut.append([u for part in self.split_special.split(text) for u in ([part] if part in self.special else self.units.findall(part))])
            else:
                cut.append(self.units.findall(text))
        fresh = {u for us in cut for u in us} - self.cache.keys()
        if fresh:
            self._learn(sorted(fresh))
        get = self.cache.__getitem__
        out = [list(map(get, us)) for us in cut]
        if len(self.cache) > CACHE_UNITS:
            for unit in fresh:
                del self.cache[unit]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for."""
        sizes = self.token_length[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.token_bytes[np.arange(total) + np.repeat(self.token_start[ids] - (ends - sizes), sizes)].tobytes()


def _ids(codec: Codec, texts: list[str]) -> Iterator[tuple[np.ndarray, str]]:
    for units in codec.encode(texts):
        yield np.frombuffer(b"".join([u[0] for u in units]), "<u4").astype(np.int64), ",".join([u[1] for u in units])


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of whole texts. A null text counts as empty and has no ids; every row gives one row."""
    prepare(df.sparkSession)
    docs = df.select(F.col(id_col), F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for block in blocks(batches, "__text"):
            ids = [x.astype(np.int32) for x, _ in _ids(codec, [t or "" for t in block.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    return docs.mapInArrow(run, f"`{id_col}` {docs.schema[0].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from arrays of ids; bytes that are no UTF-8 become the replacement character, null gives an empty text."""
    prepare(df.sparkSession)
    rows = df.select(F.col(id_col), F.col(ids_col).alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            texts = [codec.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, text string")


def round_trip_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode the ids again, and return digests of both.

    One row per row of the input: id, n_tokens, ids_sha256 (decimal ids joined by
    commas), decoded_sha256 (decoded text). Null texts count as empty (0 tokens,
    digests of nothing); null ids and repeated rows are kept; other columns are ignored.
    """
    prepare(df.sparkSession)
    docs = df.select(F.col(id_col), F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for block in blocks(batches, "__text", ENCODE_BYTES):
            n, made, back = [], [], []
            for ids, text in _ids(codec, [t or "" for t in block.column(1).to_pylist()]):
                n.append(len(ids))
                made.append(hashlib.sha256(text.encode()).hexdigest())
                back.append(hashlib.sha256(codec.decode(ids).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(n, pa.int64()), pa.array(made), pa.array(back)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(run, f"`{id_col}` {docs.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
