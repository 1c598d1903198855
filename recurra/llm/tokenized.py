"""Token ids from the tokenizers library, with one call of its model per distinct word.

The word tokenizer drops white space and lower-cases, so runs without white
space never influence each other. A run is cut into words by the tokenizer's own
pattern, and each distinct word goes through the library's BPE model once per
Python worker, as long as there is room to keep it. Runs with characters beyond
those whose normal form is themselves, and texts with special tokens, go through
the whole library pipeline.
"""

from __future__ import annotations

import json
import re

import numpy as np
import regex
from tokenizers import Tokenizer

from recurra.llm.bpe import byte_letters
from recurra.llm.common import quiet_tokenizers

#: str.split() takes these for white space, the tokenizer's pattern does not; and special tokens may stand inside runs.
_WHOLE = re.compile("[\x1c-\x1f]|<\\|")
#: Below this code point every text is in normal form C and lower-cases letter by letter.
_BEYOND = re.compile("[^\x00-˿]")
#: Runs and words kept; later ones are worked out each time, so memory is bounded.
CACHE_RUNS = 700_000


class _Runs(dict):
    """Ids of runs, worked out when first asked for."""

    def __init__(self, path: str):
        super().__init__()
        quiet_tokenizers()
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            split = json.load(f)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(split)
        self.model = self.library.model
        self.letters = dict(enumerate(byte_letters()))
        self.id_bytes = [i.to_bytes(4, "little") for i in range(max(self.library.get_vocab().values()) + 1)]
        self.words: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            shown = word if word.isalpha() and word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            number = self.id_bytes
            found = b"".join([number[t.id] for t in self.model.tokenize(shown)])
            if len(self.words) < CACHE_RUNS:
                self.words[word] = found
        return found

    def __missing__(self, run: str) -> bytes:
        if run.isalpha() and not _BEYOND.search(run):
            found = self._word(run.lower())
        elif not run.isascii() and _BEYOND.search(run):
            found = self.whole(run)
        else:
            found = b"".join(map(self._word, self.pattern.findall(run.lower())))
        if len(self) < CACHE_RUNS:
            self[run] = found
        return found


class RunTokenizer:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, for a tokenizer file that drops white space."""

    def __init__(self, path: str):
        self.runs = _Runs(path)

    def encode(self, text: str) -> bytes:
        if _WHOLE.search(text):
            return self.runs.whole(text)
        return b"".join(map(self.runs.__getitem__, (text.lower() if text.isascii() or not _BEYOND.search(text) else text).split()))
