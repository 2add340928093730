"""BPE encoding and decoding, token for token as the public tokenizer file prescribes.

Method: for every prefix of a word one token is stored, the last token of that prefix's encoding. An automaton over the
vocabulary yields, at each position, all tokens that are suffixes of the prefix read so far; the one whose pair with the
last token before it survives encoding (the pair-compatibility test) is the unique last token. Back-pointers from the end
give the ids. Work is linear in the word's length, so words of any length are safe.

Defined results: null and empty text give no ids and decode to the empty string; repeated rows give repeated rows; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, texts

END = "\0"
SUFFIX = "</w>"
#: Words kept with their encodings, in each Python worker.
CACHE = 200_000

_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ſ"
_NUMBER = "0-9²³¹¼-¾"
_BLANK = "\t-\r \xa0"
#: Beyond these characters, the tokenizer's own normaliser and word splitter are called, so that their Unicode version decides.
_PLAIN = re.compile(f"[{_BLANK}!-~¡-ſ]*")
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_BLANK}{_LETTER}{_NUMBER}]+")


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class WordPieces:
    """Encoder and decoder for a `tokenizers` file of kind BPE with word ends."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != SUFFIX or spec.get("decoder"):
            raise ValueError("expected a BPE file with word ends and no decoder")
        self.path = path
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.name = {v: k for k, v in {**self.vocab, **self.special}.items()}
        self.symbols = _byte_symbols()
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.formed: dict[int, int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, made = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank.setdefault((x, y), r)
            if made not in self.parts:
                self.parts[made], self.formed[made] = (x, y), r
        self.memo: dict[int, bool] = {}
        self.whole = self._whole()
        self.automaton = ahocorasick.Automaton()
        for token, i in self.vocab.items():
            text = token[: -len(SUFFIX)] + END if token.endswith(SUFFIX) else token
            if text and i in self.whole:
                self.automaton.add_word(text, (i, len(text)))
        self.automaton.make_automaton()
        self.cache: dict[str, tuple[bytes, str]] = {}
        self._library = None

    def _spine(self, token: int, side: int) -> Iterator[tuple[int, int]]:
        """Tokens at one edge as merging goes on, latest first, each with the rank of the merge that ends it."""
        until = 1 << 60
        while True:
            yield token, until
            if token not in self.parts:
                return
            until, token = self.formed[token], self.parts[token][side]

    def _crossed(self, a: int, b: int, limit: int) -> bool:
        """Whether some merge before `limit` joins the edge of a with the edge of b while both are there."""
        left = list(self._spine(b, 0))
        for x, x_until in self._spine(a, 1):
            for y, y_until in left:
                r = self.rank.get((x, y))
                if r is not None and r < limit and r < x_until and r <= y_until:
                    return True
        return False

    def compatible(self, a: int, b: int) -> bool:
        """Whether the text of a followed by that of b is encoded as just [a, b]."""
        if len(self.memo) > 1_000_000:
            self.memo.clear()
        known = self.memo[a << 20 | b] = not self._crossed(a, b, 1 << 60)
        return known

    def _whole(self) -> set[int]:
        """Tokens whose own text is encoded as that one token."""
        good = {i for i in self.vocab.values() if i not in self.parts}
        for made, (x, y) in sorted(self.parts.items(), key=lambda p: self.formed[p[0]]):
            if x in good and y in good and not self._crossed(x, y, self.formed[made]):
                good.add(made)
        return good

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, given as byte symbols without a word end."""
        n = len(word) + 1
        last = [-1] * (n + 1)
        last[0] = start_here = -2
        back = [0] * (n + 1)
        last[n - 1] = 0 if n > 1 else start_here  # the last byte and the word end are one symbol: no prefix ends between them
        known, compatible = self.memo.get, self.compatible
        for at, (token, size) in self.automaton.iter(word + END):
            at += 1
            if last[at] == -1:
                before = last[at - size]
                if before == start_here:
                    last[at] = token
                elif before != -1:
                    fits = known(before << 20 | token)
                    if fits or fits is None and compatible(before, token):
                        last[at], back[at] = token, at - size
        ids, at = [], n
        while at:
            ids.append(last[at])
            at = back[at]
        return ids[::-1]

    def _entry(self, word: str, bytes_shown: bool) -> tuple[bytes, str]:
        shown = word if bytes_shown else "".join([self.symbols[b] for b in word.encode()])
        ids = self.encode_word(shown)
        entry = array("i", ids).tobytes(), " ".join([self.name[i] for i in ids])
        if len(word) < 100:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[("\1" + word) if bytes_shown else word] = entry
        return entry

    def _words(self, text: str) -> list[tuple[bytes, str]]:
        get, entry = self.cache.get, self._entry
        if _PLAIN.fullmatch(text):
            if "İ" in text:
                text = text.replace("İ", "i̇")
            return [get(w) or entry(w, False) for w in _WORD.findall(text.lower())]
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        plain = self._library.normalizer.normalize_str(text)
        return [get("\1" + w) or entry(w, True) for w, _ in self._library.pre_tokenizer.pre_tokenize_str(plain)]

    def encode_full(self, text: str | None) -> tuple[bytes, str]:
        """Ids as 32-bit integers in bytes, and what they decode to."""
        found = []
        for k, piece in enumerate(self.split.split(text) if self.split and text else [text or ""]):
            found += [(array("i", [self.special[piece]]).tobytes(), piece)] if k % 2 else self._words(piece)
        return b"".join([e[0] for e in found]), " ".join([e[1] for e in found])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_full(text)[0], np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        """Token texts joined by a space, as a file without a decoder prescribes; special tokens stay."""
        return " ".join([self.name[i] for i in ids])


_coders: dict[str, WordPieces] = {}


def coder(path: str) -> WordPieces:
    """One coder for each file and Python worker."""
    if path not in _coders:
        _coders[path] = WordPieces(path)
    return _coders[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>, decoded string: each whole text encoded, and its ids decoded again. No shuffle.

    path: a tokenizer file that every executor can open under this name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in slices(batches, 2 << 20):
            found = [c.encode_full(text) for text in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *(len(i) // 4 for i, _ in found)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join([i for i, _ in found]), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array([d for _, d in found], pa.string())], ["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")
