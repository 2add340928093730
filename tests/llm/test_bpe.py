import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandlog.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def same(library, coder, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert coder.encode(text) == ids, text
    assert coder.encode_full(text)[1] == coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_random_texts_equal_the_library(library):
    coder, rng = bpe.WordPieces(PATH), random.Random(5)
    letters = "aAbeEéÉ ’'\"sStTlLdD.,!?0123 \n\t\x1c\x85\xa0ßİıΣσςАΑ漢字🙂éñ²½ªŉǅ<|>_-\x00\x7f "
    for k in range(3000):
        s = "".join(rng.choice(letters) for _ in range(rng.randrange(25)))
        same(library, coder, s + "<|endoftext|>" + s[:4] + "<|startoftext|>" if k % 50 == 0 else s)


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, "aab" * 999, "!" * 700, "haha" * 50 + "</w>", "</w></w>", "<|endoftext|>" * 3, "İstanbul ΑΣ", "don't we'LL"])
def test_long_and_special(library, text):
    same(library, bpe.coder(PATH), text)


def test_cache_overflow(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    coder = bpe.WordPieces(PATH)
    for text in ("one two three four five six", "six five four three two one"):
        same(library, coder, text)


def test_rows(library, odd_rows, odd, empty):
    rows = bpe.encode(odd, PATH).collect()
    assert len(rows) == len(odd_rows) and bpe.encode(empty, PATH).count() == 0
    for r, (i, text) in zip(rows, odd_rows, strict=True):
        assert r["doc_id"] == i and list(r["ids"]) == library.encode(text or "", add_special_tokens=False).ids
        assert r["decoded"] == library.decode(list(r["ids"]), skip_special_tokens=False)
