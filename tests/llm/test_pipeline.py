import os
import re
import sys

import pytest
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
import test_chunk_dedup  # noqa: E402
import test_setjoin  # noqa: E402

from strandlog.llm import chunk_dedup, langid  # noqa: E402
from strandlog.llm.queries import tokenizer_path  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.dtypes, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == columns, name
        docs = out.cache()
        assert 0 < docs.count() <= n
        n = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == n
    spark.catalog.clearCache()
    assert corpus_pipeline.run(spark, SF).count() == n


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_tables(spark, odd, empty, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    wide = docs.unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    assert stage(spark, wide, SF).count() > 0
    assert stage(spark, docs.limit(0), SF).count() == 0


def plain_near_duplicates(rows):
    found = {i: c for i, _, c in test_setjoin.brute(rows, 5, 80)}
    return [(i, t) for i, t in rows if found[i] == i]


def plain_substrings(rows):
    out = test_chunk_dedup.brute(rows, chunk_dedup.LEAST)
    before = dict(rows)
    return [(i, t) for i, t in out if t == before[i] or test_setjoin.WORD.search(t or "")]


def plain_decontamination(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[k : k + 13]) for t in items for w in [words(t)] if w for k in range(max(len(w) - 13, 0) + 1)}
    sizes, out = {len(w) for w in windows}, []
    for i, t in rows:
        w = words(t)
        hit = {k + j for n in sizes for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for j in range(n)}
        if not hit or 20 * len(hit) < len(w):
            out.append((i, t))
    return out


def test_every_stage_equals_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    own = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(own)
    planted = [
        (900_001, own[ids[3]] + " and a few words more"),
        (900_002, items[0] + " " + items[1]),
        (900_003, "щ" * 40 + " " + "ж" * 30),
        (900_004, None),
        (900_005, own[ids[7]]),
        (900_006, "An opening of its own. " + own[ids[9]] + " And an end of its own that nobody else has written yet."),
    ]
    more = spark.createDataFrame([(i, t, None, "planted", None if t is None else len(t)) for i, t in planted], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(more.select(docs.columns))
    model = langid.fit(docs)
    tokens = Tokenizer.from_file(tokenizer_path())
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    plain = {
        "language_id": lambda rows: [(i, t) for i, t in rows if model.analysis(t)[1] > 0],
        "near_duplicates": plain_near_duplicates,
        "substring_dedup": plain_substrings,
        "decontamination": lambda rows: plain_decontamination(rows, items),
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        kept = plain[name](rows)
        assert sorted((r["doc_id"], r["text"]) for r in docs.collect()) == sorted(kept), name
        assert len(kept) < len(rows) or name == "substring_dedup" and kept != rows
        assert all(r["n_chars"] == len(r["text"]) for r in docs.collect()) and docs.filter("lang is null").isEmpty()
        rows = kept
    last = {r["doc_id"]: (r["n_tokens"], list(r["ids"])) for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    expected = {i: tokens.encode(t, add_special_tokens=False).ids for i, t in rows}
    assert last == {i: (len(x), x) for i, x in expected.items()}
    spark.catalog.clearCache()
