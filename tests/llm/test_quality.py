import re
from collections import Counter

from strandlog.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    seen, copies = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            copies += line in seen
            seen.add(line)
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    times = Counter(windows)
    hit = {k + j for k, x in enumerate(windows) if times[x] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), copies, len(hit)


MORE = ["a\nb\na\n\na \nb", "\n\n", "x\r\nx\r\ny", "#|<>&%$* a#", "1 2 3 4 5 1 2 3 4 5 6", "a a a a a a", "last line\nlast line", "ü ü ü ü ü ü ü"]


def test_base_counts_against_brute_force(spark, table, odd_rows, empty):
    rows = odd_rows + [(100 + k, t) for k, t in enumerate(MORE)]
    ids = spark.createDataFrame([(5,), (None,), (5,)], "doc_id long")
    got = sorted([(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality.score(table(rows), ids).collect()], key=repr)
    assert got == sorted([(i, *brute(t)) for i, t in rows], key=repr)
    for r in quality.score(table(rows), ids).collect():
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality.score(empty, ids).count() == 0
    assert {r["llr"] for r in quality.score(table(rows), ids.limit(0)).collect()} == {0.0}


def test_junk_scores_lower(spark, table):
    import random

    rng = random.Random(1)
    prose = lambda: " ".join(rng.choice("the of and to in is was for that with on at by from it as are be this".split()) for _ in range(80))
    junk = lambda: " ".join(rng.choice("click buy now cheap win prize $$$ *** offer free".split()) for _ in range(80))
    rows = [(k, prose() if k % 2 else junk()) for k in range(200)]
    found = quality.score(table(rows), spark.createDataFrame([(k,) for k in range(1, 200, 2)], "doc_id long")).collect()
    good, bad = ([r["llr"] for r in found if r["doc_id"] % 2 == side] for side in (1, 0))
    assert min(good) > max(bad)


def test_target_counts_every_trusted_document(spark):
    docs = spark.range(20_500).selectExpr("id as doc_id", "concat('w', id, ' and') as text")
    assert abs(quality.ratios(docs, docs.select("doc_id"))).max() < 1e-9


def buckets_of(text):
    import pyarrow as pa

    *_, row, h = quality._hashed(pa.RecordBatch.from_arrays([pa.array([text])], ["text"]))
    return quality._features(h, row)[0].tolist()


def test_ratios_and_verdicts_against_plain_sums(spark, table, odd_rows):
    import math
    import random

    rng = random.Random(6)
    rows = odd_rows + [(200 + k, " ".join(rng.choice("abcdefghij") * rng.randrange(1, 3) for _ in range(rng.randrange(0, 60)))) for k in range(60)]
    trusted = {200, 203, 209, 230, 5, 6}
    words = {k: buckets_of(t or "") for k, (_, t) in enumerate(rows)}
    raw = Counter(b for w in words.values() for b in w)
    target = Counter(b for k, w in words.items() if rows[k][0] in trusted for b in w)
    n, m, own = sum(raw.values()), sum(target.values()), quality.PRIOR * quality.BUCKETS
    q = lambda b: raw[b] / n
    ratio = lambda b: math.log((target[b] + own * q(b)) / (m + own)) - math.log(q(b))
    expected = sorted([(i, round(sum(map(ratio, words[k])) / max(len(words[k]), 1), 9)) for k, (i, _) in enumerate(rows)], key=repr)
    ids = spark.createDataFrame([(i,) for i in trusted], "doc_id long")
    found = quality.score(table(rows), ids).collect()
    assert sorted([(r["doc_id"], round(r["llr"], 9)) for r in found], key=repr) == expected
    assert all(r["kept"] == (not r["base_failed"] and r["llr"] >= quality.THRESHOLD) for r in found)
    # At the threshold itself a document stays.
    edge = sorted(r["llr"] for r in found if not r["base_failed"])[5]
    assert {r["doc_id"] for r in quality.score(table(rows), ids, edge).collect() if r["kept"]} == {r["doc_id"] for r in found if not r["base_failed"] and r["llr"] >= edge}
