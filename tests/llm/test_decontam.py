import random
import re

from strandlog.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, n=13):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - n, 0) + 1):
            if w:
                windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                who = windows.get(tuple(w[k : k + size]))
                if who:
                    hit |= set(range(k, k + size))
                    found |= who
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def make(seed):
    rng = random.Random(seed)
    vocab = ["Alpha", "beta", "GAMMA", "é", "漢", "x1", "the", "a"]
    text = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", ",", "!", "-b"]) for _ in range(n))
    items = [(k, text(rng.choice([0, 1, 3, 12, 13, 14, 30]))) for k in range(25)] + [(99, None), (7, "twice the id")]
    docs = [(k, text(rng.randrange(40)) + " " + (rng.choice(items)[1] or "") + "; " + text(rng.randrange(20))) for k in range(60)]
    return docs, items


def rows(df):
    return sorted([(r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in df.collect()], key=repr)


def test_against_brute_force(spark, table, odd_rows):
    for seed in (1, 2):
        docs, items = make(seed)
        docs += odd_rows
        found = decontam.scan(table(docs), spark.createDataFrame(items, "item_id long, text string"))
        assert rows(found) == brute(docs, items)


def test_blocks_give_the_same(spark, table, monkeypatch):
    docs, items = make(3)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 300)
    assert len(list(decontam._blocks(spark.createDataFrame(items, "item_id long, text string")))) > 3
    assert rows(decontam.scan(table(docs), spark.createDataFrame(items, "item_id long, text string"))) == brute(docs, items)


def test_spans_point_into_the_original(spark, table):
    text = "Früher! " + "One TWO three, four five six seven eight nine ten eleven twelve thirteen" + " später"
    r = decontam.scan(table([(1, text)]), spark.createDataFrame([(5, text[8:-7].lower())], "item_id long, text string")).first()
    assert [text[s["start"] : s["end"]] for s in r["spans"]] == [text[8:-7]]


def test_clean_keeps_columns_and_clean_rows(spark, table, empty):
    passage = " ".join(f"w{k}" for k in range(13))
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    long = " ".join(f"v{k}" for k in range(20 * 13 - 13))
    docs = table([(1, passage), (2, f"{passage} {long}"), (3, f"{passage} {long} more"), (4, "clean"), (5, None)])
    kept = decontam.clean(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5]
    assert decontam.clean(empty, items).count() == 0
    assert decontam.clean(docs, items.limit(0)).count() == 5


def test_items_without_an_id_still_hit(spark, table):
    from pyspark.sql import functions as F

    long, other = (" ".join(f"{x}{k}" for k in range(20)) for x in "ab")
    items = spark.createDataFrame([(None, long), (7, other), (None, other)], "item_id long, text string")
    docs = table([(1, long), (2, other), (3, "nothing of either")])
    rows = decontam.scan(docs, items).select("doc_id", "n_hit", "items", F.size("items").alias("n"), F.array_join("items", ",").alias("ids")).orderBy("doc_id").collect()
    # As in the SQL: items without an id count once, and their ids are not in the text of the list.
    assert [(r["n_hit"], r["n"], r["ids"]) for r in rows] == [(20, 1, ""), (20, 2, "7"), (0, 0, "")]
    assert [r["doc_id"] for r in decontam.clean(docs, items).collect()] == [3]
