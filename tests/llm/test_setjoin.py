import random
import re

import numpy as np
import pytest

from strandlog.llm import setjoin

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + n]) for k in range(max(len(w) - n, 0) + 1)} if w else set()


def brute(rows, n=4, num=85, den=100):
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        root(a)
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                parent[root(a)] = root(b)
    groups = {}
    for a, (i, s) in enumerate(sets):
        if s and i is not None:
            groups.setdefault(root(a), []).append(i)
    out = [(i, len(s), min(groups[root(a)]) if s and root(a) in groups else i) for a, (i, s) in enumerate(sets)]
    return sorted(out, key=repr)


def near_copies(seed, n, size):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(n):
        base = rows[rng.randrange(len(rows))][1].split() if rows and rng.random() < 0.7 else [rng.choice(vocab) for _ in range(rng.randrange(1, size))]
        w = list(base)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 8])):
            at = rng.randrange(len(w))
            w[at : at + rng.choice([0, 1])] = [rng.choice(vocab)] * rng.choice([0, 1])
            w = w or ["w"]
        rows.append((k * 3 % 997, " ".join(w)))
    return rows


@pytest.mark.parametrize(("size", "n", "num"), [(12, 4, 85), (60, 4, 85), (400, 4, 85), (80, 5, 80), (40, 2, 60)])
def test_components_against_brute_force(table, size, n, num):
    rows = near_copies(size, 160, size)
    got = sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in setjoin.join(table(rows), n, num, 100).collect()], key=repr)
    assert got == brute(rows, n, num)


def test_odd_rows(table, odd_rows, odd, empty):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in setjoin.join(odd).collect()}
    assert {x for x in got if x[0] is not None} == {x for x in set(brute(odd_rows)) if x[0] is not None}
    assert setjoin.join(empty).count() == 0
    kept = setjoin.deduplicated(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 2, 3, 4, 5, 7, 8, 9, 10, 11]
    assert sum(r["doc_id"] is None for r in kept.collect()) == 2


@pytest.mark.parametrize(("num", "den"), [(85, 100), (80, 100), (1, 2)])
def test_linked_sets_share_a_signature(num, den):
    rng = np.random.default_rng(num)
    plan = setjoin.Plan(num, den)
    for _ in range(400):
        size = int(rng.integers(1, 300))
        x = rng.integers(0, 1 << 63, size).astype(np.uint64)
        for y in (x[: int(np.ceil(size * num / den))], np.concatenate([x, rng.integers(0, 1 << 63, size * (den - num) // num).astype(np.uint64)])):
            x, y = np.unique(x), np.unique(y)
            both = len(np.intersect1d(x, y))
            if den * both < num * (len(x) + len(y) - both) or len(x) == len(y) == both:
                continue
            owner = np.repeat([0, 1], [len(x), len(y)])
            sig, of = plan.signatures(owner, np.concatenate([x, y]), 2)
            assert set(sig[of == 0]) & set(sig[of == 1])
            a, b = (np.frombuffer(s, np.uint8) for s in plan.sketches(owner, np.concatenate([x, y]), 2))
            apart = np.bitwise_count(np.bitwise_xor(*setjoin._folded([a.tobytes(), b.tobytes()]))).sum()
            assert apart <= len(x) + len(y) - 2 * both <= plan.differ(len(x) + len(y))


def test_sets_with_many_empty_segments(monkeypatch):
    """Every seed and the last resort are used when no segment is spare."""
    monkeypatch.setattr(setjoin.Plan, "_allocate", lambda self, band: np.full(self.needed(band), 1, np.uint8))
    rng = np.random.default_rng(3)
    plan, last = setjoin.Plan(85, 100), []
    real = setjoin.Plan._whole.__func__
    monkeypatch.setattr(setjoin.Plan, "_whole", classmethod(lambda cls, owner, token, live, *a: last.append(live.sum()) or real(cls, owner, token, live, *a)))
    for size in (14, 40, 90):
        for _ in range(40):
            x = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            y = x[: -(size // 14)]
            sig, of = plan.signatures(np.repeat([0, 1], [len(x), len(y)]), np.concatenate([x, y]), 2)
            assert set(sig[of == 0]) & set(sig[of == 1])
    assert sum(last)


@pytest.mark.parametrize("num", [85, 80])
def test_allocation_follows_cost(num):
    """Segments in which a frequent token falls are left out or keep company; without any, most sets send about H + 1 signatures."""
    plain, rng = setjoin.Plan(num, 100), np.random.default_rng(1)
    cells = np.full(setjoin.CELLS, 5)
    band = int(plain.band(np.array([100]))[0])
    cells[[7, 2000]] = 900_000
    hot = setjoin.Plan(num, 100, {band: (1_000_000, cells)})
    cold, levels, need = plain.of(band), hot.of(band), hot.needed(band)
    for cell in (7, 2000):
        assert levels[cell * len(levels) // setjoin.CELLS] != 1
    assert need <= cold.sum() <= 1.3 * need + 2 and set(cold.tolist()) <= {0, 1}
    assert hot.of(band + 1).size == 0  # no sets there
    sets = [np.unique(rng.integers(0, 1 << 63, 100).astype(np.uint64)) for _ in range(200)]
    sig, _ = plain.signatures(np.repeat(np.arange(200), [len(x) for x in sets]), np.concatenate(sets), 200)
    assert len(sig) / 200 < 2 * 1.6 * need
    for x in sets:  # whatever the allocation, linked sets share a signature
        y = x[: -(100 - num) // 2]
        sig, of = hot.signatures(np.repeat([0, 1], [len(x), len(y)]), np.concatenate([x, y]), 2)
        assert set(sig[of == 0]) & set(sig[of == 1])


@pytest.mark.parametrize("num", [85, 80])
def test_frequent_shingles(table, num):
    """A line that all documents share, and passages that many do, change no link."""
    rng = random.Random(num)
    line = "this line stands in each and every document of the lot"
    passages = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(30)) for _ in range(3)]
    rows = [(i, f"{line} {rng.choice(passages)} {t}") for i, (_, t) in enumerate(near_copies(77, 150, 50))]
    got = sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in setjoin.join(table(rows), 5, num, 100).collect()], key=repr)
    assert got == brute(rows, 5, num)


def test_large_groups_in_parts(table, monkeypatch):
    monkeypatch.setattr(setjoin, "CHUNK", 8)
    monkeypatch.setattr(setjoin, "MEMBERS", 5)
    rows = near_copies(9, 120, 40)
    got = sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in setjoin.join(table(rows)).collect()], key=repr)
    assert got == brute(rows)


def test_other_texts_of_an_id_are_kept(table):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (2, b), (2, c), (2, b), (3, b), (4, c + " end"), (5, ""), (5, " "), (6, a), (6, "unlike all others by far")]
    # b and c differ, so id 2 stays for both; 3 and 4 are near them, 6 once near 1.
    for order in (rows, rows[::-1]):
        got = sorted((r["doc_id"], r["text"].strip()) for r in setjoin.deduplicated(table(order)).collect())
        assert got == sorted([(1, a), (2, b), (2, c), (5, ""), (6, "unlike all others by far")])


def test_members_are_compared_with_the_set_they_were_paired_with(spark, table):
    from pyspark.sql import functions as F

    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    docs = table([(1, a), (1, b), (2, a + " end"), (3, b + " end")])
    own = docs.select("doc_id", "text").mapInArrow(setjoin._describe(4, 85, 100), setjoin._DESCRIBED_SQL).filter("name is null")
    classes = own.groupBy("entity", "other").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")).cache()
    of = {r["rep"]: r["entity"] for r in classes.collect() if r["rep"] > 1}
    ones = [r["entity"] for r in classes.filter("rep = 1").collect()]
    pairs = spark.createDataFrame([(x, y) for x in ones for y in of.values()], "a long, b long")
    assert sorted(map(tuple, setjoin._verified(pairs, classes, docs, 4, 85, 100).collect())) == [(1, 2), (1, 3)]
