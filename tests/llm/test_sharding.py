from collections import Counter, defaultdict

from strandlog.llm import sharding


def check(rows, n_docs, shards):
    assert len(rows) == n_docs
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(k, ())) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    return slots


def test_laws_and_groups(table, odd_rows):
    rows = odd_rows + [(100 + k, f"text {k % 90}") for k in range(300)] + [(1000 + k, "hot") for k in range(200)]
    got = sharding.shard(table(rows), 8).collect()
    check(got, len(rows), 8)
    where = defaultdict(set)
    for r in got:
        where[r["text_crc32"], r["size"]].add(r["shard"])
    texts = Counter(t for _, t in rows)
    hot = where[[(r["text_crc32"], r["size"]) for r in got if r["doc_id"] == 1000][0]]
    assert len(hot) <= -(-texts["hot"] * 8 // len(rows)) + 1
    cut = sum(len(s) > 1 for s in where.values())
    assert cut <= 8
    import zlib

    by_id = {i: t for i, t in rows}
    for r in got:
        if r["doc_id"] is not None:
            t = (by_id[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(t) + 8, zlib.crc32(t))


def test_few_and_none(table, empty):
    assert sharding.shard(empty).count() == 0
    check(sharding.shard(table([(1, "a"), (2, None), (2, None)]), 24).collect(), 3, 24)


def test_hot_groups_are_dealt_over_blocks(table, monkeypatch):
    monkeypatch.setattr(sharding, "HOT", 4)
    rows = [(k, "hot" if k % 2 else f"t{k}") for k in range(400)]
    slots = check(sharding.shard(table(rows), 6).collect(), 400, 6)
    assert len(slots) == 6


def test_propagation_gathers_groups(spark):
    rows = spark.createDataFrame([(bytearray([g]), (g * 7 + k) % 5) for g in range(40) for k in range(6)], "group binary, label int")
    home = sharding.homes(rows, 240, 5, rounds=4, slack=0.5).collect()
    assert len(home) == 40 and all(r["n"] == 6 for r in home)
    load = Counter(r["home"] for r in home)
    assert max(load.values()) * 6 <= 240 / 5 * 1.5 + 6


def test_whole_groups_fit_quotas_and_only_oversized_ones_are_cut(table):
    rows = [(k, f"group {k // 7}") for k in range(700)] + [(1000 + k, "huge") for k in range(300)] + [(2000 + k, f"single {k}") for k in range(203)]
    got = sharding.shard(table(rows), 8).collect()
    check(got, len(rows), 8)
    text, where = dict(rows), defaultdict(set)
    for r in got:
        where[text[r["doc_id"]]].add(r["shard"])
    assert [t for t, shards in where.items() if len(shards) > 1] == ["huge"] and len(where["huge"]) == 2


def test_rounds_and_quotas_change_homes(spark):
    # Thirty groups of four have most members in shard 2; a quota of 60 rows takes fifteen of them, the rest ask for shard 3.
    rows = spark.createDataFrame([(bytearray([g]), (2, 2, 2, 3)[k]) for g in range(30) for k in range(4)], "group binary, label int")
    got = [Counter(r["home"] for r in sharding.homes(rows, 240, 4, rounds=n).collect()) for n in (0, 1, 2)]
    assert got == [{0: 15, 1: 15}, {2: 15, 0: 15}, {2: 15, 3: 15}]
    assert Counter(r["home"] for r in sharding.homes(rows, 240, 4, rounds=1, slack=1.0).collect()) == {2: 30}


def plain_homes(groups, quotas, rounds):
    """groups: name to (labels of its members, order). Returns name to home, None for groups that are split."""
    room, homes = list(quotas), {}
    size = {g: len(labels) for g, (labels, _) in groups.items() if len(labels) > 1}
    order = lambda g: groups[g][1]

    def fill(names):
        for n in sorted({size[g] for g in names}, reverse=True):
            waiting = sorted((g for g in names if size[g] == n), key=order)
            while waiting:
                most = room.index(max(room))
                if room[most] >= n:  # as many of them as this shard takes
                    while waiting and room[most] >= n:
                        homes[waiting.pop(0)], room[most] = most, room[most] - n
                    continue
                homes[waiting.pop(0)], left = None, n
                while left:
                    most = room.index(max(room))
                    take = min(left, room[most])
                    room[most] -= take
                    left -= take

    fill([g for g in size if size[g] > max(quotas)])
    for k in range(min(rounds, len(quotas))):
        asks = {}
        for g in size:
            wishes = sorted(Counter(groups[g][0]).items(), key=lambda x: (-x[1], x[0]))
            if g not in homes and k < len(wishes):
                asks.setdefault(wishes[k][0], []).append(g)
        for shard, names in asks.items():
            for g in sorted(names, key=lambda g: (-size[g], order(g))):
                if room[shard] >= size[g]:
                    homes[g], room[shard] = shard, room[shard] - size[g]
    fill([g for g in size if g not in homes])
    return homes


def test_shards_equal_plain_propagation(spark, table):
    import hashlib
    import random

    from pyspark.sql import functions as F

    for seed, shards, largest in ((1, 4, 9), (2, 7, 40), (3, 24, 3), (4, 3, 120)):
        rng = random.Random(seed)
        rows = [(i, f"t{rng.randrange(60)}" if rng.random() < 0.7 else f"alone {i}") for i in range(400)] + [(1000 + i, "big") for i in range(largest)]
        docs = table(rows)
        # What the operator starts from: labels by the hash of ids, an order by the hash of groups.
        starts = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)).alias("label"), F.unhex(F.md5("text")).alias("g"))
        groups = {}
        for r in starts.withColumn("b", F.pmod(F.xxhash64("g", F.lit(2)), F.lit(sharding.BLOCKS))).collect():
            groups.setdefault(r["text"], ([], (r["b"], hashlib.md5(r["text"].encode()).digest())))[0].append(r["label"])
        expected = plain_homes(groups, sharding.quotas(len(rows), shards), sharding.ROUNDS)
        text, where = dict(rows), defaultdict(set)
        got = sharding.shard(docs, shards).collect()
        check(got, len(rows), shards)
        for r in got:
            where[text[r["doc_id"]]].add(r["shard"])
        for name, home in expected.items():
            assert len(where[name]) > 1 if home is None else where[name] == {home}


def test_a_null_text_is_no_text(table):
    from pyspark.sql import functions as F

    docs = table([(5, None), (6, "null:5"), (7, "null:5")] + [(10 + k, f"x{k}") for k in range(9)])
    found = sharding.shard(docs, 3).groupBy("shard").agg(F.collect_list("doc_id").alias("d")).collect()
    assert any({6, 7} <= set(r["d"]) for r in found) and sorted(len(r["d"]) for r in found) == [4, 4, 4]
