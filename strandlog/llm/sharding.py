"""Balanced shards that keep linked documents together.

Method: balanced label propagation over groups of linked documents. Documents start with a shard by a hash of their ids. A
shard's quota is its share of the rows under the law of equal row counts. In each round every group without a home asks for
the shard that most of its members are in, of those that have not refused it yet; a shard grants whole groups while its quota
lasts, the largest first. Groups that are refused in all rounds go whole to the shards with most room, the largest first.
Only groups over a quota (before all others), and groups for which no shard has room any more, are split, over the shards
with most room; each of them fills a shard, so they are no more than shards. Documents without links fill each shard to its quota, those
that started there first. Row counts are at most one apart.

Quotas are met by counts: the driver sees how many groups of each size ask for each shard, which is bounded by the root of
the rows, and answers with ranges of ordinals. Ordinals and slots come from row numbers inside blocks and from the counts of
the blocks, so that no task sorts a whole shard. Groups of over 1 / HOT of all rows are broadcast to their rows.

Defined results: null text is linked with nothing and has no bytes; repeated rows are documents of their own; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, texts

SHARDS = 24
ROUNDS = 3
BLOCKS = 128
HOT = 1000

Ranges = list[tuple[int, int, int, int]]


def _numbered(df: DataFrame, cell: list[str], order: list[str], blocks: int = BLOCKS) -> DataFrame:
    """Adds `at`, the ordinal (from 0) of each row in its cell."""
    df = df.withColumn("block", F.pmod(F.xxhash64(*order, F.lit(2)), F.lit(blocks)))
    counts = df.groupBy(*cell, "block").agg(F.count("*").alias("rows"))
    before = counts.withColumn("before", F.sum("rows").over(Window.partitionBy(*cell).orderBy("block")) - F.col("rows")).drop("rows")
    row = F.row_number().over(Window.partitionBy(*cell, "block").orderBy(*order)) - 1
    return df.join(before, [*cell, "block"]).withColumn("at", F.col("before") + row).drop("block", "before")


def _ranged(df: DataFrame, cell: str, ranges: Ranges, name: str) -> DataFrame:
    """Adds `name` by (cell, first ordinal, end, value): the value of the range that `at` of a row lies in, or null."""
    table = df.sparkSession.createDataFrame(ranges, f"_cell long, _first long, _end long, `{name}` int")
    inside = (F.col(cell) == F.col("_cell")) & (F.col("at") >= F.col("_first")) & (F.col("at") < F.col("_end"))
    return df.join(F.broadcast(table), inside, "left").drop("_cell", "_first", "_end", "at")


def _fill(room: list[int], sizes: dict[int, int], ranges: Ranges, splits: Ranges) -> None:
    """Places groups, the largest first, where there is most room, and takes it. sizes: size to number of groups.

    ranges: (size, first, end, shard) of whole groups, or -1 - k as the shard of the k-th split group, whose rows splits has.
    """
    for size in sorted(sizes, reverse=True):
        at = 0
        while at < sizes[size]:
            most = room.index(max(room))
            if n := min(sizes[size] - at, room[most] // size):
                ranges.append((size, at, at + n, most))
                room[most] -= n * size
                at += n
                continue
            mark, done = -1 - len({r[0] for r in splits}), 0
            while done < size:
                most = room.index(max(room))
                take = min(size - done, room[most])
                splits.append((mark, done, done + take, most))
                room[most] -= take
                done += take
            ranges.append((size, at, at + 1, mark))
            at += 1


def _granted(room: list[int], asked: list[tuple[int, int, int]]) -> Ranges:
    """What the shards grant, largest groups first, and takes the room. asked: (shard, size, number of groups)."""
    out = []
    for goal, size, n in sorted(asked, reverse=True):
        if n := min(n, room[goal] // size):
            out.append((goal, size, n))
            room[goal] -= n * size
    return out


def _placed(rows: DataFrame, quotas: list[int], rounds: int) -> tuple[DataFrame, Ranges, list[int]]:
    """rows: (group, label). Groups of two or more as (group, n, home), home -1 - k for split ones; the splits; the room left."""
    spark, room, splits = rows.sparkSession, list(quotas), []
    counts = rows.groupBy("group", "label").agg(F.count("*").alias("n"))
    wishes = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "label"))), lambda x: x["label"])
    linked = materialize(counts.groupBy("group").agg(F.sum("n").alias("n"), wishes.alias("wishes")).filter("n > 1"))
    histogram = lambda df: {r["n"]: r["count"] for r in df.groupBy("n").count().collect()}

    def put(df: DataFrame) -> DataFrame:
        ranges: Ranges = []
        _fill(room, histogram(df), ranges, splits)
        return _ranged(_numbered(df.select("group", "n"), ["n"], ["group"]), "n", ranges, "home")

    homes = put(linked.filter(F.col("n") > max(quotas)))
    waiting = linked.filter(F.col("n") <= max(quotas))
    for k in range(min(rounds, len(quotas))):
        asks = waiting.withColumn("goal", F.get("wishes", F.lit(k)))
        cells = [(r["goal"], r["n"], r["count"]) for r in asks.filter("goal is not null").groupBy("goal", "n").count().collect()]
        if not cells:
            break
        table = spark.createDataFrame(_granted(room, cells), "goal int, n long, most long")
        dealt = _numbered(asks.filter("goal is not null"), ["goal", "n"], ["group"]).join(F.broadcast(table), ["goal", "n"], "left")
        home = F.when(F.col("at") < F.col("most"), F.col("goal"))
        done = materialize(dealt.select("group", "n", "wishes", home.alias("home")).unionByName(asks.filter("goal is null").drop("goal").withColumn("home", F.lit(None).cast("int"))))
        homes = homes.unionByName(done.filter("home is not null").select("group", "n", "home"))
        waiting = done.filter("home is null").drop("home")
    return materialize(homes.unionByName(put(waiting))), splits, room


def homes(rows: DataFrame, total: int, shards: int = SHARDS, rounds: int = ROUNDS, slack: float = 0.0) -> DataFrame:
    """rows: (group, label), one for each document. Returns (group, home, n) of the groups of two documents or more.

    slack: share of a shard's rows by which groups may go over them. home is negative for groups that are split.
    """
    return _placed(rows, [int(q * (1 + slack)) for q in quotas(total, shards)], rounds)[0].select("group", "home", "n")


def quotas(total: int, shards: int) -> list[int]:
    """Rows of each shard, at most one apart."""
    ends = [total * k // shards for k in range(shards + 1)]
    return [b - a for a, b in zip(ends, ends[1:], strict=False)]


def ranked(rows: DataFrame, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """rows: (group binary, label int, id, ...). Adds shard and slot."""
    rows = materialize(rows)
    names = rows.columns
    total = rows.count()
    home, splits, room = _placed(rows.select("group", "label"), quotas(total, shards), rounds)
    # At most HOT groups have over 1 / HOT of all rows each.
    hot = F.col("n") > total // HOT
    df = rows.join(F.broadcast(home.filter(hot).select("group", F.col("home").alias("hot_home"))), "group", "left")
    cold = df.filter("hot_home is null").drop("hot_home").join(home.filter(~hot).select("group", "home"), "group", "left")
    df = materialize(cold.select(*names, "home").unionByName(df.filter("hot_home is not null").select(*names, F.col("hot_home").alias("home"))))
    whole = df.filter("home >= 0").select(*names, F.col("home").alias("shard"))
    split = _ranged(_numbered(df.filter("home < 0"), ["home"], ["id"], HOT), "home", splits, "shard")
    free = _ranged(_numbered(df.filter("home is null"), ["label"], ["group"]), "label", _rest(room, df), "shard")
    df = materialize(whole.unionByName(split.select(whole.columns)).unionByName(free.select(whole.columns)))
    return _numbered(df, ["shard"], ["group", "id"]).withColumnRenamed("at", "slot")


def _rest(room: list[int], df: DataFrame) -> Ranges:
    """(label, first, end, shard) of the documents without links: those with a shard's label first, then others."""
    free = Counter({r["label"]: r["count"] for r in df.filter("home is null").groupBy("label").count().collect()})
    room = list(room)
    ranges, kept = [], {}
    for label in range(len(room)):
        kept[label] = n = min(free[label], room[label])
        ranges.append((label, 0, n, label))
        room[label] -= n
    for label, at in kept.items():
        while at < free[label]:
            most = room.index(max(room))
            n = min(free[label] - at, room[most])
            ranges.append((label, at, at + n, most))
            room[most] -= n
            at += n
    return ranges


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size (bytes of UTF-8 and 8), text_crc32, shard and slot (gapless from 0) of every document; equal texts are linked."""
    text = F.coalesce("text", F.lit(""))
    rows = texts(docs).select(
        F.col("doc_id").alias("id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        # A null text's group is a byte longer than any text's.
        F.unhex(F.coalesce(F.md5("text"), F.concat(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit("00")))).alias("group"),
        F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)).cast("int").alias("label"),
    )
    return ranked(rows, shards, rounds).withColumnRenamed("id", "doc_id")
