"""Each query of the registry against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from strandlog.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def canon(frame):
    cols = sorted(frame.columns)
    rows = frame[cols].astype(object).where(frame[cols].notna(), None).itertuples(index=False, name=None)
    return cols, sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLE_SQL:
        assert canon(got.toPandas()) == canon(con.execute(registry.ORACLE_SQL[name]).df())
    else:
        assert got.count() > 0


def test_whole_paths(spark):
    assert all(r["ok"] and r["finalized"] for r in registry.archive_roundtrip(spark, SF).collect())
    assert {r["statement_state"] for r in registry.statement_roundtrip(spark, SF).collect()} <= {"valid", "not_yet_valid", "expired"}
    marks = registry.watermark_roundtrip(spark, SF).collect()
    assert marks and all(r["code"] == int(r["audio_id"]) * 40503 % 65536 for r in marks)


def test_stream_chains_equal_batch_chains(spark):
    batch = {r["archive_id"]: r["head_hash"] for r in registry.hash_chain(spark, SF).collect()}
    assert {r["archive_id"]: r["head_hash"] for r in registry.chain_stream(spark, SF).collect()} == batch


def test_crc32c_column(spark):
    from strandlog.sources.archive import crc32c, crc32c_column

    values = [b"", b"123456789", b"a" * 100, None, b"\0"]
    df = spark.createDataFrame([(i, bytearray(v) if v is not None else None) for i, v in enumerate(values)], "i int, p binary")
    assert [r["crc32c"] for r in crc32c_column(df, "p").orderBy("i").collect()] == [None if v is None else crc32c(v) for v in values]


def test_tail_stream_follows_every_archive_to_its_end(spark):
    source = spark.read.parquet(f"{SF}/conversations.parquet")
    got = registry.tail_stream(spark, SF)
    columns = ["position", "payload_size", "hash"]
    assert got.count() == source.count()
    heads = {r["archive_id"]: r["n"] for r in got.groupBy("archive_id").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert heads == {str(r["a"]): r["n"] for r in source.selectExpr("conv_id % 16 a").groupBy("a").count().withColumnRenamed("count", "n").collect()}
    assert got.select("archive_id", *columns).distinct().count() == got.count()


def test_watermark_roundtrip_makes_a_clip_of_every_row(spark):
    ids = {str(r["vec_id"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect()}
    assert {r["audio_id"] for r in registry.watermark_roundtrip(spark, SF).select("audio_id").collect()} == ids


def test_watermark_roundtrip_where_reads_beside_a_mark_pass_by_chance(spark, tmp_path):
    ids = [0, 35198, 35198, 40923, 42798, 53822, 72780, 87570]
    spark.createDataFrame([(i,) for i in ids], "vec_id long").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    own = duckdb.connect()
    own.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert canon(registry.watermark_roundtrip(spark, str(tmp_path)).toPandas()) == canon(own.execute(registry.ORACLE_SQL["watermark_roundtrip"]).df())


def test_record_hashes_are_those_that_archives_store(spark):
    stored = {(r["archive_id"], r["sequence"]): r["hash"] for r in registry.tail_stream(spark, SF).collect()}
    assert {(r["archive_id"], r["sequence"]): r["hash"] for r in registry.record_hashes(spark, SF).collect()} == stored


def test_acceptance_is_the_detectors_own(spark):
    import random

    from pyspark.sql import functions as F

    from strandlog.functions import scalars
    from strandlog.operators import watermark

    rng = random.Random(3)
    values = [rng.randrange(1 << 40) for _ in range(200)]
    for code in (0, 1, 0x4A31, 0xFFFF):
        sent = int("".join(map(str, watermark.bits_of(code))), 2)
        values += [sent ^ m for m in (0, 1, 1 << 24, 3 << 30, 7 << 30, 1 << 9)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = df.select("v", scalars.accepted(F.col("v"), F.lit(0.5)).alias("a"), scalars.accepted(F.col("v"), F.lit(0.2)).alias("b")).collect()
    assert all(r["a"] == watermark.accepts(r["v"]) and not r["b"] for r in got) and any(r["a"] for r in got)


def test_ipv6_addresses_as_columns_and_in_python_agree(spark):
    import ipaddress
    import random

    from pyspark.sql import functions as F

    from strandlog.functions import scalars
    from strandlog.sources import feeds

    rng = random.Random(2)
    texts = ["::", "::1", "2001:db8::1", "2001:db9::", "fe80::1", "fc00::", "2606:4700::1111", "3fff:ffff::", "4000::", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "::ffff:808:808", "64:ff9b::1.2.3.4", "2000::", "1:2:3:4:5:6:7:8"]
    texts += [str(ipaddress.ip_address(rng.getrandbits(128) >> rng.choice([0, 3, 64]))) for _ in range(60)]
    texts = [t for t in texts if ":" in t]
    bad = ["", "x", "1:2:3", "1:2:3:4:5:6:7:8:9", "12345::", "1::2::3", "::256.1.1.1", "1.2.3.4", "1:2:3:4:5:6:7::8"]
    df = spark.createDataFrame([(t,) for t in texts + bad], "a string")
    got = {r["a"]: r["r"] for r in df.select("a", scalars.routable_ipv6(F.col("a")).alias("r")).collect()}
    assert all(got[t] == feeds.routable(t) for t in texts)
    assert all(got[t] is None for t in bad[:-1])


def test_positions_of_sparse_orders(spark):
    from pyspark.sql import functions as F

    from strandlog.operators import integrity

    rows = [("a", k * k * 10**9) for k in range(300)] + [("b", 5), ("b", -7), ("c", 0)]
    df = spark.createDataFrame(rows, "archive_id string, order long")
    got = integrity.positions(df, "archive_id", "order", block=16).collect()
    for key in "abc":
        assert [r["position"] for r in sorted((r for r in got if r["archive_id"] == key), key=lambda r: r["order"])] == list(range(sum(k == key for k, _ in rows)))
    assert df.select(F.col("order")).count() == len(got)


def test_names_of_streams(spark):
    from pyspark.sql import functions as F

    from strandlog import model

    df = spark.createDataFrame([(k,) for k in (0, 6, 13, 65534, 99)], "k int")
    assert [r[0] for r in df.select(model.stream_type_name(F.col("k"))).collect()] == ["opaque", "navigation", "authorization_policy", "custom", "unknown"]
    assert [r[0] for r in df.select(model.truth_class_name(F.col("k"))).collect()][0] == "source_exact"
    assert spark.createDataFrame([], model.STREAMS).columns[0] == "stream_id"
