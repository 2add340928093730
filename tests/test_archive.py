import os

import pytest

from strandlog import engine, model
from strandlog.errors import EngineError
from strandlog.sources import archive


def stream(seed):
    return bytes(seed + i for i in range(16))


def write(path, seed, rows, finalize=True):
    w = archive.ArchiveWriter(str(path), 0, bytes(16))
    done = [w.append(model.SOURCE_BYTES, stream(seed), a, b, data) for a, b, data in rows]
    if finalize:
        w.finalize()
    w.close()
    return done


def extract(spark, path, seed, policy="complete_archive"):
    return engine.extract_stream(spark, str(path), archive.stream_text(stream(seed)), policy=policy)


def test_crc32c_known_value():
    assert archive.crc32c(b"123456789") == 0xE3069283


def test_crc32c_of_many_values_at_once():
    import numpy as np

    data = np.random.default_rng(1).integers(0, 256, 9000, np.uint8).tobytes()
    values = [data[:n] for n in (0, 1, 511, 512, 513, 1024, 1500, 9000, 5)] + [bytes(2048), b"\xff" * 1023]
    assert archive.crc32c_many(values).tolist() == [archive.crc32c(v) for v in values]
    assert archive.crc32c_many([]).tolist() == []


def test_round_trip(spark, tmp_path):
    p = tmp_path / "a"
    write(p, 3, [(10, 20, b"first accepted payload\n"), (21, 30, b"second accepted payload")])
    r = archive.verify(spark, [str(p)]).first()
    assert (r["ok"], r["finalized"], r["committed_records"], r["message"]) == (True, True, 3, "archive verified and finalized")
    assert r["valid_prefix_bytes"] == r["file_bytes"] == os.path.getsize(p)
    assert extract(spark, p, 3) == b"first accepted payload\nsecond accepted payload"
    assert extract(spark, p, 9) == b""


def test_header_alone_is_whole_and_unfinalized(spark, tmp_path):
    p = tmp_path / "a"
    write(p, 3, [], finalize=False)
    r = archive.verify(spark, [str(p)]).first()
    assert (r["ok"], r["finalized"], r["committed_records"], r["message"]) == (True, False, 0, "complete streaming archive verified")


@pytest.mark.parametrize(
    ("at", "value", "message"),
    [
        (64, b"X", "invalid record envelope magic"),
        (64 + 92, b"\xff\xfe", "invalid record envelope size or CRC"),
        (64 + 96 + 2, b"X", "record SHA-256 mismatch"),
        (64 + 96 + 9, b"Z", "invalid or incomplete commit trailer"),
    ],
)
def test_damage_is_named(spark, tmp_path, at, value, message):
    p = tmp_path / "a"
    write(p, 8, [(0, 1, b"unaltered")])
    data = bytearray(p.read_bytes())
    data[at : at + len(value)] = value
    p.write_bytes(data)
    r = archive.verify(spark, [str(p)]).first()
    assert (r["ok"], r["error_code"], r["message"], r["committed_records"]) == (False, "archive_corrupt", message, 0)
    with pytest.raises(EngineError) as e:
        extract(spark, p, 8)
    assert e.value.code == "archive_corrupt"


def test_chain_and_sequence_breaks(spark, tmp_path):
    p = tmp_path / "a"
    done = write(p, 8, [(0, 1, b"one"), (1, 2, b"two")], finalize=False)
    data = p.read_bytes()
    # The second record cut out and put first: whole in itself, but its link and number do not fit.
    p.write_bytes(data[:64] + data[done[1].offset :])
    assert archive.verify(spark, [str(p)]).first()["message"] == "record hash-chain mismatch"
    w = archive.ArchiveWriter(str(tmp_path / "b"), 0)
    w.records.append(None)
    w.append(2, stream(1), 0, 1, b"x")
    w.close()
    assert archive.verify(spark, [str(tmp_path / "b")]).first()["message"] == "non-contiguous record sequence"


def test_torn_tail_and_repair(spark, tmp_path):
    p = tmp_path / "a"
    done = write(p, 12, [(0, 1, b"complete"), (2, 3, b"will be torn")])
    os.truncate(p, done[1].offset + 96 + 4)
    before = p.read_bytes()
    assert archive.verify(spark, [str(p)]).first()["message"] == "incomplete record payload or commit trailer"
    report = engine.repair(spark, str(p), str(tmp_path / "b"))
    assert report == {"recovered_records": 1, "recovered_payload_bytes": 8, "discarded_tail_bytes": 100}
    assert p.read_bytes() == before
    assert archive.verify(spark, [str(tmp_path / "b")]).first()["finalized"]
    assert extract(spark, tmp_path / "b", 12) == b"complete"


def test_strict_and_prefix_reads(spark, tmp_path):
    p = tmp_path / "a"
    done = write(p, 66, [(0, 1, b"prefix"), (2, 3, b"torn")])
    os.truncate(p, done[1].offset + 96 + 1)
    with pytest.raises(EngineError):
        archive.records(spark, [str(p)])
    assert archive.records(spark, [str(p)], "verified_prefix").count() == 1
    assert extract(spark, p, 66, "verified_prefix") == b"prefix"


def test_huge_length_is_no_overflow(spark, tmp_path):
    p = tmp_path / "a"
    write(p, 1, [], finalize=False)
    with p.open("ab") as f:
        f.write(archive.encode_envelope(2, 0, (1 << 63) + 5, 0, stream(1), 0, 1, bytes(32)) + b"abc" * 50)
    assert archive.verify(spark, [str(p)]).first()["message"] == "incomplete record payload or commit trailer"


def test_no_overwrite_and_no_alias(spark, tmp_path):
    p = tmp_path / "a"
    p.write_bytes(b"do not replace")
    with pytest.raises(EngineError):
        archive.ArchiveWriter(str(p))
    assert p.read_bytes() == b"do not replace"
    q = tmp_path / "q"
    write(q, 44, [(0, 1, b"preserve me")])
    os.symlink(q, tmp_path / "alias")
    with pytest.raises(EngineError):
        engine.repair(spark, str(q), str(tmp_path / "alias"))
    assert extract(spark, q, 44) == b"preserve me"


def test_payload_that_changes_after_verification(spark, tmp_path):
    p = tmp_path / "a"
    write(p, 55, [(0, 1, b"trusted bytes")])
    r = archive.records(spark, [str(p)]).filter("sequence = 0").first()
    args = (str(p), r["file_offset"], 0, r["record_type"], r["stream_id"], r["hash"])
    assert archive.read_payload(*args) == b"trusted bytes"
    data = bytearray(p.read_bytes())
    data[64 + 96] ^= 1
    p.write_bytes(data)
    with pytest.raises(EngineError):
        archive.read_payload(*args)


def test_splits_do_not_change_a_scan(spark, tmp_path):
    p = tmp_path / "a"
    write(p, 7, [(i, i + 1, bytes([i]) * 50) for i in range(30)])
    whole = archive.scan(spark, [str(p)]).orderBy("position").collect()
    split = archive.scan(spark, [str(p)], 400).orderBy("position").collect()
    assert whole == split and len(whole) == 31 and not any(r["failure"] for r in whole)


def test_sink_writes_what_the_writer_would(spark, tmp_path):
    text = archive.stream_text(stream(5))
    rows = spark.createDataFrame([("x", i, 2, text, i, i + 1, bytearray(b"p%d" % i)) for i in range(20)] + [("y", 0, 99, text, 0, 0, None)], "archive_id string, sequence long, record_type int, stream_id string, start_ns long, end_ns long, payload binary")
    done = {r["archive_id"]: r for r in archive.write_archives(rows, str(tmp_path)).collect()}
    assert done["x"]["records"] == 20 and done["y"]["payload_bytes"] == 0
    reports = archive.verify(spark, [done["x"]["path"], done["y"]["path"]]).collect()
    assert all(r["ok"] and r["finalized"] for r in reports)
    # A task that runs again finds its own file.
    assert {r["path"] for r in archive.write_archives(rows, str(tmp_path)).collect()} == {r["path"] for r in done.values()}
    changed = rows.withColumn("end_ns", rows.end_ns + 1)
    with pytest.raises(Exception, match="refusing to replace"):
        archive.write_archives(changed, str(tmp_path)).collect()


def test_writer_rules(tmp_path):
    w = archive.ArchiveWriter(str(tmp_path / "a"))
    with pytest.raises(EngineError):
        w.append(2, bytes(16), 5, 4, b"")
    w.finalize()
    w.finalize()
    with pytest.raises(EngineError):
        w.append(2, bytes(16), 0, 1, b"")


def test_bad_headers(spark, tmp_path):
    for name, data in (("short", b"short"), ("magic", bytes(64)), ("crc", archive.encode_header(0, bytes(16))[:-1] + b"\0")):
        (tmp_path / name).write_bytes(data)
    rows = archive.verify(spark, [str(tmp_path / n) for n in ("short", "magic", "crc", "none")]).collect()
    assert [r["error_code"] for r in rows] == ["archive_corrupt"] * 3 + ["archive_io"] and not any(r["ok"] for r in rows)


def test_followed_rows_equal_a_scan_over_ranges_growth_and_damage(spark, tmp_path):
    from strandlog.streaming.archives import follow

    paths = [str(tmp_path / n) for n in ("a.arc", "b.arc")]
    writers = [archive.ArchiveWriter(p, 0, bytes(16)) for p in paths]
    columns = ["archive_id", "position", "sequence", "payload", "file_offset", "hash"]

    def caught_up():
        q = follow(spark, paths, 1000).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*columns).collect()))

    def scanned():
        return sorted(map(tuple, archive.records(spark, paths, "verified_prefix").select(*columns).collect()))

    for w in writers:
        for i in range(40):
            w.append(model.SOURCE_BYTES, stream(1), i, i, b"%d" % i * 20)
    assert len(list(archive.hop(paths[0], 1000))) > 5
    first = caught_up()
    assert len(first) == 80 and first == scanned()
    for w in writers:
        for i in range(30):
            w.append(model.SOURCE_BYTES, stream(2), i, i, b"later %d" % i)
        w.close()
    with open(paths[1], "r+b") as f:
        f.seek(writers[1].records[55].offset + model.ENVELOPE_SIZE)
        f.write(b"X")
    second = caught_up()
    assert len(second) == 70 + 55 and second == scanned()


def test_appended_batches_are_there_once_and_go_on_after_losses(spark, tmp_path):
    from strandlog.streaming.archives import append, append_batch

    schema = "archive_id string, event_order long, record_type int, stream_id string, start_ns long, end_ns long, payload binary"
    text = archive.stream_text(stream(5))

    def batch(a, b):
        return spark.createDataFrame([(n, i, 2, text, i, i + 1, bytearray(b"%d" % i * 9) if i % 5 else None) for i in range(a, b) for n in "xy"], schema)

    def found():
        return {(r["archive_id"][-5:], r["sequence"]): (r["start_ns"], r["payload_size"]) for r in archive.records(spark, paths).collect()}

    paths, source = [str(tmp_path / f"{n}.arc") for n in "xy"], str(tmp_path / "in")
    for k in range(2):
        batch(20 * k, 20 * k + 20).coalesce(1).write.mode("append").parquet(source)
        rows = spark.readStream.schema(schema).parquet(source)
        append(rows, str(tmp_path), str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    first = found()
    assert len(first) == 80 and all(first[n, i][0] == i for n in ("x.arc", "y.arc") for i in range(40))
    assert all(r["ok"] and not r["finalized"] for r in archive.verify(spark, paths).collect())
    whole = [open(p, "rb").read() for p in paths]
    # The last batch again: unchanged, with a torn record, and with several records lost.
    for lost in (0, 7, 500):
        os.truncate(paths[0], len(whole[0]) - lost)
        append_batch(batch(20, 40), str(tmp_path), 1).collect()
        assert [open(p, "rb").read() for p in paths] == whole
    # An earlier batch that comes late changes nothing; other rows under the same number are refused.
    append_batch(batch(0, 20), str(tmp_path), 0).collect()
    with pytest.raises(Exception, match="holds other records"):
        append_batch(batch(21, 41), str(tmp_path), 1).collect()
    assert [open(p, "rb").read() for p in paths] == whole
    append_batch(batch(40, 45), str(tmp_path), 2).collect()
    assert len(found()) == 90
    # What the stream did not begin, or what was damaged since, it does not touch.
    write(tmp_path / "z.arc", 1, [(0, 1, b"other")])
    with pytest.raises(Exception, match="no stream began"):
        append_batch(batch(0, 1).replace({"x": "z"}, subset=["archive_id"]), str(tmp_path), 0).collect()
    os.truncate(paths[0], os.path.getsize(paths[0]) - 3)
    with pytest.raises(Exception, match="damaged after"):
        append_batch(batch(45, 46), str(tmp_path), 3).collect()
