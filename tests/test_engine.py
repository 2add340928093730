import os

import pytest
from pyspark.sql import functions as F

from strandlog import cli, engine
from strandlog.errors import EngineError
from strandlog.functions import scalars
from strandlog.operators import capture
from strandlog.sources import feeds
from strandlog.sources.archive import verify


def test_file_feed_round_trip(spark, tmp_path):
    source = tmp_path / "in"
    source.write_bytes(b"preserve-first\nwith another line\n")
    report = engine.record([engine.Feed(str(source), "local-test"), engine.Feed(f"file://{source}", "again")], str(tmp_path / "a"))
    assert (report["feeds_recorded"], report["source_bytes"], report["source_records"]) == (2, 66, 2)
    assert engine.extract_feed(spark, str(tmp_path / "a"), "again", str(tmp_path / "out")) == source.read_bytes()
    assert (tmp_path / "out").read_bytes() == source.read_bytes()
    rows = engine.list_feeds(spark, str(tmp_path / "a")).collect()
    assert [r["label"] for r in rows] == ["local-test", "again"] and rows[0]["fidelity"] == "S0"
    r = engine.inspect(spark, [str(tmp_path / "a")]).first()
    assert r["ok"] and r["feeds"] == 2 and r["committed_records"] == 5
    with pytest.raises(EngineError) as e:
        engine.extract_feed(spark, str(tmp_path / "a"), "none")
    assert e.value.code == "invalid_argument"
    with pytest.raises(EngineError):
        engine.extract_feed(spark, str(tmp_path / "a"), "again", fidelity="derived")


def test_small_chunks_and_limits(spark, tmp_path):
    source = tmp_path / "in"
    source.write_bytes(b"x" * 10_000)
    assert engine.record([engine.Feed(str(source), "f")], str(tmp_path / "a"), 4096)["source_records"] == 3
    with pytest.raises(EngineError) as e:
        engine.record([engine.Feed(str(source), "f", maximum_bytes=5000)], str(tmp_path / "b"), 4096)
    assert e.value.code == "resource_exhausted"
    r = verify(spark, [str(tmp_path / "b")]).first()  # what was accepted stays, without an index
    assert r["ok"] and not r["finalized"] and r["committed_records"] == 2


@pytest.mark.parametrize("label", ["", "a=b", "sp ace", "ü", "x" * 129])
def test_bad_labels(label, tmp_path):
    with pytest.raises(EngineError) as e:
        engine.record([engine.Feed("/dev/null", label)], str(tmp_path / "a"))
    assert e.value.code == "invalid_argument" and not (tmp_path / "a").exists()


def test_refused_sources(tmp_path):
    a = tmp_path / "a"
    for uri, code in [("http://2130706433:9/private", None), ("http://127.0.0.1/x", "unauthorized_source"), ("ftp://x/y", "protocol"), (str(tmp_path / "none"), "archive_io")]:
        with pytest.raises(EngineError) as e:
            engine.record([engine.Feed(uri, "f")], str(a))
        assert code is None or e.value.code == code
        if code:
            assert not a.exists()
        a.unlink(missing_ok=True)
    os.symlink(a, tmp_path / "link")
    with pytest.raises(EngineError):
        engine.record([engine.Feed(str(tmp_path / "link"), "f", maximum_bytes=1024)], str(a))
    assert not a.exists()
    a.write_bytes(b"source")
    with pytest.raises(EngineError):
        engine.record([engine.Feed(str(a), "f")], str(a))
    assert a.read_bytes() == b"source"


def test_numeric_loopback_is_not_routable():
    assert not feeds.routable("127.0.0.1") and not feeds.routable("::ffff:10.0.0.1") and not feeds.routable("2001:db8::1") and not feeds.routable("fe80::1")
    assert feeds.routable("8.8.8.8") and feeds.routable("2606:4700::1")


URIS = [
    "https://user:pw@host/p?q#f", "https://host/p@x", "file:///a?b", "no-scheme?x#y", "http://a@b@c/d", "https://h?u=http://x@y", "http://10.example.com/", "http://LOCALHOST:8/",
    "http://x.localhost", "http://[::1]/", "http://[::1", "http://172.16.0.1/", "http://172.32.0.1/", "http://172.abc.0.1/", "http://172.99999999999.1/", "http://u@127.0.0.1/", "http://8.8.8.8/", "ws://h/a://b@c",
]


def test_uri_expressions_agree_with_the_reader(spark):
    df = spark.createDataFrame([(u,) for u in URIS], "uri string")
    for r in df.select("uri", scalars.redacted_uri(F.col("uri")).alias("red"), scalars.private_host(F.col("uri")).alias("private")).collect():
        assert r["red"] == engine.redacted(r["uri"]), r
        assert r["private"] == feeds.private_host(r["uri"]), r


def test_redaction_examples():
    assert engine.redacted("https://user:pw@host/p?q#f") == "https://host/p"
    assert engine.redacted("http://a@b@c/d") == "http://b@c/d"
    assert engine.redacted("no-scheme?x") == "no-scheme?x"


def test_descriptor_expression_agrees(spark):
    f = engine.Feed("https://h/päth", "lab")
    r = spark.range(1).select(scalars.feed_descriptor(F.lit("lab"), F.lit("https://h/päth"), F.lit(True)).alias("d")).first()
    assert r["d"] == engine.descriptor(f).hex()
    bad = [b"", b"FDS1", engine.descriptor(f)[:-1], b"XDS1" + engine.descriptor(f)[4:]]
    rows = spark.createDataFrame([(bytearray(b),) for b in [*bad, engine.descriptor(f)]], "p binary").select(scalars.decode_feed_descriptor(F.col("p")).alias("d")).collect()
    assert [r["d"] is None for r in rows] == [True] * 4 + [False] and rows[-1]["d"]["uri"] == "https://h/päth"


def test_stream_id_expression_agrees(spark):
    import uuid

    for text in ("telemetry/device-42", "", "é\n"):
        got = spark.range(1).select(scalars.derive_stream_id(F.lit(text)).alias("s")).first()["s"]
        assert got == str(uuid.UUID(bytes=engine.stream_id(text))) and len(got) == 36


def test_chunks_of_empty_and_exact_feeds(spark):
    df = spark.createDataFrame([("e", bytearray()), ("x", bytearray(b"a" * 8)), ("y", bytearray(b"a" * 9)), ("n", None)], "feed string, payload binary")
    rows = capture.chunks(df, 4).orderBy("feed", "chunk").collect()
    assert [(r["feed"], r["start"], r["size"]) for r in rows] == [("x", 0, 4), ("x", 4, 4), ("y", 0, 4), ("y", 4, 4), ("y", 8, 1)]


def test_configuration_limits():
    capture.check_config()
    for bad in ({"chunk_bytes": 4095}, {"chunk_bytes": (16 << 20) + 1}, {"feed_bytes": 0}, {"redirects": 21}):
        with pytest.raises(EngineError):
            capture.check_config(**bad)


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").write_bytes(b"internet audio source bytes\n")
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    assert cli.main(["record", "--archive", a, "--feed", f"news={tmp_path / 'in'}"]) == 0
    assert cli.main(["verify", a]) == 0
    assert cli.main(["list", "feeds", a]) == 0
    assert cli.main(["extract", a, "--feed", "news", "--output", str(tmp_path / "o")]) == 0
    assert (tmp_path / "o").read_bytes() == b"internet audio source bytes\n"
    os.truncate(a, os.path.getsize(a) - 20)
    assert cli.main(["verify", a]) == 3
    assert cli.main(["repair", a, "--output", b]) == 0
    assert cli.main(["verify", b]) == 0
    assert cli.main(["record", "--archive", b, "--feed", "bad"]) == 2
    assert cli.main(["capabilities"]) == 0
    assert '"neural_separation":false' in capsys.readouterr().out
