"""Entry points: record, verify, list, extract, repair, and the watermark commands."""

from __future__ import annotations

import hashlib
import re
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import model
from .errors import require
from .operators import capture, identity, integrity, watermark
from .sources import archive
from .sources.feeds import Prepared


@dataclass(frozen=True)
class Feed:
    uri: str
    label: str
    preserve_source: bool = True
    maximum_bytes: int = capture.FEED_BYTES


def stream_id(value: str) -> bytes:
    raw = bytearray(hashlib.sha256(value.encode()).digest()[:16])
    raw[6] = raw[6] & 0x0F | 0x50
    raw[8] = raw[8] & 0x3F | 0x80
    return bytes(raw)


def redacted(uri: str) -> str:
    before, mark, rest = uri.partition("://")
    if not mark:
        return uri
    rest = re.sub(r"\A[^/?#@]*@", "", rest)
    return re.split(r"[?#]", before + mark + rest, maxsplit=1)[0]


def descriptor(feed: Feed) -> bytes:
    label, uri = feed.label.encode(), redacted(feed.uri).encode()
    sizes = (1).to_bytes(2, "little") + len(label).to_bytes(2, "little") + len(uri).to_bytes(4, "little") + int(feed.preserve_source).to_bytes(4, "little")
    return model.DESCRIPTOR_MAGIC + sizes + label + uri


def record(feeds: list[Feed], path: str, chunk_bytes: int = capture.CHUNK_BYTES, feed_bytes: int = capture.FEED_BYTES, deny_private: bool = True, clock=time.time_ns) -> dict[str, object]:
    """Feeds one after the other into a new archive, each up to the lesser of its own limit and feed_bytes. Sources are opened first; after a failure the archive stays without an index."""
    capture.check_config(chunk_bytes, feed_bytes)
    require(bool(feeds), "invalid_argument", "there is no feed to record")
    seen: set[str] = set()
    for f in feeds:
        good = re.fullmatch(r"[\x21-\x3c\x3e-\x7e]{1,128}", f.label)
        require(bool(good) and bool(f.uri) and f.preserve_source and f.maximum_bytes > 0, "invalid_argument", "a feed needs a label, a source that is preserved, and a limit")
        require(f.label not in seen, "invalid_argument", "two feeds have one label")
        seen.add(f.label)
    sources = [Prepared(f.uri, min(f.maximum_bytes, feed_bytes), deny_private) for f in feeds]
    writer = archive.ArchiveWriter(path, clock())
    done = {"archive": path, "feeds_recorded": 0, "source_bytes": 0, "source_records": 0}
    try:
        for f, source in zip(feeds, sources, strict=True):
            stream = stream_id(f"{f.label}\n{f.uri}")
            now = clock()
            writer.append(model.FEED_DESCRIPTOR, stream, now, now, descriptor(f))
            for data in source.chunks(chunk_bytes):
                now = clock()
                writer.append(model.SOURCE_BYTES, stream, now, now, data)
                done["source_bytes"] += len(data)
                done["source_records"] += 1
            done["feeds_recorded"] += 1
        writer.finalize()
    finally:
        writer.close()
    return done


def verify(spark: SparkSession, paths: list[str]) -> DataFrame:
    return archive.verify(spark, paths)


def inspect(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Reports, and for whole archives their number of feeds."""
    reports = archive.verify(spark, paths)
    good = [r["archive_id"] for r in reports.filter("ok").select("archive_id").collect()]
    if not good:
        return reports.withColumn("feeds", F.lit(None).cast("long"))
    counts = integrity.feeds(archive.records(spark, good)).groupBy("archive_id").agg(F.count("*").alias("_n"))
    return reports.join(counts, "archive_id", "left").withColumn("feeds", F.when(F.col("ok"), F.coalesce("_n", F.lit(0)))).drop("_n")


def list_feeds(spark: SparkSession, path: str, policy: str = "complete_archive") -> DataFrame:
    return integrity.feeds(archive.records(spark, [path], policy)).orderBy("sequence").select("label", "stream_id", "uri", "fidelity")


def extract_feed(spark: SparkSession, path: str, label: str, output: str | None = None, fidelity: str = "source-exact", policy: str = "complete_archive") -> bytes:
    """All source bytes of a feed; also written to a new file if `output` is given."""
    require(fidelity == "source-exact", "invalid_argument", f"unsupported fidelity: {fidelity}")
    chunks = integrity.extract_feed(archive.records(spark, [path], policy), label).orderBy("chunk")
    data = b"".join(bytes(r["payload"]) for r in chunks.toLocalIterator())
    if output:
        identity.create_file(output, data)
    return data


def extract_stream(spark: SparkSession, path: str, stream: str, record_type: int = model.SOURCE_BYTES, policy: str = "complete_archive") -> bytes:
    """All bytes of a stream's records of one type; an unknown stream has none."""
    rows = archive.records(spark, [path], policy).filter(F.col("stream_id") == str(uuid.UUID(stream)))
    return b"".join(bytes(r["payload"]) for r in integrity.extract_stream(rows, record_type).orderBy("chunk").toLocalIterator())


def repair(spark: SparkSession, source: str, destination: str) -> dict[str, int]:
    return archive.repair(spark, source, destination)


def watermark_issue(wav: bytes, statement: identity.Statement, private_path: str, band: str = "W1", policy: watermark.Policy = watermark.Policy()) -> tuple[bytes, bytes, int]:
    """Marked WAV, signed statement, frames embedded."""
    marked, frames = watermark.embed(watermark.read_wav(wav), statement.acoustic_code, band, policy)
    return watermark.write_wav(marked), identity.issue(statement, private_path), frames


def watermark_detect(spark: SparkSession, clips: DataFrame, statements: DataFrame | None = None, public: bytes | None = None, at: int | None = None, policy: watermark.Policy = watermark.Policy()) -> DataFrame:
    """Evidence rows of clips (audio_id, wav); statements: (audio_id, cose)."""
    require((statements is None) == (public is None), "invalid_argument", "a statement and a public key must be given together")
    found = watermark.detect_all(clips, policy).filter("error_code = 'ok'")
    if statements is None:
        states = spark.createDataFrame([], "audio_id string, statement_state string, feed_uuid string, acoustic_code int, issuer string")
    else:
        checked = identity.verify_all(statements.select(F.col("audio_id").alias("statement_id"), "cose"), public, int(time.time()) if at is None else at)
        states = checked.select(F.col("statement_id").alias("audio_id"), "statement_state", "feed_uuid", "acoustic_code", "issuer")
    return watermark.fuse(found, states)
