"""The archive byte format: encoding, a verified scan that splits large archives, and an ordered sink.

A scan hops over envelopes, one task for each archive (each envelope's magic, size and CRC are checked before its length is
trusted), and deals ranges of whole records to tasks, which hash payloads and judge records in one pass; see
operators.integrity for what follows from the failures.
"""

from __future__ import annotations

import hashlib
import os
import struct
import time
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import model
from ..errors import EngineError, require
from ..operators import integrity

#: Bytes of records that one task of a scan reads.
SPLIT_BYTES = 64 << 20


def _table() -> list[int]:
    out = []
    for byte in range(256):
        c = byte
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
        out.append(c)
    return out


_CRC = _table()


def crc32c(data: bytes, crc: int = 0) -> int:
    c = crc ^ 0xFFFFFFFF
    for byte in data:
        c = _CRC[(c ^ byte) & 0xFF] ^ c >> 8
    return c ^ 0xFFFFFFFF


def encode_header(created_ns: int, archive_uuid: bytes) -> bytes:
    head = model.HEADER_MAGIC + struct.pack("<IIII", model.FORMAT_VERSION, model.HEADER_SIZE, 0, model.PROFILE_VERSION) + archive_uuid + struct.pack("<q", created_ns) + bytes(12)
    return head + struct.pack("<I", crc32c(head))


def header_problem(head: bytes) -> str | None:
    if len(head) < model.HEADER_SIZE:
        return "truncated archive header"
    if head[:8] != model.HEADER_MAGIC:
        return "invalid archive header magic"
    version, size, _, profile = struct.unpack_from("<IIII", head, 8)
    if version != model.FORMAT_VERSION or size != model.HEADER_SIZE:
        return "unsupported archive format version or header size"
    if profile != model.PROFILE_VERSION or crc32c(head[:60]) != struct.unpack_from("<I", head, 60)[0]:
        return "archive profile header mismatch"
    return None


def encode_envelope(record_type: int, flags: int, size: int, sequence: int, stream: bytes, start_ns: int, end_ns: int, previous: bytes) -> bytes:
    body = model.ENVELOPE_MAGIC + struct.pack("<HHIQQ", record_type, flags, model.ENVELOPE_SIZE, size, sequence) + stream + struct.pack("<qq", start_ns, end_ns) + previous
    return body + struct.pack("<I", crc32c(body))


def encode_trailer(digest: bytes) -> bytes:
    body = model.TRAILER_MAGIC + digest
    return body + struct.pack("<I", crc32c(body))


def stream_text(raw: bytes) -> str:
    return str(uuid.UUID(bytes=raw))


@dataclass
class Written:
    sequence: int
    offset: int
    record_type: int
    stream: str
    size: int


class ArchiveWriter:
    """Appends records to a new file; refuses to replace one. The hash chain and the sequence live here."""

    def __init__(self, path: str, created_ns: int | None = None, archive_uuid: bytes | None = None):
        self.path, self.records, self.previous, self.closed = path, [], bytes(32), False
        try:
            self.fd = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL | os.O_NOFOLLOW, 0o644)
        except OSError as e:
            raise EngineError("archive_io", f"cannot create archive: {e.strerror}") from e
        try:
            self._write(encode_header(time.time_ns() if created_ns is None else created_ns, archive_uuid or uuid.uuid4().bytes))
        except OSError as e:
            os.close(self.fd)
            os.unlink(path)
            raise EngineError("archive_io", "cannot write archive header") from e
        self.offset = model.HEADER_SIZE

    def _write(self, data: bytes) -> None:
        view = memoryview(data)
        while view:
            view = view[os.write(self.fd, view) :]
        os.fsync(self.fd)

    def append(self, record_type: int, stream: bytes, start_ns: int, end_ns: int, payload: bytes, flags: int = 0) -> Written:
        require(not self.closed, "invalid_argument", "archive is finalized")
        require(end_ns >= start_ns, "invalid_argument", "record ends before it starts")
        envelope = encode_envelope(record_type, flags, len(payload), len(self.records), stream, start_ns, end_ns, self.previous)
        digest = hashlib.sha256(envelope + payload).digest()
        self._write(envelope + payload + encode_trailer(digest))
        done = Written(len(self.records), self.offset, record_type, stream_text(stream), len(payload))
        self.records.append(done)
        self.offset += model.OVERHEAD + len(payload)
        self.previous = digest
        return done

    def index_payload(self) -> bytes:
        rows = ",".join(f'{{"sequence":{r.sequence},"offset":{r.offset},"type":{r.record_type},"stream":"{r.stream}","bytes":{r.size}}}' for r in self.records)
        return f'{{"format":"{model.INDEX_FORMAT}","records":[{rows}]}}'.encode()

    def finalize(self) -> None:
        if not self.closed:
            self.append(model.FINAL_INDEX, bytes(16), 0, 0, self.index_payload())
            self.close()

    def close(self) -> None:
        if not self.closed:
            os.close(self.fd)
            self.closed = True


# Scan

_NAMES = ["archive_id", "position", "sequence", "record_type", "record_type_name", "flags", "stream_id", "start_ns", "end_ns", "payload_size", "file_offset", "prev_hash", "hash", "payload", "computed_hash", "failure"]
SCHEMA = model.RECORDS + ", computed_hash string, failure string"


@dataclass
class _Range(InputPartition):
    path: str
    first: int
    offset: int
    end: int


def _envelope_problem(head: bytes) -> str | None:
    if len(head) < model.ENVELOPE_SIZE:
        return "envelope"
    if head[:4] != model.ENVELOPE_MAGIC:
        return "magic"
    if struct.unpack_from("<I", head, 8)[0] != model.ENVELOPE_SIZE or crc32c(head[:92]) != struct.unpack_from("<I", head, 92)[0]:
        return "crc"
    return None


def hop(path: str, split: int = SPLIT_BYTES, offset: int = model.HEADER_SIZE, position: int = 0) -> Iterator[_Range]:
    """Ranges of records, envelope by envelope; a range also ends after the first record whose envelope cannot be trusted."""
    size = os.stat(path).st_size
    with open(path, "rb") as f:
        start, first = offset, position
        while offset < size:
            f.seek(offset)
            head = f.read(model.ENVELOPE_SIZE)
            length = struct.unpack_from("<Q", head, 12)[0] if _envelope_problem(head) is None else None
            if length is None or length > size - offset - model.OVERHEAD:
                yield _Range(path, first, start, size)
                return
            offset += model.OVERHEAD + length
            position += 1
            if offset - start >= split:
                yield _Range(path, first, start, offset)
                start, first = offset, position
        if start < offset:
            yield _Range(path, first, start, offset)


def read_range(r: _Range) -> Iterator[tuple]:
    """Rows of SCHEMA; after a record that the bytes themselves rule out there is nothing more."""
    with open(r.path, "rb") as f:
        offset, position = r.offset, r.first
        f.seek(offset)
        while offset < r.end:
            head = f.read(model.ENVELOPE_SIZE)
            problem = _envelope_problem(head)
            if problem:
                yield (r.path, position, *[None] * 8, offset, None, None, None, None, problem)
                return
            kind, flags, _, size, sequence = struct.unpack_from("<HHIQQ", head, 4)
            start_ns, end_ns = struct.unpack_from("<qq", head, 44)
            signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
            known = [signed(sequence), kind, model.RECORD_TYPES.get(kind, "unknown"), flags, stream_text(head[28:44]), start_ns, end_ns]
            if size > r.end - offset - model.OVERHEAD:
                yield (r.path, position, *known, None, offset, None, None, None, None, "payload")
                return
            payload, trailer = f.read(size), f.read(model.TRAILER_SIZE)
            digest = hashlib.sha256(head + payload).hexdigest()
            whole = trailer[:4] == model.TRAILER_MAGIC and crc32c(trailer[:36]) == struct.unpack_from("<I", trailer, 36)[0]
            yield (r.path, position, *known, size, offset, head[60:92].hex(), trailer[4:36].hex(), payload, digest, None if whole else "trailer")
            if not whole:
                return
            offset += model.OVERHEAD + size
            position += 1


def judged(r: _Range, payloads: bool = True) -> Iterator[tuple]:
    """Rows of SCHEMA with `failure` for the first rule a record breaks, in the fixed order: bytes, hash, chain, sequence.

    The chain is held against the stored hash of the record before, which a range finds in the trailer that ends where it
    starts: if that is not the computed one, the record before fails itself. So no range needs another one's rows.
    """
    before = integrity.ZERO_HASH
    if r.offset > model.HEADER_SIZE:
        with open(r.path, "rb") as f:
            f.seek(r.offset - model.TRAILER_SIZE + len(model.TRAILER_MAGIC))
            before = f.read(32).hex()
    for row in read_range(r):
        failure = row[15]
        if failure is None:
            failure = "sha" if row[14] != row[12] else "chain" if row[11] != before else "sequence" if row[2] != row[1] else None
        yield (*row[:13], row[13] if payloads else None, row[14], failure)
        before = row[12]


_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.string()]


def _batches(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Batches of about 8 MiB."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 300 + len(row[13] or b"")
        if size > 8 << 20:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


class _Reader(DataSourceReader):
    """One task for each archive; the driver looks at sizes only."""

    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [_Range(p, 0, model.HEADER_SIZE, os.stat(p).st_size) for p in self.paths]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        return _batches(judged(partition))


class ArchiveSource(DataSource):
    """spark.read.format("recordlog").option("path", ...): every record with its computed hash and `failure`. Paths are separated by newlines; scan() also splits archives."""

    @classmethod
    def name(cls) -> str:
        return "recordlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        paths = self.options["path"].split("\n")
        for p in paths:
            open_archive(p)
        return _Reader(paths)


def open_archive(path: str) -> str:
    """The path, once its header is valid."""
    try:
        with open(path, "rb") as f:
            head = f.read(model.HEADER_SIZE)
    except OSError as e:
        raise EngineError("archive_io", f"cannot open archive: {e.strerror}") from e
    problem = header_problem(head)
    require(problem is None, "archive_corrupt", problem or "")
    return path


def scan(spark: SparkSession, paths: Iterable[str], split: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """Every record of the archives, with `failure` for the first rule it breaks. payloads: False hashes them without handing them on.

    One stage finds the ranges, a task for each archive; the next reads them. Only ranges are shuffled, never records.
    """
    paths = [open_archive(p) for p in paths]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                for r in hop(path, split):
                    yield pa.RecordBatch.from_pylist([vars(r)], pa.schema({"path": pa.string(), "first": pa.int64(), "offset": pa.int64(), "end": pa.int64()}))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield from _batches(judged(_Range(**r), payloads))

    cores = spark.sparkContext.defaultParallelism
    known = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 8 * cores)))
    parts = sum(os.stat(p).st_size // split + 1 for p in paths)
    ranges = known.mapInArrow(find, "path string, first long, offset long, end long").repartition(max(1, min(parts, 32 * cores)))
    return ranges.mapInArrow(read, SCHEMA)


def archive_table(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(p, os.stat(p).st_size) for p in paths], "archive_id string, file_bytes long")


def verify(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A report for each path, in the same form for paths without a valid header."""
    good, bad = [], []
    for p in paths:
        try:
            good.append(open_archive(p))
        except EngineError as e:
            bad.append((p, False, False, 0, 0, 0, os.stat(p).st_size if os.path.exists(p) else 0, e.code, e.message))
    out = spark.createDataFrame(bad, model.REPORT)
    return integrity.report(scan(spark, good, payloads=False), archive_table(spark, good)).unionByName(out) if good else out


def records(spark: SparkSession, paths: list[str], policy: str = "complete_archive") -> DataFrame:
    """Verified records: all of them or an error (complete_archive), or those before the first failure (verified_prefix)."""
    require(policy in ("complete_archive", "verified_prefix"), "invalid_argument", f"unknown read policy: {policy}")
    checks = scan(spark, paths)
    return (integrity.strict(checks) if policy == "complete_archive" else integrity.prefix(checks)).drop("computed_hash")


def read_payload(path: str, file_offset: int, sequence: int, record_type: int, stream_id: str, expected_hash: str) -> bytes:
    """One record's payload, checked anew against what was known of it; not the chain."""
    with open(path, "rb") as f:
        size = os.fstat(f.fileno()).st_size
    rows = read_range(_Range(path, sequence, file_offset, size))
    row = next(rows, None)
    same = row is not None and row[15] is None and row[2] == sequence and row[3] == record_type and row[6] == stream_id and row[14] == row[12] == expected_hash
    require(same, "archive_corrupt", "record changed since it was verified")
    return row[13]


# Sink

WRITTEN = "archive_id string, path string, records long, payload_bytes long, file_bytes long"


def write_archives(rows: DataFrame, directory: str, created_ns: int = 0, finalize: bool = True, suffix: str = ".arc") -> DataFrame:
    """One file for each archive_id, its records in order of sequence. directory: a folder that all executors share.

    rows: archive_id, sequence, record_type, stream_id, start_ns, end_ns, payload. A file appears under its name only when it
    is whole, and never replaces one; a task that runs again after a loss finds its own file and leaves it.
    """
    rows = rows.select("archive_id", "sequence", "record_type", "stream_id", "start_ns", "end_ns", "payload")

    def publish(writer: ArchiveWriter, final: str) -> None:
        if finalize:
            writer.finalize()
        writer.close()
        try:
            os.link(writer.path, final, follow_symlinks=False)
        except FileExistsError:
            with open(writer.path, "rb") as a, open(final, "rb") as b:
                same = hashlib.file_digest(a, "sha256").digest() == hashlib.file_digest(b, "sha256").digest()
            require(same, "archive_io", f"refusing to replace {final}")
        finally:
            os.unlink(writer.path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, current, total, out = None, None, 0, []

        def done() -> tuple:
            final = f"{directory}/{current}{suffix}"
            n = len(writer.records)
            publish(writer, final)
            return current, final, n, total, os.stat(final).st_size

        for batch in batches:
            for a, _, kind, stream, start, end, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if a != current or writer is None:
                    if writer:
                        out.append(done())
                    current, total = a, 0
                    seed = hashlib.sha256(f"{directory}\n{a}".encode()).digest()[:16]
                    writer = ArchiveWriter(f"{directory}/.{a}.{uuid.uuid4().hex}", created_ns, seed)
                writer.append(kind, uuid.UUID(stream).bytes, start, end, payload or b"")
                total += len(payload or b"")
        if writer:
            out.append(done())
        cols = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()], strict=True)], ["archive_id", "path", "records", "payload_bytes", "file_bytes"])

    return rows.repartition("archive_id").sortWithinPartitions("archive_id", "sequence").mapInArrow(run, WRITTEN)


def repair(spark: SparkSession, source: str, destination: str, created_ns: int | None = None) -> dict[str, int]:
    """The verified prefix of `source`, without index records, as a new archive. The source is not touched."""
    require(source != destination, "invalid_argument", "an archive cannot be repaired into itself")
    open_archive(source)
    size = os.stat(source).st_size
    checks = scan(spark, [source])
    plan = integrity.repair_plan(checks)
    report = integrity.report(scan(spark, [source], payloads=False), archive_table(spark, [source])).first()
    writer = ArchiveWriter(destination, created_ns)
    done = 0
    # An archive is one file, so its records pass through the driver in order, one partition at a time.
    for row in plan.orderBy("sequence").toLocalIterator():
        writer.append(row["record_type"], uuid.UUID(row["stream_id"]).bytes, row["start_ns"], row["end_ns"], bytes(row["payload"]))
        done += row["payload_size"]
    n = len(writer.records)
    writer.finalize()
    return {"recovered_records": n, "recovered_payload_bytes": done, "discarded_tail_bytes": size - report["valid_prefix_bytes"]}


#: Bytes that a long value is cut into for its CRC.
SEGMENT = 512


def _crc_step(c: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return _STEP[(c ^ byte) & 0xFF] ^ (c >> np.uint32(8))


_STEP = np.array(_CRC, np.uint32)


def _past_segment() -> np.ndarray:
    """For each of a state's four bytes, what a segment of zeros makes of it; states add by xor."""
    c = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    for _ in range(SEGMENT):
        c = _crc_step(c, 0)
    return c


def crc32c_many(values: list[bytes]) -> np.ndarray:
    """The CRC-32C of each value, walked over all values at once.

    The state after a segment is that of the segment alone xor the state before it moved past as many zeros, so all segments
    are walked at once and then joined: steps grow with the segment's length and the longest value's number of segments.
    """
    size = np.array([len(v) for v in values], np.int64)
    base = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(values), np.uint8)
    head, full = size % SEGMENT, size // SEGMENT
    order = np.argsort(-head, kind="stable")
    ends = np.sort(head)
    c = np.full(len(size), 0xFFFFFFFF, np.uint32)
    for k in range(int(head.max(initial=0))):
        live = order[: len(size) - int(np.searchsorted(ends, k, "right"))]
        c[live] = _crc_step(c[live], flat[base[live] + k])
    first = np.cumsum(full) - full
    starts = np.repeat(base + head, full) + (np.arange(int(full.sum())) - np.repeat(first, full)) * SEGMENT
    own = np.zeros(len(starts), np.uint32)
    for k in range(SEGMENT if len(starts) else 0):
        own = _crc_step(own, flat[starts + k])
    past = _past_segment() if len(starts) else None
    for k in range(int(full.max(initial=0))):
        live = np.flatnonzero(full > k)
        s = c[live]
        c[live] = past[0][s & 0xFF] ^ past[1][s >> 8 & 0xFF] ^ past[2][s >> 16 & 0xFF] ^ past[3][s >> 24] ^ own[first[live] + k]
    return c ^ np.uint32(0xFFFFFFFF)


def crc32c_column(df: DataFrame, column: str, name: str = "crc32c") -> DataFrame:
    """Adds the CRC-32C of a binary column."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(column).cast(pa.binary()).to_pylist()
            out = crc32c_many([v or b"" for v in values])
            found = pa.array([None if v is None else int(x) for v, x in zip(values, out, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*names, name])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names) + f", {name} long"
    return df.mapInArrow(run, schema)
