"""Streams over archives: following the tails of those that still grow, and chaining records as they arrive."""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from .. import model
from ..errors import require
from ..sources.archive import SCHEMA, SPLIT_BYTES, _Range, encode_envelope, encode_header, encode_trailer, hop, open_archive, read_range


START = {"offset": model.HEADER_SIZE, "position": 0, "hash": "0" * 64}


def _verified(path: str, start: dict) -> dict:
    """Where the verified records after `start` end; payloads are hashed as they stream, one in memory at a time."""
    at = start
    for part in hop(path, offset=start["offset"], position=start["position"]):
        for row in read_range(part):
            if row[15] or row[14] != row[12] or row[11] != at["hash"] or row[2] != at["position"]:
                return at
            at = {"offset": row[10] + model.OVERHEAD + row[9], "position": row[1] + 1, "hash": row[14]}
    return at


class _Tail(DataSourceStreamReader):
    """Offsets are the verified length of each archive: an incomplete record at its end is left for the next batch, other damage ends its stream there.

    A batch goes to the end that is verified when it starts, in ranges of about `most` bytes, one task each.
    """

    def __init__(self, paths: list[str], most: int):
        self.paths, self.most = paths, most
        self.seen = dict.fromkeys(paths, START)

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.paths, START)

    def latestOffset(self) -> dict:
        self.seen = {p: _verified(p, at) for p, at in self.seen.items()}
        return self.seen

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        parts = []
        for path, to in end.items():
            at = start.get(path, START)
            for part in hop(path, self.most, at["offset"], at["position"]):
                if part.offset >= to["offset"]:
                    break
                parts.append(replace(part, end=min(part.end, to["offset"])))
        return parts

    def read(self, partition: _Range) -> Iterator[tuple]:
        return read_range(partition)


class TailSource(DataSource):
    """spark.readStream.format("recordlogtail").option("path", ...): verified records of archives as they are committed. Paths are separated by newlines."""

    @classmethod
    def name(cls) -> str:
        return "recordlogtail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> _Tail:
        return _Tail([open_archive(p) for p in self.options["path"].split("\n")], int(self.options.get("maxbytes", SPLIT_BYTES)))


def follow(spark: SparkSession, paths: str | Iterable[str], most: int = SPLIT_BYTES) -> DataFrame:
    """A stream of the verified records of one archive or of several. most: bytes of records that one task of a batch reads."""
    spark.dataSource.register(TailSource)
    paths = [paths] if isinstance(paths, str) else paths
    return spark.readStream.format("recordlogtail").option("path", "\n".join(map(os.path.abspath, paths))).option("maxbytes", str(most)).load()


class _Chain(StatefulProcessor):
    """State of each archive: next sequence and last hash."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("chain", "n long, hash string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, last = self.state.get() if self.state.exists() else (0, "0" * 64)
        got = pd.concat(list(rows)).sort_values("event_order", kind="stable")
        out = []
        for order, digest in zip(got["event_order"], got["digest"], strict=True):
            own = hashlib.sha256(bytes.fromhex(last) + bytes.fromhex(digest)).hexdigest()
            out.append((key[0], int(n), int(order), last, own))
            n, last = n + 1, own
        self.state.update((int(n), last))
        yield pd.DataFrame(out, columns=["archive_id", "sequence", "event_order", "prev_hash", "hash"])

    def close(self) -> None:
        pass


CHAINED = "archive_id string, sequence long, event_order long, prev_hash string, hash string"


def chain(records: DataFrame) -> DataFrame:
    """records: a stream of (archive_id, event_order, digest). Appends each record to its archive's chain; needs the RocksDB state store."""
    return records.groupBy("archive_id").transformWithStateInPandas(statefulProcessor=_Chain(), outputStructType=CHAINED, outputMode="Append", timeMode="None")


# Sink


class Appender:
    """An archive that one batch of a stream is appended to, each record with a commit of its own.

    A file beside the archive names the batch and where it began. A batch that runs again (after a loss, or twice at once: the
    archive is locked) walks over the records it finds there, which must be its own, cuts off an incomplete last one and goes
    on. The folder's file system must honour locks and renames.
    """

    def __init__(self, path: str, batch: int):
        self.fd = os.open(path, os.O_RDWR | os.O_CREAT | os.O_NOFOLLOW, 0o644)
        fcntl.flock(self.fd, fcntl.LOCK_EX)
        self.path, note = path, f"{path}.batch"
        size = os.fstat(self.fd).st_size
        if os.path.exists(note):
            with open(note) as f:
                known = json.load(f)
        else:
            header = encode_header(0, hashlib.sha256(path.encode()).digest()[:16])
            require(size <= len(header) and header.startswith(os.pread(self.fd, len(header), 0)), "archive_io", f"refusing to append to {path}, which no stream began")
            known = {"batch": -1, "at": START}
            os.pwrite(self.fd, header, 0)
            os.fsync(self.fd)
        self.late = known["batch"] > batch
        self.at = dict(known["at"])
        if known["batch"] < batch:
            self.at = _verified(path, self.at)
            require(self.at["offset"] == os.fstat(self.fd).st_size, "archive_corrupt", f"{path} is damaged after its last whole batch")
            with open(f"{note}.{uuid.uuid4().hex}", "w") as f:
                json.dump({"batch": batch, "at": self.at}, f)
                f.flush()
                os.fsync(f.fileno())
            os.rename(f.name, note)
        self.end = os.fstat(self.fd).st_size

    def append(self, record_type: int, stream: bytes, start_ns: int, end_ns: int, payload: bytes) -> None:
        require(end_ns >= start_ns, "invalid_argument", "record ends before it starts")
        envelope = encode_envelope(record_type, 0, len(payload), self.at["position"], stream, start_ns, end_ns, bytes.fromhex(self.at["hash"]))
        digest = hashlib.sha256(envelope + payload).digest()
        data, offset = envelope + payload + encode_trailer(digest), self.at["offset"]
        if offset < self.end:
            there = os.pread(self.fd, len(data), offset)
            require(data.startswith(there), "archive_corrupt", f"{self.path} holds other records of this batch")
            if len(there) < len(data):
                os.ftruncate(self.fd, offset)
                self.end = offset
        if offset >= self.end:
            view = memoryview(data)
            while view:
                written = os.pwrite(self.fd, view, offset + len(data) - len(view))
                view = view[written:]
            os.fsync(self.fd)
        self.at = {"offset": offset + len(data), "position": self.at["position"] + 1, "hash": digest.hex()}

    def close(self) -> None:
        os.close(self.fd)


APPENDED = "archive_id string, records long, file_bytes long"


def append_batch(rows: DataFrame, directory: str, batch: int, suffix: str = ".arc") -> DataFrame:
    """Appends a batch to its archives, in each by event_order (ties by type, stream, times and payload); see append."""
    rows = rows.select("archive_id", "event_order", "record_type", "stream_id", "start_ns", "end_ns", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, current, done, out = None, None, 0, []

        def close() -> None:
            nonlocal to
            if to:
                out.append((current, done, to.at["offset"]))
                to.close()
                to = None

        try:
            for part in batches:
                for a, _, kind, stream, start, end, payload in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if to is None or a != current:
                        close()
                        require(bool(a) and "/" not in a, "invalid_argument", f"archive id is no file name: {a}")
                        to, current, done = Appender(f"{directory}/{a}{suffix}", batch), a, 0
                    if not to.late:
                        to.append(kind, uuid.UUID(stream).bytes, start, end, payload or b"")
                        done += 1
        finally:
            close()
        cols = list(zip(*out, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["archive_id", "records", "file_bytes"])

    return rows.repartition("archive_id").sortWithinPartitions(*rows.columns).mapInArrow(run, APPENDED)


def append(records: DataFrame, directory: str, checkpoint: str, suffix: str = ".arc") -> DataStreamWriter:
    """A stream of (archive_id, event_order, record_type, stream_id, start_ns, end_ns, payload) appended to one archive for each archive_id.

    Every record is synced before the next, each is there once however often a batch runs, and archives stay open: follow()
    reads them as they grow. Records that come in a later batch follow those of earlier ones whatever their event_order.
    directory: a folder that all executors share. Call start() on the result.
    """

    def write(rows: DataFrame, batch: int) -> None:
        append_batch(rows, directory, batch, suffix).agg({"records": "sum"}).collect()

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
