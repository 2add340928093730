"""Integrity of record tables: layout, hash chains, verification, verified prefixes, repair plans, extraction.

Records are rows (archive_id, position, ...), position counting from 0 in file order. Each operator shuffles on
(archive_id, position) or aggregates with partial sums, so an archive that holds a third of all records is no single task;
only the building of a chain is sequential in an archive, and it streams.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..errors import EngineError
from ..functions import scalars

#: Records whose running sum one task computes.
BLOCK = 1 << 14


def running_sum(df: DataFrame, key: str, order: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """The sum of `value` over earlier rows of the key, by blocks of `order` (dense from 0): block sums first, then sums inside blocks."""
    df = df.withColumn("_v", value).withColumn("_b", F.expr(f"{order} div {block}"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = df.groupBy(key, "_b").agg(F.sum("_v").alias("_s")).withColumn("_base", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    inside = Window.partitionBy(key, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(blocks, [key, "_b"]).withColumn(name, F.col("_base") + F.coalesce(F.sum("_v").over(inside), F.lit(0))).drop("_v", "_b", "_base")


def positions(df: DataFrame, key: str, order: str, name: str = "position", block: int = BLOCK) -> DataFrame:
    """Dense numbers from 0 in each key, by the integer `order`, which need not be dense: counts of blocks first, then numbers inside blocks.

    A key's blocks are as many equal ranges of its orders as it has rows for, so sparse orders (times, say) make no more blocks than dense ones.
    """
    spread = df.groupBy(key).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"), F.ceil(F.count("*") / block).alias("_parts"))
    df = df.join(spread, key).withColumn("_b", F.expr(f"({order} - _lo) div ((_hi - _lo) div _parts + 1)")).drop("_lo", "_hi", "_parts")
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = df.groupBy(key, "_b").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(key, "_b").orderBy(order)) - 1
    return df.join(blocks, [key, "_b"]).withColumn(name, (F.col("_base") + inside).cast("long")).drop("_b", "_base")


def layout(records: DataFrame) -> DataFrame:
    """Adds file_offset: the header and everything before the record."""
    out = running_sum(records, "archive_id", "position", model.OVERHEAD + F.col("payload_size"), "file_offset")
    return out.withColumn("file_offset", F.col("file_offset") + model.HEADER_SIZE)


def fold_chain(records: DataFrame, digest: str = "digest") -> DataFrame:
    """Adds prev_hash and hash: hash = SHA-256(previous hash, record digest), the first one after zeros. One streamed pass over each archive."""
    names = records.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, last = None, b""
        for batch in batches:
            previous, own = [], []
            for a, d in zip(batch.column("archive_id").to_pylist(), batch.column(digest).to_pylist(), strict=True):
                if a != archive:
                    archive, last = a, bytes(32)
                previous.append(last.hex())
                last = hashlib.sha256(last + bytes.fromhex(d)).digest()
                own.append(last.hex())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(previous, pa.string()), pa.array(own, pa.string())], [*names, "prev_hash", "hash"])

    schema = ", ".join(f"`{c}` {records.schema[c].dataType.simpleString()}" for c in names) + ", prev_hash string, hash string"
    return records.repartition("archive_id").sortWithinPartitions("archive_id", "position").mapInArrow(run, schema)


def fold_records(records: DataFrame) -> DataFrame:
    """Adds prev_hash and hash as archives store them: SHA-256 of the envelope, which holds the previous hash and its own CRC, and the payload.

    records: archive_id, position (the sequence number), record_type, stream_id, start_ns, end_ns, payload; no flags. One streamed pass over each archive.
    """
    from ..sources.archive import encode_envelope

    names = records.columns
    used = ("archive_id", "position", "record_type", "stream_id", "start_ns", "end_ns", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, last = None, b""
        for batch in batches:
            previous, own = [], []
            for a, k, kind, stream, start, end, payload in zip(*(batch.column(c).to_pylist() for c in used), strict=True):
                if a != archive:
                    archive, last = a, bytes(32)
                previous.append(last.hex())
                payload = payload or b""
                last = hashlib.sha256(encode_envelope(kind, 0, len(payload), k, uuid.UUID(stream).bytes, start, end, last) + payload).digest()
                own.append(last.hex())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(previous, pa.string()), pa.array(own, pa.string())], [*names, "prev_hash", "hash"])

    schema = ", ".join(f"`{c}` {records.schema[c].dataType.simpleString()}" for c in names) + ", prev_hash string, hash string"
    return records.repartition("archive_id").sortWithinPartitions("archive_id", "position").mapInArrow(run, schema)


def with_previous(records: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the value that `column` has in the record before, by an equi-join on position; null for the first."""
    before = records.select("archive_id", (F.col("position") + 1).alias("position"), F.col(column).alias(name))
    return records.join(before, ["archive_id", "position"], "left")


ZERO_HASH = "0" * 64


def checked(records: DataFrame) -> DataFrame:
    """Adds `failure`, the first rule that a record breaks (null if none), in the fixed order: hash, chain, sequence.

    records: archive_id, position, sequence, prev_hash, hash (as stored) and computed_hash. A source may give a `failure` of
    its own for what it finds in the bytes; that comes first.
    """
    own = F.col("failure") if "failure" in records.columns else F.lit(None).cast("string")
    df = with_previous(records.withColumn("_own", own), "computed_hash", "_before")
    rule = (
        F.when(F.col("_own").isNotNull(), F.col("_own"))
        .when(F.col("hash") != F.col("computed_hash"), F.lit("sha"))
        .when(F.col("prev_hash") != F.coalesce("_before", F.lit(ZERO_HASH)), F.lit("chain"))
        .when(F.col("sequence") != F.col("position"), F.lit("sequence"))
    )
    return df.withColumn("failure", rule).drop("_own", "_before")


def first_failures(checks: DataFrame) -> DataFrame:
    """(archive_id, first_bad, failure) of archives with a failing record: the first in file order."""
    bad = checks.filter("failure is not null")
    return bad.groupBy("archive_id").agg(F.min("position").alias("first_bad"), F.min_by("failure", "position").alias("failure"))


def prefix(checks: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """The records before each archive's first failure."""
    failures = first_failures(checks) if failures is None else failures
    return checks.join(failures.select("archive_id", "first_bad"), "archive_id", "left").filter(F.col("first_bad").isNull() | (F.col("position") < F.col("first_bad"))).drop("first_bad", "failure")


def message_of(failure: Column, finalized: Column) -> Column:
    out = F.when(finalized, F.lit(model.MESSAGES["finalized"])).otherwise(F.lit(model.MESSAGES["streaming"]))
    for key, text in model.MESSAGES.items():
        if key not in ("finalized", "streaming"):
            out = F.when(failure == key, F.lit(text)).otherwise(out)
    return out


def verified_sums(checks: DataFrame, block: int = BLOCK) -> DataFrame:
    """What each archive's records before its first failure add up to, and that failure, in one pass over the records.

    Blocks of positions are summed up to their own first failures; then the blocks up to the first one with a failure.
    """
    own = Window.partitionBy("archive_id", "_b")
    df = checks.withColumn("_b", F.expr(f"position div {block}")).withColumn("_first", F.min(F.when(F.col("failure").isNotNull(), F.col("position"))).over(own))
    good = F.col("_first").isNull() | (F.col("position") < F.col("_first"))
    kept = good & (F.col("record_type") != model.FINAL_INDEX)
    size = F.col("payload_size")
    blocks = df.groupBy("archive_id", "_b").agg(
        F.count(F.when(good, 1)).alias("committed_records"),
        F.sum(F.when(good, size)).alias("verified_payload_bytes"),
        F.count(F.when(kept, 1)).alias("recovered_records"),
        F.sum(F.when(kept, size)).alias("recovered_payload_bytes"),
        F.max_by("record_type", F.when(good, F.col("position"))).alias("_last"),
        F.min_by("failure", F.when(F.col("failure").isNotNull(), F.col("position"))).alias("failure"),
    )
    bad = F.min(F.when(F.col("failure").isNotNull(), F.col("_b"))).over(Window.partitionBy("archive_id"))
    blocks = blocks.withColumn("_bad", bad).filter(F.col("_bad").isNull() | (F.col("_b") <= F.col("_bad")))
    sums = [F.sum(c).alias(c) for c in ("committed_records", "verified_payload_bytes", "recovered_records", "recovered_payload_bytes")]
    return blocks.groupBy("archive_id").agg(*sums, F.max_by("_last", F.when(F.col("_last").isNotNull(), F.col("_b"))).alias("_last"), F.max("failure").alias("failure"))


def report(checks: DataFrame, archives: DataFrame) -> DataFrame:
    """One row for each archive of `archives` (archive_id, file_bytes), as in model.REPORT. An archive of a header alone is whole."""
    df = archives.join(verified_sums(checks), "archive_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    end = zero("verified_payload_bytes") + model.OVERHEAD * zero("committed_records") + model.HEADER_SIZE
    finalized = F.coalesce(F.col("_last") == model.FINAL_INDEX, F.lit(False))
    ok = F.col("failure").isNull() & (end == F.col("file_bytes"))
    failure = F.coalesce("failure", F.when(end != F.col("file_bytes"), F.lit("envelope")))
    return df.select(
        "archive_id",
        ok.alias("ok"),
        finalized.alias("finalized"),
        zero("committed_records").alias("committed_records"),
        zero("verified_payload_bytes").alias("verified_payload_bytes"),
        end.alias("valid_prefix_bytes"),
        F.col("file_bytes").cast("long").alias("file_bytes"),
        F.when(ok, F.lit("ok")).otherwise(F.lit("archive_corrupt")).alias("error_code"),
        message_of(failure, finalized).alias("message"),
    )


def strict(checks: DataFrame) -> DataFrame:
    """All records, or an error if any record of any archive fails: the check is a stage of its own that no later filter skips."""
    bad = checks.filter("failure is not null").orderBy("archive_id", "position").select("archive_id", "failure").first()
    if bad:
        raise EngineError("archive_corrupt", model.MESSAGES[bad["failure"]])
    return checks.drop("failure")


def repair_plan(checks: DataFrame) -> DataFrame:
    """Records of the verified prefix without any index record, numbered anew from 0; flags are dropped."""
    kept = prefix(checks).filter(F.col("record_type") != model.FINAL_INDEX)
    return running_sum(kept, "archive_id", "position", F.lit(1).cast("long"), "sequence_new").withColumn("old_sequence", F.col("sequence")).withColumn("sequence", F.col("sequence_new")).drop("sequence_new")


def repair_totals(checks: DataFrame, archives: DataFrame) -> DataFrame:
    """recovered_records, recovered_payload_bytes (of the verified prefix, without index records) and discarded_tail_bytes of each of `archives` (archive_id, file_bytes)."""
    df = archives.join(verified_sums(checks), "archive_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    end = zero("verified_payload_bytes") + model.OVERHEAD * zero("committed_records") + model.HEADER_SIZE
    return df.select("archive_id", zero("recovered_records").alias("recovered_records"), zero("recovered_payload_bytes").alias("recovered_payload_bytes"), (F.col("file_bytes") - end).alias("discarded_tail_bytes"))


def feeds(records: DataFrame, strict_decoding: bool = True) -> DataFrame:
    """Decoded feed descriptors in sequence order; an undecodable one is an error."""
    own = records.filter(F.col("record_type") == model.FEED_DESCRIPTOR).withColumn("feed", scalars.decode_feed_descriptor(F.col("payload")))
    if strict_decoding and not own.filter("feed is null").isEmpty():
        raise EngineError("archive_corrupt", "a feed descriptor cannot be decoded")
    return own.select("archive_id", "sequence", "stream_id", "feed.label", "feed.uri", "feed.preserve_source", F.lit("S0").alias("fidelity"))


def extract_stream(records: DataFrame, record_type: int = model.SOURCE_BYTES) -> DataFrame:
    """The chunks of each stream in order: archive_id, stream_id, chunk, payload. An unknown stream has none.

    The bytes of a stream stay rows, so that no stream must fit into one row; sort by chunk to read them.
    """
    return records.filter(F.col("record_type") == record_type).select("archive_id", "stream_id", F.col("sequence").alias("chunk"), "payload")


def joined_bytes(chunks: DataFrame) -> DataFrame:
    """One row for each (archive_id, stream_id) with all bytes in order, for streams that fit into one row."""
    parts = F.array_sort(F.collect_list(F.struct("chunk", "payload")))
    # One join of all parts: adding them up one by one would copy what is there for each.
    whole = F.unhex(F.array_join(F.transform(parts, lambda x: F.hex(x["payload"])), ""))
    return chunks.groupBy("archive_id", "stream_id").agg(whole.alias("payload"))


def feed_stream(feed_rows: DataFrame, label: str) -> str:
    """The one stream that a label names."""
    found = [r["stream_id"] for r in feed_rows.filter(F.col("label") == label).select("stream_id").distinct().limit(2).collect()]
    if len(found) > 1:
        raise EngineError("archive_corrupt", "several streams have this label")
    if not found:
        raise EngineError("invalid_argument", f"no feed is labelled {label}")
    return found[0]


def extract_feed(records: DataFrame, label: str) -> DataFrame:
    stream = feed_stream(feeds(records), label)
    return extract_stream(records.filter(F.col("stream_id") == stream))


def index_json(records: DataFrame) -> DataFrame:
    """The index payload of each archive: its records in order."""
    item = F.to_json(F.struct(F.col("sequence"), F.col("file_offset").alias("offset"), F.col("record_type").alias("type"), F.col("stream_id").alias("stream"), F.col("payload_size").alias("bytes")))
    parts = F.array_sort(F.collect_list(F.struct("sequence", item.alias("item"))))
    text = F.concat(F.lit(f'{{"format":"{model.INDEX_FORMAT}","records":['), F.array_join(F.transform(parts, lambda x: x["item"]), ","), F.lit("]}"))
    return records.groupBy("archive_id").agg(text.alias("index_json"))
