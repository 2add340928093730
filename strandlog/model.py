"""Record model: fixed values of the wire format, dimensions and schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the wire format.
HEADER_MAGIC = b"CODADEV\n"
ENVELOPE_MAGIC = b"CDR1"
TRAILER_MAGIC = b"CMT1"
DESCRIPTOR_MAGIC = b"FDS1"
INDEX_FORMAT = "CODA-index-v1"
HEADER_SIZE, ENVELOPE_SIZE, TRAILER_SIZE = 64, 96, 40
OVERHEAD = ENVELOPE_SIZE + TRAILER_SIZE
FORMAT_VERSION, PROFILE_VERSION = 0, 1

# Record types by number.
RECORD_TYPES = {
    1: "feed_descriptor",
    2: "source_bytes",
    3: "pcm16",
    4: "gap",
    20: "watermark_statement",
    21: "watermark_observation",
    22: "feed_identity_event",
    30: "audit_event",
    65534: "final_index",
}
FEED_DESCRIPTOR, SOURCE_BYTES, PCM16, FINAL_INDEX = 1, 2, 3, 65534

# What a caller of a C interface sees for each error code; others are INTERNAL.
STATUSES = {
    "ok": "OK",
    "invalid_argument": "INVALID_ARGUMENT",
    "unauthorized_source": "UNAUTHORIZED_SOURCE",
    "network": "NETWORK",
    "protocol": "PROTOCOL",
    "decode": "DECODE",
    "archive_io": "ARCHIVE_IO",
    "archive_corrupt": "ARCHIVE_CORRUPT",
    "resource_exhausted": "RESOURCE_EXHAUSTED",
}

# Stream types and truth classes by number.
STREAM_TYPES = {
    0: "opaque",
    1: "audio",
    2: "video",
    3: "image",
    4: "telemetry",
    5: "sensor",
    6: "navigation",
    7: "document_event",
    8: "network_system",
    9: "model_artifact",
    10: "identity_evidence",
    11: "recovery",
    12: "audit",
    13: "authorization_policy",
    65534: "custom",
}
TRUTH_CLASSES = {0: "source_exact", 1: "state_exact", 2: "derived"}

#: What is known of a stream besides its bytes: descriptor, clock and epoch.
STREAMS = (
    "stream_id string, stream_type int, label string, source_id string, payload_type string, "
    "clock struct<monotonic_ns: long, utc_ns: long, utc_uncertainty_ns: long, source_timestamp: long, timebase_numerator: long, timebase_denominator: long>, "
    "epoch struct<connection: long, format: long>"
)

#: A verified or candidate record as the archive source gives it.
RECORDS = (
    "archive_id string, position long, sequence long, record_type int, record_type_name string, flags int, stream_id string, "
    "start_ns long, end_ns long, payload_size long, file_offset long, prev_hash string, hash string, payload binary"
)
REPORT = "archive_id string, ok boolean, finalized boolean, committed_records long, verified_payload_bytes long, valid_prefix_bytes long, file_bytes long, error_code string, message string"

# Outcomes of verification.
MESSAGES = {
    "finalized": "archive verified and finalized",
    "streaming": "complete streaming archive verified",
    "envelope": "incomplete record envelope at archive tail",
    "magic": "invalid record envelope magic",
    "crc": "invalid record envelope size or CRC",
    "payload": "incomplete record payload or commit trailer",
    "trailer": "invalid or incomplete commit trailer",
    "sha": "record SHA-256 mismatch",
    "chain": "record hash-chain mismatch",
    "sequence": "non-contiguous record sequence",
}


def name_of(column: Column, names: dict[int, str], otherwise: str = "unknown") -> Column:
    """A CASE over a small fixed dimension."""
    out = F.lit(otherwise)
    for key, name in names.items():
        out = F.when(column == key, F.lit(name)).otherwise(out)
    return out


def record_type_name(column: Column) -> Column:
    return name_of(column, RECORD_TYPES)


def stream_type_name(column: Column) -> Column:
    return name_of(column, STREAM_TYPES)


def truth_class_name(column: Column) -> Column:
    return name_of(column, TRUTH_CLASSES)


def record_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RECORD_TYPES.items()), "record_type int, record_type_name string")


def capabilities() -> dict[str, object]:
    """What this engine does; nothing is claimed that it does not."""
    # The names of the fields.
    return {
        "version": "0.1.0",
        "coda_archive": True,
        "file_capture": True,
        "http_capture": True,
        "pcm16_wav": True,
        "w0_ed25519": True,
        "w1_reference": True,
        "w2_reference": True,
        "w2_policy": "qualified_paths_only",
        "neural_separation": False,
        "gpu_inference": False,
    }
