"""Every query of the record-log engine over the driver's tables, with its DuckDB counterpart where SQL can express it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model, shared
from ..errors import require
from ..functions import scalars
from ..operators import capture, identity, integrity, watermark

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share, as a path that they open; byte formats are written by path."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(shared.new_path(spark))
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    require(fs.getScheme() == "file", "archive_io", "archives need a shared folder that every executor has mounted")
    fs.mkdirs(p)
    return p.toUri().getPath()


# Records of the event log: each user is an archive, each event a record, its properties the payload.


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("archive_id"),
        "event_id",
        F.when(F.col("event_id") % 50 == 0, 4).otherwise(model.SOURCE_BYTES).alias("record_type"),
        scalars.derive_stream_id(F.concat_ws("\n", "event_type", F.col("user_id").cast("string"))).alias("stream_id"),
        F.coalesce("props", F.lit("")).cast("binary").alias("payload"),
    )
    return integrity.positions(e, "archive_id", "event_id").withColumn("payload_size", F.octet_length("payload").cast("long"))


def _stream_sql(value: str) -> str:
    h = f"sha256({value})"
    variant = f"substr('89ab89ab89ab89ab', CAST(instr('0123456789abcdef', substr({h}, 17, 1)) AS BIGINT), 1)"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || {variant} || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


RECORDS_SQL = f"""r AS (SELECT CAST(user_id AS VARCHAR) AS archive_id, user_id, event_id, CASE WHEN event_id % 50 = 0 THEN 4 ELSE 2 END AS record_type,
  {_stream_sql("event_type || chr(10) || CAST(user_id AS VARCHAR)")} AS stream_id, coalesce(props, '') AS payload, octet_length(encode(coalesce(props, ''))) AS payload_size,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS position FROM events)"""

LAYOUT_SQL = f"""{RECORDS_SQL}, l AS (SELECT *, 64 + coalesce(sum(136 + payload_size) OVER (PARTITION BY archive_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS file_offset FROM r)"""


@query(f"WITH {LAYOUT_SQL} SELECT archive_id, position, event_id, record_type, stream_id, CAST(payload_size AS BIGINT) AS payload_size, CAST(file_offset AS BIGINT) AS file_offset FROM l")
def record_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.layout(event_records(spark, sf_dir)).select("archive_id", "position", "event_id", "record_type", "stream_id", "payload_size", "file_offset")


@query("SELECT doc_id, octet_length(encode(text)) AS n_bytes, sha256(text) AS digest FROM documents")
def payload_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), scalars.sha256_hex("text").alias("digest"))


@query(f"SELECT DISTINCT user_id, event_type, {_stream_sql("event_type || chr(10) || CAST(user_id AS VARCHAR)")} AS stream_id FROM events")
def stream_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type").distinct()
    return e.withColumn("stream_id", scalars.derive_stream_id(F.concat_ws("\n", "event_type", F.col("user_id").cast("string"))))


@query(
    f"WITH {RECORDS_SQL} SELECT archive_id, count(*) AS records, lower(hex(list_reduce(list_prepend(unhex(repeat('00', 32)), list(unhex(sha256(payload)) ORDER BY position)), lambda h, p: unhex(sha256(h || p))))) AS head_hash FROM r GROUP BY archive_id"
)
def hash_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = event_records(spark, sf_dir).select("archive_id", "position", scalars.sha256_hex("payload").alias("digest"))
    return integrity.fold_chain(r).groupBy("archive_id").agg(F.count("*").alias("records"), F.max_by("hash", "position").alias("head_hash"))


# Damage by rule: some records' bytes, links and numbers are not what was stored, and some archives have a torn tail.


def damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = event_records(spark, sf_dir)
    stored = F.sha2(F.concat("payload", F.col("event_id").cast("string").cast("binary")), 256)
    r = r.withColumn("hash", stored).withColumn("computed_hash", F.when(F.col("event_id") % 397 == 0, F.reverse(stored)).otherwise(stored))
    r = integrity.with_previous(r, "computed_hash", "_p")
    previous = F.coalesce("_p", F.lit(integrity.ZERO_HASH))
    return r.withColumn("prev_hash", F.when(F.col("event_id") % 389 == 0, F.lit("f" * 64)).otherwise(previous)).withColumn("sequence", F.col("position") + F.when(F.col("event_id") % 383 == 0, 1).otherwise(0)).drop("_p")


def damaged_archives(records: DataFrame) -> DataFrame:
    torn = F.when(F.col("archive_id").cast("long") % 7 == 0, 20).otherwise(0)
    return records.groupBy("archive_id").agg((F.sum(F.col("payload_size") + model.OVERHEAD) + model.HEADER_SIZE).alias("_s")).select("archive_id", (F.col("_s") + torn).alias("file_bytes"))


CHECKED_SQL = f"""{RECORDS_SQL},
s AS (SELECT *, sha256(payload || CAST(event_id AS VARCHAR)) AS stored FROM r),
c AS (SELECT *, CASE WHEN event_id % 397 = 0 THEN reverse(stored) ELSE stored END AS computed FROM s),
p AS (SELECT *, coalesce(lag(computed) OVER (PARTITION BY archive_id ORDER BY position), repeat('0', 64)) AS before FROM c),
k AS (SELECT *, CASE WHEN stored <> computed THEN 'sha' WHEN CASE WHEN event_id % 389 = 0 THEN repeat('f', 64) ELSE before END <> before THEN 'chain'
  WHEN position + CASE WHEN event_id % 383 = 0 THEN 1 ELSE 0 END <> position THEN 'sequence' END AS failure FROM p),
first AS (SELECT archive_id, min(position) AS first_bad, arg_min(failure, position) AS failure FROM k WHERE failure IS NOT NULL GROUP BY archive_id),
good AS (SELECT k.* EXCLUDE (failure) FROM k LEFT JOIN first USING (archive_id) WHERE first_bad IS NULL OR position < first_bad),
arch AS (SELECT archive_id, 64 + sum(136 + payload_size) + CASE WHEN any_value(user_id) % 7 = 0 THEN 20 ELSE 0 END AS file_bytes FROM r GROUP BY archive_id),
sums AS (SELECT archive_id, count(*) AS n, sum(payload_size) AS b, sum(136 + payload_size) AS span FROM good GROUP BY archive_id)"""


@query(f"WITH {CHECKED_SQL} SELECT archive_id, position, event_id, failure FROM k WHERE failure IS NOT NULL")
def chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.checked(damaged(spark, sf_dir)).filter("failure is not null").select("archive_id", "position", "event_id", "failure")


_MESSAGE_SQL = " ".join(f"WHEN first.failure = '{k}' THEN '{v}'" for k, v in model.MESSAGES.items() if k in ("sha", "chain", "sequence"))


@query(
    f"""WITH {CHECKED_SQL} SELECT archive_id, first.failure IS NULL AND 64 + coalesce(span, 0) = file_bytes AS ok, false AS finalized, coalesce(n, 0) AS committed_records,
    CAST(coalesce(b, 0) AS BIGINT) AS verified_payload_bytes, CAST(64 + coalesce(span, 0) AS BIGINT) AS valid_prefix_bytes, CAST(file_bytes AS BIGINT) AS file_bytes,
    CASE WHEN first.failure IS NULL AND 64 + coalesce(span, 0) = file_bytes THEN 'ok' ELSE 'archive_corrupt' END AS error_code,
    CASE {_MESSAGE_SQL} WHEN 64 + coalesce(span, 0) <> file_bytes THEN '{model.MESSAGES["envelope"]}' ELSE '{model.MESSAGES["streaming"]}' END AS message
    FROM arch LEFT JOIN sums USING (archive_id) LEFT JOIN first USING (archive_id)"""
)
def verify_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = damaged(spark, sf_dir)
    return integrity.report(integrity.checked(r), damaged_archives(r))


@query(f"WITH {CHECKED_SQL} SELECT archive_id, position, event_id, stored AS hash FROM good")
def verified_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.prefix(integrity.checked(damaged(spark, sf_dir))).select("archive_id", "position", "event_id", "hash")


@query(f"WITH {CHECKED_SQL} SELECT archive_id, event_id, position AS old_position, row_number() OVER (PARTITION BY archive_id ORDER BY position) - 1 AS sequence, CAST(payload_size AS BIGINT) AS payload_size FROM good")
def repair_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = integrity.repair_plan(integrity.checked(damaged(spark, sf_dir)))
    return plan.select("archive_id", "event_id", F.col("position").alias("old_position"), "sequence", "payload_size")


@query(
    f"WITH {CHECKED_SQL} SELECT archive_id, coalesce(n, 0) AS recovered_records, CAST(coalesce(b, 0) AS BIGINT) AS recovered_payload_bytes, CAST(file_bytes - 64 - coalesce(span, 0) AS BIGINT) AS discarded_tail_bytes FROM arch LEFT JOIN sums USING (archive_id)"
)
def repair_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = damaged(spark, sf_dir)
    return integrity.repair_totals(integrity.checked(r), damaged_archives(r))


@query(
    f"""WITH {LAYOUT_SQL} SELECT archive_id, '{{"format":"{model.INDEX_FORMAT}","records":[' || string_agg('{{"sequence":' || position || ',"offset":' || CAST(file_offset AS BIGINT) || ',"type":' || record_type || ',"stream":"' || stream_id || '","bytes":' || payload_size || '}}', ',' ORDER BY position) || ']}}' AS index_json FROM l GROUP BY archive_id"""
)
def index_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.index_json(integrity.layout(event_records(spark, sf_dir)).withColumn("sequence", F.col("position")))


@query(
    f"""SELECT DISTINCT record_type, CASE record_type {" ".join(f"WHEN {k} THEN '{v}'" for k, v in model.RECORD_TYPES.items())} ELSE 'unknown' END AS record_type_name FROM (SELECT CAST(event_id % 40 AS INTEGER) AS record_type FROM events UNION ALL SELECT 65534)"""
)
def record_type_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "events").select((F.col("event_id") % 40).cast("int").alias("record_type")).unionAll(spark.range(1).select(F.lit(65534).alias("record_type")))
    return kinds.distinct().withColumn("record_type_name", model.record_type_name(F.col("record_type")))


# Feeds


def _feed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type").distinct()
    uri = F.concat(F.lit("https://feeds.example/"), F.col("event_type"))
    return e.select("event_type", scalars.feed_descriptor(F.col("event_type"), uri, F.lit(True)).alias("descriptor"), scalars.derive_stream_id(F.concat_ws("\n", "event_type", uri)).alias("stream_id"))


@query(
    """SELECT event_type, '46445331' || '0100' || printf('%02x%02x', n % 256, n // 256) || printf('%02x%02x0000', u % 256, u // 256) || '01000000' || lower(hex(encode(event_type))) || lower(hex(encode(uri))) AS descriptor
    FROM (SELECT DISTINCT event_type, 'https://feeds.example/' || event_type AS uri, octet_length(encode(event_type)) AS n, octet_length(encode('https://feeds.example/' || event_type)) AS u FROM events)"""
)
def feed_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feed_rows(spark, sf_dir).select("event_type", "descriptor")


@query(f"SELECT DISTINCT event_type AS label, 'https://feeds.example/' || event_type AS uri, true AS preserve_source, 'S0' AS fidelity, {_stream_sql("event_type || chr(10) || 'https://feeds.example/' || event_type")} AS stream_id FROM events")
def list_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _feed_rows(spark, sf_dir).select(F.lit("feeds").alias("archive_id"), F.lit(0).alias("sequence"), F.lit(model.FEED_DESCRIPTOR).alias("record_type"), "stream_id", F.unhex("descriptor").alias("payload"))
    return integrity.feeds(rows).select("label", "uri", "preserve_source", "fidelity", "stream_id")


@query("SELECT CAST(conv_id AS VARCHAR) AS stream_id, sum(octet_length(encode(text))) AS n_bytes, sha256(string_agg(text, '' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def extract_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(
        F.lit("conversations").alias("archive_id"), F.col("conv_id").cast("string").alias("stream_id"), F.col("turn").alias("sequence"), F.lit(model.SOURCE_BYTES).alias("record_type"), F.col("text").cast("binary").alias("payload")
    )
    whole = integrity.joined_bytes(integrity.extract_stream(c))
    return whole.select("stream_id", F.octet_length("payload").cast("long").alias("n_bytes"), F.sha2("payload", 256).alias("digest"))


@query(
    f"""SELECT 'feeds' AS archive_id, {_stream_sql("event_type || chr(10) || 'https://feeds.example/' || event_type")} AS stream_id, event_id AS chunk, sha256(coalesce(props, '')) AS digest
    FROM events WHERE event_type = (SELECT min(event_type) FROM events)"""
)
def extract_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of one label's feed: an archive of descriptors for all types of events, whose records are their feeds' bytes."""
    feeds = _feed_rows(spark, sf_dir)
    e = table(spark, sf_dir, "events")
    names = ["archive_id", "sequence", "record_type", "stream_id", "payload"]
    described = feeds.select(F.lit("feeds"), F.lit(0).cast("long"), F.lit(model.FEED_DESCRIPTOR), "stream_id", F.unhex("descriptor")).toDF(*names)
    uri = F.concat(F.lit("https://feeds.example/"), F.col("event_type"))
    stored = e.select(F.lit("feeds"), "event_id", F.lit(model.SOURCE_BYTES), scalars.derive_stream_id(F.concat_ws("\n", "event_type", uri)), F.coalesce("props", F.lit("")).cast("binary")).toDF(*names)
    label = e.agg(F.min("event_type").alias("label")).first()["label"]
    if label is None:
        return spark.createDataFrame([], "archive_id string, stream_id string, chunk long, digest string")
    return integrity.extract_feed(described.unionAll(stored), label).select("archive_id", "stream_id", "chunk", F.sha2("payload", 256).alias("digest"))


# Capture


@query(
    """SELECT doc_id, chunk, chunk * 4096 AS start, octet_length(b) AS size, sha256(b) AS digest FROM (SELECT doc_id, chunk, encode(text)[chunk * 4096 + 1:chunk * 4096 + 4096] AS b
    FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(octet_length(encode(text)) / 4096.0) AS BIGINT))) AS chunk FROM documents))"""
)
def chunk_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = capture.chunks(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("feed"), F.col("text").cast("binary").alias("payload")), 4096)
    return parts.select(F.col("feed").alias("doc_id"), "chunk", "start", "size", F.sha2("payload", 256).alias("digest"))


def _source_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("feed"), "doc_id", F.octet_length("text").cast("long").alias("size"))
    return capture.limited(integrity.positions(d, "feed", "doc_id", "chunk"), 100_000)


_LIMIT_SQL = "d AS (SELECT source AS feed, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS chunk, octet_length(encode(text)) AS size, doc_id FROM documents), l AS (SELECT *, sum(size) OVER (PARTITION BY feed ORDER BY chunk) <= 100000 AS accepted FROM d)"


@query(f"WITH {_LIMIT_SQL} SELECT feed, doc_id, chunk, accepted FROM l")
def capture_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _source_chunks(spark, sf_dir).select("feed", "doc_id", "chunk", "accepted")


@query(f"WITH {_LIMIT_SQL} SELECT feed, CAST(coalesce(sum(CASE WHEN accepted THEN size END), 0) AS BIGINT) AS bytes, count(CASE WHEN accepted THEN 1 END) AS chunks, CASE WHEN bool_and(accepted) THEN 'ok' ELSE 'resource_exhausted' END AS outcome FROM l GROUP BY feed")
def capture_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.totals(_source_chunks(spark, sf_dir))


def _uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = F.col("url"), F.col("page_id")
    uri = (
        F.when(n % 5 == 1, F.replace(p, F.lit("://"), F.lit("://user:secret@")))
        .when(n % 5 == 2, F.concat(p, F.lit("?token=a@b#part")))
        .when(n % 5 == 3, F.concat(F.lit("http://172."), (n % 40).cast("string"), F.lit(".0.1:80/x?y")))
        .when(n % 5 == 4, F.concat(F.lit("http://a@"), F.element_at(F.array(*map(F.lit, ["LOCALHOST", "x.localhost", "10.example.com", "[::1]", "8.8.8.8"])), (F.floor(n / 5) % 5 + 1).cast("int")), F.lit("/p")))
        .otherwise(p)
    )
    return table(spark, sf_dir, "pages").select("page_id", uri.alias("uri"))


_URIS_SQL = """u AS (SELECT page_id, CASE WHEN page_id % 5 = 1 THEN replace(url, '://', '://user:secret@') WHEN page_id % 5 = 2 THEN url || '?token=a@b#part'
  WHEN page_id % 5 = 3 THEN 'http://172.' || (page_id % 40) || '.0.1:80/x?y' WHEN page_id % 5 = 4 THEN 'http://a@' || ['LOCALHOST', 'x.localhost', '10.example.com', '[::1]', '8.8.8.8'][(page_id // 5) % 5 + 1] || '/p' ELSE url END AS uri FROM pages)"""


@query(f"WITH {_URIS_SQL} SELECT page_id, regexp_replace(regexp_replace(uri, '^([a-z]+://)[^/?#@]*@', '\\1'), '[?#].*$', '') AS redacted FROM u")
def redact_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _uris(spark, sf_dir).select("page_id", scalars.redacted_uri(F.col("uri")).alias("redacted"))


@query(
    f"""WITH {_URIS_SQL}, a AS (SELECT page_id, regexp_replace(regexp_extract(uri, '^[a-z]+://([^/?#]*)', 1), '^.*@', '') AS authority FROM u),
    h AS (SELECT page_id, lower(CASE WHEN authority[1] = '[' THEN regexp_extract(authority, '^[^\\]]*\\]') ELSE split_part(authority, ':', 1) END) AS host FROM a)
    SELECT page_id, host, host IN ('localhost', '0.0.0.0', '[::]', '[::1]') OR host LIKE '%.localhost' OR regexp_matches(host, '^(127\\.|10\\.|192\\.168\\.|169\\.254\\.)') OR (regexp_matches(host, '^172\\.[0-9]+\\.') AND CAST(nullif(regexp_extract(host, '^172\\.([0-9]+)\\.', 1), '') AS INTEGER) BETWEEN 16 AND 31) IS TRUE AS private FROM h"""
)
def private_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _uris(spark, sf_dir).select("page_id", scalars.uri_host(F.col("uri")).alias("host"), scalars.private_host(F.col("uri")).alias("private"))


_UNROUTABLE_SQL = " OR ".join(f"(n >> {32 - bits}) = {scalars.ipv4_number(net) >> (32 - bits)}" for net, bits in scalars.UNROUTABLE)


@query(f"SELECT event_id, NOT ({_UNROUTABLE_SQL}) AS routable FROM (SELECT event_id, (event_id * 2654435761) % 4294967296 AS n FROM events)")
def routable_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.pmod(F.col("event_id") * F.lit(2654435761), F.lit(1 << 32))
    return table(spark, sf_dir, "events").select("event_id", scalars.routable_ipv4(n).alias("routable"))


_LABELS = {"customer": "c_name", "supplier": "s_name", "nation": "n_name", "region": "r_name", "part": "p_name"}


@query(" UNION ALL ".join(f"SELECT '{t}' AS origin, {c} AS label, regexp_matches({c}, '^[\\x21-\\x3c\\x3e-\\x7e]{{1,128}}$') AS valid FROM {t}" for t, c in _LABELS.items()))
def valid_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("origin"), F.col(c).alias("label"), scalars.valid_label(F.col(c)).alias("valid")) for t, c in _LABELS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@query(
    """WITH f AS (SELECT s_suppkey AS feed_index, 'feed' || (s_suppkey % 60) AS label, CASE WHEN s_suppkey % 11 = 0 THEN '' ELSE 'file:///data/' || s_suppkey END AS uri, s_suppkey % 13 <> 0 AS preserve_source, CASE WHEN s_suppkey % 17 = 0 THEN 0 ELSE 1024 END AS maximum_bytes FROM supplier)
    SELECT feed_index, CASE WHEN uri = '' OR NOT preserve_source OR maximum_bytes <= 0 THEN 'invalid_feed' WHEN feed_index <> min(feed_index) OVER (PARTITION BY label) THEN 'duplicate_label' END AS problem FROM f"""
)
def feed_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    feeds = table(spark, sf_dir, "supplier").select(
        k.alias("feed_index"), F.concat(F.lit("feed"), (k % 60).cast("string")).alias("label"), F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("file:///data/"), k.cast("string"))).alias("uri"), (k % 13 != 0).alias("preserve_source"), F.when(k % 17 == 0, 0).otherwise(1024).alias("maximum_bytes")
    )
    return capture.feed_errors(feeds).select("feed_index", "problem")


# Scalars


@query(
    "SELECT event_id, printf('%02x%02x', event_id % 256, (event_id // 256) % 256) AS u16, printf('%02x%02x%02x%02x', event_id % 256, (event_id // 256) % 256, (event_id // 65536) % 256, (event_id // 16777216) % 256) AS u32, printf('%02x%02x%02x%02x', event_id % 256, (event_id // 256) % 256, (event_id // 65536) % 256, (event_id // 16777216) % 256) || '00000000' AS u64, event_id AS back FROM events"
)
def little_endian(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    wide = scalars.put_le(i, 8)
    return table(spark, sf_dir, "events").select("event_id", scalars.put_le(i, 2).alias("u16"), scalars.put_le(i, 4).alias("u32"), wide.alias("u64"), scalars.get_le(wide, 0, 8).alias("back"))


_STEPS = "list_reduce(list_prepend(code, range(0, 16)), lambda c, k: ((CASE WHEN (c >> 15) & 1 = 1 THEN xor(c << 1, 1792) ELSE c << 1 END) & 65535))"
_CRC_SQL = f"({_STEPS} >> 8)"


@query(f"SELECT p_partkey, code, {_CRC_SQL} AS crc, (54695::BIGINT << 24) | (code << 8) | {_CRC_SQL} AS message, bit_count(xor(code, 54695::BIGINT)) AS distance FROM (SELECT p_partkey, CAST(p_partkey * 40503 % 65536 AS BIGINT) AS code FROM part)")
def crc8_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = (F.col("p_partkey") * 40503 % 65536).cast("long")
    return table(spark, sf_dir, "part").select("p_partkey", code.alias("code"), scalars.crc8(code).cast("long").alias("crc"), scalars.message(code).alias("message"), scalars.hamming16(code.cast("int"), F.lit(scalars.PREAMBLE)).alias("distance"))


@query("SELECT p_partkey, array_to_string([(m >> k) & 1 FOR k IN range(39, -1, -1)], '') AS bits FROM (SELECT p_partkey, (54695::BIGINT << 24) | (code << 8) | " + _CRC_SQL + " AS m FROM (SELECT p_partkey, CAST(p_partkey * 40503 % 65536 AS BIGINT) AS code FROM part))")
def message_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = (F.col("p_partkey") * 40503 % 65536).cast("long")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(scalars.message_bits(code).cast("array<string>"), "").alias("bits"))


@query("""SELECT event_id, CAST(floor(rate * 20 / 1000) AS BIGINT) AS samples_per_bit, round(32767.0 * pow(10.0, dbfs / 20.0), 6) AS amplitude, CAST(least(greatest(round(value * 1000), -32768), 32767) AS INTEGER) AS sample
    FROM (SELECT event_id, value, [8000, 22050, 44100, 48000, 96000][event_id % 5 + 1] AS rate, CAST(-(event_id % 115) - 6 AS DOUBLE) AS dbfs FROM events)""")
def signal_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    rate = F.element_at(F.array(*map(F.lit, [8000, 22050, 44100, 48000, 96000])), (i % 5 + 1).cast("int"))
    dbfs = (-(i % 115) - 6).cast("double")
    return table(spark, sf_dir, "events").select("event_id", scalars.samples_per_bit(rate, 20).alias("samples_per_bit"), F.round(scalars.amplitude(dbfs), 6).alias("amplitude"), scalars.to_sample(F.col("value") * 1000).alias("sample"))


_OMEGA = 0.7


@query("""SELECT vec_id, round(r.q * r.q + r.p * r.p - 1.5296843745689767 * r.p * r.q, 6) AS power FROM (SELECT vec_id, list_reduce(list_prepend({'x': 0.0::DOUBLE, 'p': 0.0::DOUBLE, 'q': 0.0::DOUBLE}, [{'x': v::DOUBLE, 'p': 0.0::DOUBLE, 'q': 0.0::DOUBLE} FOR v IN embedding]),
    lambda a, b: {'x': b.x, 'p': b.x + 1.5296843745689767 * a.p - a.q, 'q': a.p}) AS r FROM embeddings)""")
def goertzel_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(scalars.goertzel_power(F.col("embedding"), _OMEGA), 6).alias("power"))


# Evidence


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as marks: a user is a clip, a type a band and code, the value places it."""
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("audio_id"), F.when(i % 3 == 0, "W2").otherwise("W1").alias("band"), (i % 4).cast("int").alias("code"), F.round(F.col("value"), 4).alias("confidence"), ((i * 7919) % 5000).alias("start_frame"), ((i * 7919) % 5000 + 38400).alias("end_frame"), i.alias("ordinal")
    )


_OBS_SQL = "o AS (SELECT CAST(user_id AS VARCHAR) AS audio_id, CASE WHEN event_id % 3 = 0 THEN 'W2' ELSE 'W1' END AS band, CAST(event_id % 4 AS INTEGER) AS code, round(value, 4) AS confidence, (event_id * 7919) % 5000 AS start_frame, (event_id * 7919) % 5000 + 38400 AS end_frame, event_id AS ordinal FROM events)"
_STATE_SQL = """st AS (SELECT CAST(c_custkey AS VARCHAR) AS audio_id, CASE WHEN c_custkey % 5 = 0 THEN 'invalid_signature' WHEN 1500 < 1000 + c_custkey % 700 THEN 'not_yet_valid' WHEN 1500 > 1400 + c_custkey % 900 THEN 'expired' ELSE 'valid' END AS statement_state,
  'feed-' || c_custkey AS feed_uuid, CAST(c_custkey % 4 AS INTEGER) AS acoustic_code, c_name AS issuer FROM customer)"""


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    state = identity.window_state(k % 5 != 0, 1000 + k % 700, 1400 + k % 900, F.lit(1500))
    return table(spark, sf_dir, "customer").select(k.cast("string").alias("audio_id"), state.alias("statement_state"), F.concat(F.lit("feed-"), k.cast("string")).alias("feed_uuid"), (k % 4).cast("int").alias("acoustic_code"), F.col("c_name").alias("issuer"))


@query(f"WITH {_STATE_SQL} SELECT audio_id, statement_state FROM st")
def statement_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statements(spark, sf_dir).select("audio_id", "statement_state")


@query(f"WITH {_OBS_SQL} SELECT audio_id, band, code, count(*) AS confirmation_hops FROM o GROUP BY audio_id, band, code")
def confirmation_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watermark.confirmation_hops(_observations(spark, sf_dir))


@query(
    f"""WITH {_OBS_SQL}, {_STATE_SQL}, h AS (SELECT *, count(*) OVER (PARTITION BY audio_id, band, code) AS confirmation_hops FROM o),
    j AS (SELECT h.*, coalesce(st.statement_state, 'absent') AS statement_state, st.feed_uuid AS claimed_feed_uuid, st.issuer AS named, coalesce(st.statement_state = 'valid' AND st.acoustic_code = h.code, false) AS bound FROM h LEFT JOIN st USING (audio_id))
    SELECT audio_id, band, code, confidence, start_frame, end_frame, confirmation_hops, CASE WHEN bound AND confirmation_hops >= 3 THEN 'signature_bound_candidate' ELSE 'candidate' END AS state,
    'goertzel_bin_dominance' AS detection_statistic, false AS waveform_spike, false AS authoritative, statement_state, claimed_feed_uuid, CASE WHEN bound THEN named END AS issuer FROM j"""
)
def candidate_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watermark.fuse(_observations(spark, sf_dir), _statements(spark, sf_dir))


_NEAR = 60


@query(
    f"""WITH RECURSIVE {_OBS_SQL}, q AS (SELECT *, row_number() OVER (PARTITION BY audio_id, band, code ORDER BY ordinal) AS n FROM o),
    f AS (SELECT audio_id, band, code, list(start_frame ORDER BY n) AS s, list(ordinal ORDER BY n) AS ids FROM q GROUP BY audio_id, band, code),
    w(audio_id, band, code, s, ids, k, kept, ok) AS (SELECT audio_id, band, code, s, ids, 1, [s[1]], true FROM f UNION ALL
    SELECT audio_id, band, code, s, ids, k + 1, CASE WHEN len(list_filter(kept, lambda x: abs(x - s[k + 1]) < {_NEAR})) = 0 THEN list_append(kept, s[k + 1]) ELSE kept END, len(list_filter(kept, lambda x: abs(x - s[k + 1]) < {_NEAR})) = 0 FROM w WHERE k < len(s))
    SELECT audio_id, band, code, s[k] AS start_frame, ids[k] AS ordinal FROM w WHERE ok"""
)
def greedy_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watermark.greedy_dedupe(_observations(spark, sf_dir).select("audio_id", "band", "code", "start_frame", "ordinal"), _NEAR)


@query(
    f"""SELECT event_id, bit_count(xor(value >> 24, 54695::BIGINT)) AS corrected, bit_count(xor(value >> 24, 54695::BIGINT)) <= 2 AND value & 255 = {_CRC_SQL} AND confidence >= 0.30 AS accepted
    FROM (SELECT event_id, confidence, value, (value >> 8) & 65535 AS code FROM (SELECT event_id, confidence, xor(xor((54695::BIGINT << 24) | (code << 8) | {_CRC_SQL}, (event_id % 16) << 26), CASE WHEN event_id % 5 = 0 THEN 1 << (event_id % 24) ELSE 0 END) AS value
    FROM (SELECT event_id, value AS confidence, CAST(event_id * 40503 % 65536 AS BIGINT) AS code FROM events)))"""
)
def acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detector's test on messages of which some preambles, codes and CRCs have wrong bits, with the table's values as confidences."""
    i = F.col("event_id")
    sent = scalars.message((i * 40503 % 65536).cast("long"))
    wrong = F.when(i % 5 == 0, F.expr("shiftleft(1L, cast(event_id % 24 as int))")).otherwise(F.lit(0).cast("long"))
    read = sent.bitwiseXOR(F.shiftleft(i % 16, 26)).bitwiseXOR(wrong)
    e = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("confidence"), read.alias("read"))
    corrected = scalars.hamming16(F.shiftright("read", 24).cast("int"), F.lit(scalars.PREAMBLE))
    return e.select("event_id", corrected.alias("corrected"), scalars.accepted(F.col("read"), F.col("confidence")).alias("accepted"))


# Whole paths through the byte formats


def _conversation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("archive_id", (F.col("conv_id") % 16).cast("string"))
    c = c.withColumn("order", F.col("conv_id") * 100_000 + F.col("turn"))
    return integrity.positions(c, "archive_id", "order", "sequence").select(
        "archive_id", "sequence", F.lit(model.SOURCE_BYTES).alias("record_type"), scalars.derive_stream_id(F.col("conv_id").cast("string")).alias("stream_id"), F.col("turn").alias("start_ns"), (F.col("turn") + 1).alias("end_ns"), F.col("text").cast("binary").alias("payload")
    )


def _le_sql(value: str, size: int) -> str:
    """Little-endian hexadecimal of a number below 2 ** 32."""
    known = ", ".join(f"({value} >> {8 * k}) % 256" for k in range(min(size, 4)))
    return f"(printf('{'%02x' * min(size, 4)}', {known})" + (f" || '{'00' * (size - 4)}')" if size > 4 else ")")


_CRC_TABLE_SQL = f"crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {0x82F63B78}) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(0, 256)) AS i)))"


def _crc32c_sql(digits: str) -> str:
    """CRC-32C of bytes given in lower-case hexadecimal, by the list crc.t."""
    digit = lambda k: f"instr('0123456789abcdef', substr({digits}, 2 * i + {k}, 1)) - 1"
    read = f"list_transform(range(0, CAST(length({digits}) // 2 AS BIGINT)), lambda i: ({digit(1)}) * 16 + {digit(2)})"
    return f"xor(list_reduce(list_prepend(4294967295, {read}), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


_CONVERSATIONS_SQL = f"""c AS (SELECT CAST(conv_id % 16 AS VARCHAR) AS archive_id, row_number() OVER (PARTITION BY conv_id % 16 ORDER BY conv_id, turn) - 1 AS sequence, turn, {_stream_sql("CAST(conv_id AS VARCHAR)")} AS stream_id,
  lower(hex(encode(coalesce(text, '')))) AS payload FROM conversations),
l AS (SELECT *, length(payload) // 2 AS payload_size, 64 + coalesce(sum(136 + length(payload) // 2) OVER (PARTITION BY archive_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS file_offset FROM c)"""

# Each record's hash needs the one before it, so the query walks the sequence numbers.
_BODY_SQL = f"'43445231' || '02000000' || '60000000' || {_le_sql('payload_size', 8)} || {_le_sql('sequence', 8)} || replace(stream_id, '-', '') || {_le_sql('turn', 8)} || {_le_sql('(turn + 1)', 8)}"
_HASHED_SQL = f"sha256(unhex(body || {_le_sql(_crc32c_sql('body'), 4)} || payload))"
_CHAINED_SQL = f"""{_CONVERSATIONS_SQL}, {_CRC_TABLE_SQL}, e AS (SELECT archive_id, sequence, payload, {_BODY_SQL} AS head FROM l),
chain(archive_id, sequence, prev_hash, hash) AS (SELECT archive_id, sequence, repeat('0', 64), {_HASHED_SQL} FROM (SELECT *, head || repeat('0', 64) AS body FROM e WHERE sequence = 0), crc
  UNION ALL SELECT archive_id, sequence, before, {_HASHED_SQL} FROM (SELECT e.archive_id, e.sequence, e.payload, chain.hash AS before, e.head || chain.hash AS body FROM chain JOIN e ON e.archive_id = chain.archive_id AND e.sequence = chain.sequence + 1), crc)"""


@query(f"WITH RECURSIVE {_CHAINED_SQL} SELECT archive_id, sequence, prev_hash, hash FROM chain")
def record_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hashes that archives of all conversations store."""
    records = _conversation_records(spark, sf_dir).withColumnRenamed("sequence", "position")
    return integrity.fold_records(records).select("archive_id", F.col("position").alias("sequence"), "prev_hash", "hash")


@query(
    f"""WITH {_CONVERSATIONS_SQL}, n AS (SELECT archive_id, count(*) AS n, sum(payload_size) AS b, length('{{"format":"{model.INDEX_FORMAT}","records":[' || string_agg('{{"sequence":' || sequence || ',"offset":' || CAST(file_offset AS BIGINT) || ',"type":2,"stream":"' || stream_id || '","bytes":' || payload_size || '}}', ',') || ']}}') AS i FROM l GROUP BY archive_id)
    SELECT archive_id, true AS ok, true AS finalized, n + 1 AS committed_records, CAST(b + i AS BIGINT) AS verified_payload_bytes, CAST(64 + b + i + 136 * (n + 1) AS BIGINT) AS valid_prefix_bytes, CAST(64 + b + i + 136 * (n + 1) AS BIGINT) AS file_bytes, 'ok' AS error_code, '{model.MESSAGES["finalized"]}' AS message FROM n"""
)
def archive_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as archives of the byte format, scanned again and verified."""
    from ..sources import archive

    written = archive.write_archives(_conversation_records(spark, sf_dir), shared_folder(spark)).collect()
    paths = [r["path"] for r in written]  # sixteen archives
    return archive.verify(spark, paths).withColumn("archive_id", F.regexp_extract("archive_id", r"([^/]*)\.arc$", 1))


@query("SELECT CAST(vec_id AS VARCHAR) AS audio_id, 'W1' AS band, CAST(vec_id * 40503 % 65536 AS INTEGER) AS code, 0::BIGINT AS start_frame, 38400::BIGINT AS end_frame, 0 AS corrected_preamble_bits, 0 AS ordinal, true AS confident, 'ok' AS error_code FROM embeddings")
def watermark_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks embedded in clips of one tone each, a clip for every row of embeddings by its id, and detected again.

    Of reads whose frames overlap the strongest: of some codes a read beside the mark passes preamble and CRC by chance.
    """
    import numpy as np
    import pyarrow as pa

    def clips(batches):
        for ids in (part.column("vec_id").to_pylist() for batch in batches for part in watermark.few(batch)):
            names, wavs, codes = [], [], []
            for i in ids:
                samples = np.trunc(1200 * np.sin(2 * np.pi * (300 + i % 200) * np.arange(48000) / 48000)).astype(np.int16)
                names.append(str(i))
                wavs.append(watermark.write_wav(watermark.Audio(48000, 1, samples)))
                codes.append(i * 40503 % 65536)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(wavs, pa.binary()), pa.array(codes, pa.int32())], ["audio_id", "wav", "code"])

    made = table(spark, sf_dir, "embeddings").select("vec_id").repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(clips, "audio_id string, wav binary, code int")
    policy = watermark.Policy(amplitude_dbfs=-32.0)
    found = watermark.detect_all(watermark.embed_all(made, "W1", policy), policy, overlapping=False)
    return found.withColumn("confident", F.col("confidence") >= policy.minimum_confidence).drop("confidence")


@query(
    """SELECT CAST(s_suppkey AS VARCHAR) AS statement_id, CASE WHEN 1500 < not_before THEN 'not_yet_valid' WHEN 1500 > expires_at THEN 'expired' ELSE 'valid' END AS statement_state, 'feed-' || s_suppkey AS feed_uuid, CAST(s_suppkey % 65536 AS INTEGER) AS acoustic_code,
    1000::BIGINT AS issued_at, not_before, expires_at, s_name AS issuer, 'test-key' AS key_id, CAST(NULL AS VARCHAR) AS error FROM (SELECT *, 1000 + s_suppkey % 700 AS not_before, 2100 + s_suppkey % 900 AS expires_at FROM supplier)"""
)
def statement_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements for the suppliers, signed with a fixed test key and verified on executors."""
    import pyarrow as pa

    seed = bytes(range(32))

    def signed(batches):
        for batch in batches:
            rows = []
            for k, name in zip(batch.column("s_suppkey").to_pylist(), batch.column("s_name").to_pylist(), strict=True):
                s = identity.Statement(f"feed-{k}", k % 65536, 1000, 1000 + k % 700, 1400 + k % 900 + 700, name, "test-key")
                rows.append((str(k), identity.assemble(s.key_id, s.payload(), identity.sign(seed, identity.to_be_signed(s.payload())))))
            cols = list(zip(*rows, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary())], ["statement_id", "cose"])

    cose = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name").mapInArrow(signed, "statement_id string, cose binary")
    return identity.verify_all(cose, identity.public_of(seed), 1500)


@query(f"WITH {_CRC_TABLE_SQL}, p AS (SELECT conv_id, turn, lower(hex(encode(text))) AS h FROM conversations) SELECT conv_id, turn, {_crc32c_sql('h')} AS crc32c FROM p, crc")
def crc32c(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import archive

    return archive.crc32c_column(table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").cast("binary").alias("payload")), "payload").drop("payload")


@query(ORACLE_SQL["hash_chain"])
def chain_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' chain built by a stream: state of each archive is its next sequence and last hash."""
    from ..streaming.archives import chain

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    folder, pattern = path.rsplit("/", 1)
    e = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder) if not _is_folder(spark, path) else spark.readStream.schema(schema).parquet(path)
    records = e.select(F.col("user_id").cast("string").alias("archive_id"), F.col("event_id").alias("event_order"), scalars.sha256_hex(F.coalesce("props", F.lit(""))).alias("digest"))
    out, state = shared_folder(spark), shared_folder(spark)
    chain(records).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("archive_id").agg(F.count("*").alias("records"), F.max_by("hash", "sequence").alias("head_hash"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@query(f"WITH RECURSIVE {_CHAINED_SQL} SELECT archive_id, sequence AS position, sequence, 2 AS record_type, stream_id, CAST(payload_size AS BIGINT) AS payload_size, CAST(file_offset AS BIGINT) AS file_offset, hash FROM l JOIN chain USING (archive_id, sequence)")
def tail_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, written as archives that are not finalized and followed to their ends as one stream of verified records."""
    from ..sources import archive
    from ..streaming.archives import follow

    written = archive.write_archives(_conversation_records(spark, sf_dir), shared_folder(spark), finalize=False).collect()
    paths = [r["path"] for r in written]  # sixteen archives
    schema = "archive_id string, position long, sequence long, record_type int, stream_id string, payload_size long, file_offset long, hash string"
    if not paths:
        return spark.createDataFrame([], schema)
    out, state = shared_folder(spark), shared_folder(spark)
    follow(spark, paths).drop("payload").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(out).withColumn("archive_id", F.regexp_extract("archive_id", r"([^/]*)\.arc$", 1))
    return found.select(*[c.split()[0] for c in schema.split(", ")])


@query(f"WITH RECURSIVE {_CHAINED_SQL} SELECT archive_id, sequence, prev_hash, hash FROM chain")
def append_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations appended by a stream to open archives, a commit for each record, and read back."""
    from ..sources import archive
    from ..streaming.archives import append

    schema = spark.read.parquet(path := f"{sf_dir}/conversations.parquet").schema
    folder, pattern = path.rsplit("/", 1)
    c = spark.readStream.schema(schema).parquet(path) if _is_folder(spark, path) else spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    rows = c.select(
        (F.col("conv_id") % 16).cast("string").alias("archive_id"),
        (F.col("conv_id") * 100_000 + F.col("turn")).alias("event_order"),
        F.lit(model.SOURCE_BYTES).alias("record_type"),
        scalars.derive_stream_id(F.col("conv_id").cast("string")).alias("stream_id"),
        F.col("turn").cast("long").alias("start_ns"),
        (F.col("turn") + 1).cast("long").alias("end_ns"),
        F.col("text").cast("binary").alias("payload"),
    )
    out = shared_folder(spark)
    append(rows, out, shared_folder(spark)).trigger(availableNow=True).start().awaitTermination()
    paths = [f"{out}/{name}" for name in sorted(os.listdir(out)) if name.endswith(".arc")]  # sixteen archives
    found = archive.records(spark, paths).withColumn("archive_id", F.regexp_extract("archive_id", r"([^/]*)\.arc$", 1))
    return found.select("archive_id", "sequence", "prev_hash", "hash")
