"""Capture as DataFrame operators: chunks of byte feeds, limits, feed checks, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import require
from .integrity import running_sum

#: Bytes of a chunk, and the range that is allowed; bytes of a feed; redirects (none are followed).
CHUNK_BYTES, LEAST_CHUNK, MOST_CHUNK = 256 << 10, 4 << 10, 16 << 20
FEED_BYTES = 16 << 30
MOST_REDIRECTS = 20


def check_config(chunk_bytes: int = CHUNK_BYTES, feed_bytes: int = FEED_BYTES, redirects: int = 5) -> None:
    require(LEAST_CHUNK <= chunk_bytes <= MOST_CHUNK and feed_bytes > 0 and 0 <= redirects <= MOST_REDIRECTS, "invalid_argument", "a capture limit is out of its range")


def chunks(feeds: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """feeds: (feed, payload binary). One row for each chunk: feed, chunk, start (bytes before it), size, payload. An empty feed has none."""
    n = F.ceil(F.octet_length("payload") / chunk_bytes).cast("int")
    # The payload is cut into an array first, so that a chunk's row carries its own bytes only.
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substr(F.col("payload"), k * chunk_bytes + 1, F.lit(chunk_bytes)))
    df = feeds.select("feed", F.posexplode(F.when(n > 0, cut)).alias("chunk", "payload"))
    return df.select("feed", F.col("chunk").cast("long").alias("chunk"), (F.col("chunk").cast("long") * chunk_bytes).alias("start"), F.octet_length("payload").cast("long").alias("size"), "payload")


def limited(parts: DataFrame, maximum: int) -> DataFrame:
    """parts: (feed, chunk dense from 0, size). Adds accepted: whether the bytes up to this chunk's end are within the limit; the first chunk over it, and all after it, are not."""
    df = running_sum(parts, "feed", "chunk", F.col("size"), "before")
    return df.withColumn("accepted", F.col("before") + F.col("size") <= maximum)


def totals(parts: DataFrame) -> DataFrame:
    """Bytes, chunks and outcome of each feed of `limited`."""
    return parts.groupBy("feed").agg(
        F.coalesce(F.sum(F.when(F.col("accepted"), F.col("size"))), F.lit(0)).alias("bytes"),
        F.count(F.when(F.col("accepted"), 1)).alias("chunks"),
        F.when(F.bool_and("accepted"), F.lit("ok")).otherwise(F.lit("resource_exhausted")).alias("outcome"),
    )


def feed_errors(feeds: DataFrame) -> DataFrame:
    """feeds: (feed_index, label, uri, preserve_source, maximum_bytes). Adds problem: the first rule that a feed breaks, or null."""
    from ..functions.scalars import valid_label

    first = feeds.groupBy("label").agg(F.min("feed_index").alias("_first"))
    df = feeds.join(first, "label", "left")
    bad = ~valid_label(F.col("label")) | (F.coalesce("uri", F.lit("")) == "") | ~F.col("preserve_source") | (F.col("maximum_bytes") <= 0)
    return df.withColumn("problem", F.when(bad, "invalid_feed").when(F.col("feed_index") != F.col("_first"), "duplicate_label")).drop("_first")
