"""Helpers shared by the corpus operators: lineage cuts, Arrow text buffers, vectorised hashing, count blobs."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shared import new_path

U64 = np.uint64

#: ASCII white space: space and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    """The number of shuffle partitions, which the cluster sizes to its input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator reads, whatever else the table carries."""
    return docs.select("doc_id", "text", *more)


REST = "_rest"


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns in one, so that none of their names can clash with an operator's."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*[docs[c] for c in others]) if others else F.lit(0)
    return docs.select("doc_id", "text", rest.alias(REST))


def unpacked(df: DataFrame, columns: list[str], *more: str) -> DataFrame:
    """The columns that packed() put away, in their order, and `more` of df's own."""
    return df.select(*[F.col(c) if c in ("doc_id", "text") else F.col(REST).getField(c).alias(c) for c in columns], *more)


def wider(df: DataFrame, columns: tuple[str, ...], ddl: str) -> StructType:
    """A schema of columns of df and further ones."""
    return StructType([df.schema[c] for c in columns] + StructType.fromDDL(ddl).fields)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows one after the other and n + 1 offsets, without a copy; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], most: int = 1 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text, one row at least; nothing is cut or dropped."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_buffer(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(at, at[start] + most, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (public splitmix64 finaliser constants)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


#: One random-looking 64-bit value for each byte, by rule.
GEAR = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
GEAR_FOLDED = GEAR.copy()
GEAR_FOLDED[65:91] = GEAR[97:123]
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.ones(size, U64)
        have[1:] = U64(base)
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


class RollingHash:
    """64-bit polynomial hashes of any byte ranges of one buffer, from prefix sums."""

    def __init__(self, flat: np.ndarray, table: np.ndarray = GEAR):
        self.sums = np.zeros(len(flat) + 1, U64)
        np.cumsum(table[flat] * powers(_BASE, len(flat)), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * powers(_INVERSE, len(self.sums))[start] + (end - start).astype(U64))


def words(flat: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (run of bytes that `space` does not mark; words end with their row), and the row's number."""
    word = ~space[flat]
    before, after = np.zeros(len(flat), bool), np.zeros(len(flat), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    edges = at[1:-1]
    before[edges[edges < len(flat)]] = False
    after[edges[edges > 0] - 1] = False
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def grams(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of one row, and the positions of their first words."""
    if len(h) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    last = len(h) - n + 1
    out = np.zeros(last, U64)
    for k in range(n):
        out = mix(out + h[k : k + last])
    first = np.flatnonzero(row[:last] == row[n - 1 :])
    return out[first], first


# Vectors of counts: each task sends one compressed blob for each slice, and tasks that add them as they stream
# hold one slice only.

SLICE = 1 << 12


def count_rows(name: str, counts: np.ndarray) -> list[tuple[str, int, bytes]]:
    return [(name, k, zlib.compress(counts[k * SLICE : (k + 1) * SLICE].astype("<i8").tobytes(), 1)) for k in range(-(-len(counts) // SLICE)) if counts[k * SLICE : (k + 1) * SLICE].any()]


COUNTS = "name string, part int, blob binary"


def count_batch(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], ["name", "part", "blob"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[str, int], np.ndarray] = {}
    for batch in batches:
        for name, part, blob in zip(*(batch.column(c).to_pylist() for c in ("name", "part", "blob")), strict=True):
            got = np.frombuffer(zlib.decompress(blob), "<i8")
            sums[name, part] = sums[name, part] + got if (name, part) in sums else got
    yield count_batch([(name, part, zlib.compress(v.tobytes(), 1)) for (name, part), v in sums.items()])


def collect_counts(df: DataFrame, size: int) -> dict[str, np.ndarray]:
    """The sum of count_rows() over all tasks, by name. What reaches the driver is as large as the vectors, however many rows there were."""
    n = tasks(df.sparkSession)
    partial = df.repartition(n, "name", "part", F.spark_partition_id() % 8).mapInArrow(_added, COUNTS)
    total: dict[str, np.ndarray] = {}
    for row in partial.repartition(n, "name", "part").mapInArrow(_added, COUNTS).toLocalIterator():
        v = total.setdefault(row["name"], np.zeros(size, np.int64))
        got = np.frombuffer(zlib.decompress(bytes(row["blob"])), "<i8")
        v[row["part"] * SLICE : row["part"] * SLICE + len(got)] += got
    return total
