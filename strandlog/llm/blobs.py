"""Many small fixed-width records through one shuffle: tasks pack them into a binary blob for each bucket."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Buckets for each task that reads them: many small ones are dealt evenly by hash.
BUCKETS = 8


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the upper bits of 64-bit hashes; any number of buckets."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


class Packer:
    """Gathers arrays of records (structured dtype) and gives one blob for each bucket whenever `most` bytes have come together."""

    def __init__(self, dtype: np.dtype, buckets: int, most: int = 24 << 20):
        self.dtype, self.buckets, self.most = dtype, buckets, most
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, records: np.ndarray, bucket: np.ndarray) -> None:
        self.held.append((records, bucket))
        self.size += records.nbytes

    def full(self) -> bool:
        return self.size >= self.most

    def take(self) -> Iterator[tuple[int, bytes]]:
        if not self.held:
            return
        records = np.concatenate([r for r, _ in self.held])
        bucket = np.concatenate([b for _, b in self.held])
        self.held, self.size = [], 0
        order = np.argsort(bucket, kind="stable")
        records, bucket = records[order], bucket[order]
        ends = np.flatnonzero(np.diff(bucket, append=-1)) + 1
        start = 0
        for end in ends:
            yield int(bucket[start]), records[start:end].tobytes()
            start = int(end)


def unpack(blobs: list[bytes], dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype)


def batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
