"""Substring dedup by content-defined chunks.

Method: a gear hash rolls over the bytes (16 bits, so each value depends on the 16 bytes before it). Every character boundary
may be a cut; a place where white space ends goes before any other. The places with the least value within REACH bytes on
both sides cut the text into variable chunks, which are longer than REACH bytes therefore. A chunk of over MOST bytes, in
which the least value recurs (words or characters that go on and on), is cut where it does, more than REACH bytes apart.
Cuts depend on nearby bytes only, so an insertion moves no cut beyond its neighbourhood, in text without blanks too. Of all chunks with one digest (96 bits) the first by
(doc_id, position) stays. A run of neighbouring chunks that all came earlier is removed if it has at least LEAST bytes;
shorter runs are everyday phrases and stay.

Tasks send each digest once for all documents they hold at a time, so that a passage that a third of all documents share is
a few rows; what comes back for a document is bounded by its own length. One shuffle of the texts applies the decisions.

Defined results: null text stays null and has no chunk; empty texts stay; ids that several rows share: each row is judged by
its own chunks, equal chunks at equal places of one id are the same chunk; a document of which nothing is left has text ''.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import BUCKETS, Packer, batch, bucket_of, unpack
from .common import GEAR, REST, SPACE, RollingHash, packed, slices, tasks, text_buffer, unpacked, wider

REACH = 24
MOST = 192
LEAST = 100

_GEAR16 = (GEAR >> np.uint64(48)).astype(np.uint16)
_CHUNK = np.dtype([("digest", "<u8"), ("more", "<u4"), ("doc", "<i8"), ("start", "<u4")])
_FOUND = np.dtype([("start", "<u4"), ("more", "<u4")])


def gear(flat: np.ndarray) -> np.ndarray:
    """The 16-bit gear hash after each byte: twice the one before plus the byte's value, by doubling steps."""
    h = _GEAR16[flat]
    for k in (1, 2, 4, 8):
        h[k:] = h[k:] + (h[:-k] << np.uint16(k))
    return h


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """At i the least of values[i : i + width], for width >= 1, beyond the end none counts."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = np.minimum(out[:-step], out[step:])
        have += step
    return out


def cuts(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Starts of all chunks over rows that lie one after the other; each row with a byte starts one. Rows do not see each other."""
    apart = REACH + 16
    length = np.diff(at)
    to = np.arange(len(flat)) + np.repeat(apart * np.arange(1, len(length) + 1), length)
    wide = np.zeros(len(flat) + apart * (len(length) + 1), np.uint8)
    wide[to] = flat
    boundary = np.zeros(len(wide), bool)
    boundary[to] = (flat & 0xC0) != 0x80
    value = np.full(len(wide), 1 << 20, np.uint32)
    value[1:][boundary[1:]] = gear(wide)[:-1][boundary[1:]]
    value[1:] += np.where(SPACE[wide[:-1]] & ~SPACE[wide[1:]], 0, 1 << 16).astype(np.uint32)
    before = np.full(len(wide), 1 << 20, np.uint32)
    before[REACH:] = _least(value, REACH)[:-REACH]
    lowest = boundary & (value == _least(value, REACH + 1))
    chosen = (lowest & (value < before))[to]
    chosen[at[:-1][length > 0]] = True
    start = np.flatnonzero(chosen)
    end = np.append(start[1:], len(flat))
    long = np.flatnonzero(end - start > MOST)
    if not len(long):
        return start
    lowest, boundary = np.flatnonzero(lowest[to]), boundary[to]
    more = [x for k in long for x in _steps(int(start[k]), int(end[k]), lowest, boundary)]
    return np.union1d(start, np.array(more, np.int64))


def _steps(start: int, end: int, lowest: np.ndarray, boundary: np.ndarray) -> Iterator[int]:
    """Cuts of a stretch in which the least value recurs: at such places, over REACH and at most MOST bytes from each other."""
    while end - start > MOST:
        k = int(np.searchsorted(lowest, start + REACH + 1))
        start = min(int(lowest[k]) if k < len(lowest) else end, start + MOST)
        while not boundary[start]:
            start -= 1
        yield start


def _chunks(column: pa.Array):
    """Start, end, row, digest and check value of every chunk; starts count within all rows' bytes."""
    flat, at = text_buffer(column)
    start = cuts(flat, at)
    end = np.append(start[1:], len(flat))[: len(start)]
    row = np.searchsorted(at, start, "right") - 1
    other = RollingHash(flat, GEAR[::-1].copy())
    return flat, at, start, end, row, RollingHash(flat).of(start, end), (other.of(start, end) >> np.uint64(32)).astype(np.uint32)


_ROWS = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("blob", pa.binary())])
_ROWS_SQL = "bucket int, doc_id long, blob binary"


def _by_document(doc: np.ndarray, start: np.ndarray, more: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A row for each document: which of its chunks came earlier."""
    if not len(doc):
        return batch(_ROWS, [])
    order = np.argsort(doc, kind="stable")
    doc, found = doc[order], np.empty(len(doc), _FOUND)
    found["start"], found["more"] = start[order], more[order]
    first = np.flatnonzero(np.diff(doc, prepend=doc[:1] - 1))
    ends = np.append(first[1:], len(doc))
    return batch(_ROWS, [(int(doc[a]) % buckets, int(doc[a]), found[a:b].tobytes()) for a, b in zip(first.tolist(), ends.tolist(), strict=True)])


def _earliest(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks sorted by digest and place; which of them are not the first of their digest."""
    c = c[np.lexsort((c["start"], c["doc"], c["more"], c["digest"]))]
    same = np.zeros(len(c), bool)
    same[1:] = (c["digest"][1:] == c["digest"][:-1]) & (c["more"][1:] == c["more"][:-1])
    # At the very place of the first (an id that rows share) a chunk is that first one.
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(c))))
    return c, same & ((c["doc"] != c["doc"][head]) | (c["start"] != c["start"][head]))


def _map(buckets: int):
    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        c, later = _earliest(np.concatenate(held))
        yield _by_document(c["doc"][later], c["start"][later], c["more"][later], buckets)
        packer = Packer(_CHUNK, buckets)
        packer.add(c[~later], bucket_of(c["digest"][~later], buckets))
        yield batch(_ROWS, [(b, None, blob) for b, blob in packer.take()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in slices(batches):
            _, at, start, _, row, digest, more = _chunks(part.column("text"))
            known = ~np.asarray(part.column("doc_id").is_null())
            c = np.empty(len(start), _CHUNK)
            c["digest"], c["more"], c["start"] = digest, more, start - at[row]
            c["doc"] = part.column("doc_id").fill_null(0).to_numpy()[row]
            held.append(c[known[row]])
            size += held[-1].nbytes
            if size > 24 << 20:
                yield from flush(held)
                held, size = [], 0
        yield from flush(held)

    return run


def _reduce(buckets: int):
    """Rows sorted by bucket, of which one is held at a time."""

    def found(blobs: list[bytes]) -> pa.RecordBatch:
        c, later = _earliest(unpack(blobs, _CHUNK))
        return _by_document(c["doc"][later], c["start"][later], c["more"][later], buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for part in batches:
            packed = part.column("doc_id").is_null()
            done = part.filter(pa.compute.invert(packed))
            if done.num_rows:
                yield done
            rest = part.filter(packed)
            for b, blob in zip(rest.column("bucket").to_pylist(), rest.column("blob").to_pylist(), strict=True):
                if b != now and held:
                    yield found(held)
                    held = []
                now = b
                held.append(blob)
        if held:
            yield found(held)

    return run


def _apply(least: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            flat, at, start, end, row, _, more = _chunks(part.column("text"))
            edges = np.searchsorted(row, np.arange(part.num_rows + 1))
            kept, spans, counts = [], [], []
            raw = flat.tobytes()
            for k, (blobs, null) in enumerate(zip(part.column("found").to_pylist(), part.column("text").is_null().to_pylist(), strict=True)):
                a, b = edges[k], edges[k + 1]
                own, known = raw[at[k] : at[k + 1]], unpack(blobs or [], _FOUND)
                own_start, own_end = start[a:b] - at[k], end[a:b] - at[k]
                later = np.zeros(b - a, bool)
                if len(known):
                    place = np.clip(np.searchsorted(own_start, known["start"]), 0, max(b - a - 1, 0))
                    fits = (own_start[place] == known["start"]) & (more[a:b][place] == known["more"])
                    later[place[fits]] = True
                gone = []
                turn = np.flatnonzero(np.diff(later, prepend=False, append=False))
                for x, y in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True):
                    if own_end[y - 1] - own_start[x] >= least:
                        gone.append((int(own_start[x]), int(own_end[y - 1])))
                spans.append([{"start": x, "end": y} for x, y in gone])
                counts.append((b - a, int(later.sum())))
                if null:
                    kept.append(None)
                elif gone:
                    stops = [0, *(v for g in gone for v in g), len(own)]
                    kept.append(b"".join(own[stops[i] : stops[i + 1]] for i in range(0, len(stops), 2)).decode())
                else:
                    kept.append(own.decode())
            columns = [part.column(c) if c != "text" else pa.array(kept, pa.string()) for c in names]
            more_columns = [pa.array(np.diff(at)), pa.array([c for c, _ in counts], pa.int64()), pa.array([d for _, d in counts], pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
            yield pa.RecordBatch.from_arrays(columns + more_columns, [*names, "n_bytes", "n_chunks", "n_later", "spans"])

    return run


def dedup(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The columns of docs with removed runs cut out of text, and n_bytes, n_chunks, n_later (chunks that came earlier), spans
    array<struct<start, end>> (removed bytes of the text as it was), which take the place of columns of these names."""
    own = [c for c in docs.columns if c not in RESULTS]
    return unpacked(located(docs, least), own, *RESULTS)


RESULTS = ("n_bytes", "n_chunks", "n_later", "spans")


def located(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """packed(docs) with removed runs cut out of text, and RESULTS."""
    n = tasks(docs.sparkSession)
    buckets = n * BUCKETS
    names = ["doc_id", "text", REST]
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_map(buckets), _ROWS_SQL).repartition(n, "bucket").sortWithinPartitions("bucket")
    found = dealt.mapInArrow(_reduce(buckets), _ROWS_SQL).groupBy("doc_id").agg(F.collect_list("blob").alias("found")).withColumnRenamed("doc_id", "found_id")
    base = packed(docs)
    joined = base.join(found, base.doc_id == found.found_id, "left").drop("found_id")
    return joined.mapInArrow(_apply(least, names), wider(base, tuple(names), "n_bytes long, n_chunks long, n_later long, spans array<struct<start: int, end: int>>"))


def cleaned(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The columns of docs with removed runs cut out of text (and n_chars, if there is one, after that); texts that lose their last word go."""
    found = located(docs, least).filter((F.size("spans") == 0) | F.col("text").rlike("[^ \t-\r]"))
    cut = F.size("spans") > 0
    out = unpacked(found.withColumn("_cut", cut), docs.columns, *["_cut"] * ("n_chars" in docs.columns))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_cut"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
