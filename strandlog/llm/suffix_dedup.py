"""Removal of every byte that lies in a string of LENGTH bytes that also starts earlier, by suffix arrays.

Method. Anchors: of the LENGTH - GRAM + 1 grams of GRAM bytes in a window of LENGTH bytes, the one with the least hash is
the window's anchor, so equal windows have equal anchors. The neighbouring windows of one anchor are a run. Runs whose
gram is nowhere else in the table hold no repeated window. Of runs with the very same bytes (128-bit digests) all but the
first are covered. What is left are different runs around one gram. They are narrowed to windows that share a hash with another one, and these
are compared byte by byte: a suffix array over their texts is
built by two-stage sorting (only suffixes smaller than their successors are sorted, the rest are induced by a scan over
buckets), and neighbours in it with a common prefix of LENGTH bytes are equal windows.

Runs are dealt by the hashes of their grams. Tasks send one of equal runs for all documents that they hold at a time, so a
text that a third of all documents share is a few rows. One shuffle of the texts serves both the runs' bytes and the result.

Defined results: null text counts as empty; texts under LENGTH bytes lose nothing; matches never reach over documents; of rows
that share an id, a place is judged by (doc_id, start) alone, so repeated rows give equal rows; rows without an id keep all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import BUCKETS, Packer, batch, bucket_of, unpack
from .chunk_dedup import _least
from .common import GEAR, RollingHash, materialize, mix, slices, tasks, text_buffer

U64 = np.uint64
LENGTH = 100
GRAM = 32
#: Windows of one run at most, and its bytes.
REACH = LENGTH - GRAM + 1
WIDEST = LENGTH + REACH - 1
SEPARATOR = 0xFF  # never a byte of UTF-8

_RUN = np.dtype([("gram", "<u8"), ("digest", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("size", "<u2"), ("shift", "<u2")])
_TEXT = np.dtype([("gram", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("size", "<u2"), ("text", "u1", (WIDEST,))])
_PLACE = np.dtype([("start", "<u4"), ("size", "<u2"), ("kind", "<u2"), ("check", "<u8")])
COVERED, COMPARE = 0, 1


def runs(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """For every run of windows with one anchor: first window, bytes, row, gram's hash, place of the gram, digest of the bytes."""
    none = np.zeros(0, np.int64)
    n = len(flat)
    if n < LENGTH:
        return none, none, none, none.astype(U64), none, none.astype(U64)
    hashes = RollingHash(flat)
    place = np.arange(n - GRAM + 1)
    gram = hashes.of(place, place + GRAM)
    # The upper bits order grams, the lower ones hold the place, so that the first of equal grams is a window's anchor.
    bits = U64(31)
    key = (gram >> bits << bits) | place.astype(U64)
    window = np.flatnonzero(_inside(at, n))
    anchor = (_least(key, REACH)[window] & ((U64(1) << bits) - U64(1))).astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(new)
    start = window[first]
    last = window[np.append(first[1:], len(window))[: len(first)] - 1]
    end = last + LENGTH
    at_gram = anchor[first]
    digest = hashes.of(start, end) ^ (at_gram - start).astype(U64) * U64(0x9E3779B97F4A7C15)
    return start, end - start, np.searchsorted(at, start, "right") - 1, gram[at_gram], at_gram - start, digest


def _inside(at: np.ndarray, n: int) -> np.ndarray:
    """Which starts have LENGTH bytes of their own row after them."""
    end = np.repeat(at[1:], np.diff(at))
    return np.arange(n) + LENGTH <= end


# Suffix array


def _words8(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number that orders like them; nothing comes before anything at the end."""
    wide = np.zeros(len(text) + 8, U64)
    wide[: len(text)] = text
    out = np.zeros(len(text), U64)
    for k in range(8):
        out = (out << U64(8)) | wide[k : k + len(text)]
    return out


def _sorted_directly(places: np.ndarray, key: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the next `depth` bytes, eight at a time; only ties are looked at again."""
    order = places[np.argsort(key[places], kind="stable")]
    if not len(order):
        return order
    value = key[order]
    group = np.concatenate([[0], np.cumsum(value[1:] != value[:-1])])
    wide = np.concatenate([key, np.zeros(1, U64)])
    for step in range(8, depth, 8):
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        value = wide[np.minimum(order[tied] + step, len(key))]
        inner = np.lexsort((value, group[tied]))
        order[tied] = order[tied][inner]
        value, own = value[inner], group[tied][inner]
        split = np.zeros(len(order), np.int64)
        split[tied[1:]] = (value[1:] != value[:-1]) & (own[1:] == own[:-1])
        change = np.zeros(len(order), np.int64)
        change[1:] = group[1:] != group[:-1]
        group = np.cumsum(change + split)
    return order


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes of a byte text in the order of their first `depth` bytes (at least), by two-stage sorting."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    # A suffix is smaller than its successor if the first byte that differs from the next one is smaller.
    differs = np.flatnonzero(text[:-1] != text[1:])
    rises = np.zeros(n, bool)
    where = np.searchsorted(differs, np.arange(n))
    some = where < len(differs)
    turn = differs[where[some]]
    rises[np.flatnonzero(some)] = text[turn] < text[turn + 1]
    places = np.flatnonzero(rises)
    direct = _sorted_directly(places, _words8(text), depth + 8)
    bound = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[n - 1]].append(np.array([n - 1]))
    out = []

    def induce(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[~rises[before]]
        if len(before):
            symbol = text[before]
            order = np.argsort(symbol, kind="stable")
            symbol, before = symbol[order], before[order]
            edge = np.flatnonzero(np.diff(symbol, prepend=-1, append=256))
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                waiting[symbol[a]].append(before[a:b])

    for c in range(256):
        while waiting[c]:  # a wave may call for more in its own bucket, where a byte repeats
            wave = np.concatenate(waiting[c])
            waiting[c] = []
            out.append(wave)
            induce(wave)
        own = direct[bound[c] : bound[c + 1]]
        if len(own):
            out.append(own)
            induce(own)
    return np.concatenate(out)


def repeated(texts: np.ndarray, size: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """texts: rows of bytes, of which `size` count. Whether each window (row, offset < REACH) equals one that starts earlier."""
    wide = np.full((len(texts), WIDEST + 1), SEPARATOR, np.uint8)
    wide[:, :WIDEST] = texts
    used = np.arange(WIDEST + 1) < size[:, None]
    keep = np.arange(WIDEST + 1) <= size[:, None]
    wide[~used] = SEPARATOR
    flat = wide[keep]
    base = np.concatenate([[0], np.cumsum(size.astype(np.int64) + 1)])[:-1]
    order = suffix_array(flat, LENGTH)
    row = np.searchsorted(base, order, "right") - 1
    offset = order - base[row]
    ok = offset + LENGTH <= size[row]
    order, row, offset = order[ok], row[ok], offset[ok]
    # Common prefixes of neighbours, as far as LENGTH.
    key = _words8(flat)
    same = np.ones(max(len(order) - 1, 0), bool)
    for step in [*range(0, LENGTH - 7, 8), LENGTH - 8]:
        left = np.flatnonzero(same)
        same[left] = key[order[left] + step] == key[order[left + 1] + step]
    group = np.concatenate([[0], np.cumsum(~same)]) if len(order) else np.zeros(0, np.int64)
    where = start[row].astype(np.int64) + offset
    by = np.lexsort((where, doc[row], group))
    head = np.maximum.accumulate(np.where(np.diff(group[by], prepend=-1) != 0, np.arange(len(by)), 0))
    first = by[head]
    later = (doc[row[by]] != doc[row[first]]) | (where[by] != where[first])
    out = np.zeros((len(texts), REACH), bool)
    out[row[by[later]], offset[by[later]]] = True
    return out


# Dealing out

_ROWS = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("blob", pa.binary())])
_ROWS_SQL = "bucket int, doc_id long, blob binary"


def _by_document(doc: np.ndarray, places: np.ndarray, buckets: int) -> pa.RecordBatch:
    if not len(doc):
        return batch(_ROWS, [])
    order = np.argsort(doc, kind="stable")
    doc, places = doc[order], places[order]
    first = np.flatnonzero(np.diff(doc, prepend=doc[:1] - 1))
    ends = np.append(first[1:], len(doc))
    return batch(_ROWS, [(int(doc[a]) % buckets, int(doc[a]), places[a:b].tobytes()) for a, b in zip(first.tolist(), ends.tolist(), strict=True)])


def _places(r: np.ndarray, kind: int) -> np.ndarray:
    out = np.empty(len(r), _PLACE)
    out["start"], out["size"], out["kind"], out["check"] = r["start"], r["size"], kind, r["digest"]
    return out


def _earliest(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs by gram, digest and place; which of them equal an earlier one."""
    r = r[np.lexsort((r["start"], r["doc"], r["shift"], r["size"], r["digest"], r["gram"]))]
    same = np.zeros(len(r), bool)
    if len(r):
        same[1:] = np.logical_and.reduce([r[c][1:] == r[c][:-1] for c in ("gram", "digest", "size", "shift")])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(r))))
    return r, same & ((r["doc"] != r["doc"][head]) | (r["start"] != r["start"][head]))


def _runs_of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets, runs and their rows."""
    flat, at = text_buffer(part.column("text"))
    start, size, row, gram, shift, digest = runs(flat, at)
    r = np.empty(len(start), _RUN)
    r["gram"], r["digest"], r["start"], r["size"], r["shift"] = gram, digest, start - at[row], size, shift
    r["doc"] = part.column("doc_id").fill_null(0).to_numpy()[row]
    return flat, at, r, row


def _map(buckets: int):
    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        r, later = _earliest(np.concatenate(held))
        yield _by_document(r["doc"][later], _places(r[later], COVERED), buckets)
        packer = Packer(_RUN, buckets)
        # Anchors are least hashes, so their upper bits are small: they are mixed before they choose a bucket.
        packer.add(r[~later], bucket_of(mix(r["gram"][~later]), buckets))
        yield batch(_ROWS, [(b, None, blob) for b, blob in packer.take()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in slices(batches):
            _, _, r, row = _runs_of(part)
            held.append(r[~np.asarray(part.column("doc_id").is_null())[row]])
            size += held[-1].nbytes
            if size > 32 << 20:
                yield from flush(held)
                held, size = [], 0
        yield from flush(held)

    return run


def _gather(batches: Iterator[pa.RecordBatch], held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
    """Rows of documents as they come; packed ones are held by bucket."""
    for part in batches:
        packed = part.column("doc_id").is_null()
        done = part.filter(pa.compute.invert(packed))
        if done.num_rows:
            yield done
        rest = part.filter(packed)
        for b, blob in zip(rest.column("bucket").to_pylist(), rest.column("blob").to_pylist(), strict=True):
            held.setdefault(b, []).append(blob)


def _reduce(buckets: int):
    """Covered runs, and different runs around one gram, which are to be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        yield from _gather(batches, held)
        for b in list(held):
            r, later = _earliest(unpack(held.pop(b), _RUN))
            kept = r[~later]
            new = np.ones(len(kept), bool)
            new[1:] = kept["gram"][1:] != kept["gram"][:-1]
            number = np.cumsum(new) - 1
            # Tied places (an id that rows share) are one run.
            compare = np.bincount(number)[number] > 1 if len(kept) else new
            doc = np.concatenate([r["doc"][later], kept["doc"][compare]])
            yield _by_document(doc, np.concatenate([_places(r[later], COVERED), _places(kept[compare], COMPARE)]), buckets)

    return run


def _known(part: pa.RecordBatch, r: np.ndarray, row: np.ndarray, rows: list[list[bytes] | None], kind: int) -> np.ndarray:
    """Which runs of the batch the found places of their documents name, the digest being the same too."""
    out = np.zeros(len(r), bool)
    edges = np.searchsorted(row, np.arange(part.num_rows + 1))
    for k, blobs in enumerate(rows):
        if blobs:
            p = unpack(blobs, _PLACE)
            p = p[p["kind"] == kind]
            if len(p):
                own = r[edges[k] : edges[k + 1]]
                if len(own):
                    at = np.minimum(np.searchsorted(own["start"], p["start"]), len(own) - 1)
                    fits = (own["start"][at] == p["start"]) & (own["digest"][at] == p["check"])
                    out[edges[k] + at[fits]] = True
    return out


def _compared(buckets: int):
    """Texts of the runs to compare, dealt out by gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(_TEXT, buckets)
        for part in slices(batches):
            flat, at, r, row = _runs_of(part)
            use = _known(part, r, row, part.column("found").to_pylist(), COMPARE)
            r, row = r[use], row[use]
            t = np.zeros(len(r), _TEXT)
            for c in ("gram", "doc", "start", "size"):
                t[c] = r[c]
            begin = at[row] + r["start"]
            inside = np.minimum(begin[:, None] + np.arange(WIDEST), max(len(flat) - 1, 0))
            t["text"] = np.where(np.arange(WIDEST) < r["size"][:, None], flat[inside] if len(flat) else 0, 0)
            packer.add(t, bucket_of(mix(r["gram"]), buckets))
            if packer.full():
                yield batch(_ROWS, [(b, None, blob) for b, blob in packer.take()])
        yield batch(_ROWS, [(b, None, blob) for b, blob in packer.take()])

    return run


#: Runs in one suffix array; grams are never split over two.
ARRAY = 8_192
#: Runs whose windows are hashed at a time.
HASHED = 4_096


def _narrowed(t: np.ndarray) -> np.ndarray:
    """Runs cut to what lies between their first and last window whose hash another window has too; runs without one go."""
    hashes, rows, offsets = [], [], []
    for k in range(0, len(t), HASHED):
        part = t[k : k + HASHED]
        row, offset = np.nonzero(np.arange(REACH) + LENGTH <= part["size"][:, None])
        where = row * WIDEST + offset
        hashes.append(RollingHash(np.ascontiguousarray(part["text"]).reshape(-1)).of(where, where + LENGTH))
        rows.append((row + k).astype(np.int32))
        offsets.append(offset.astype(np.int32))
    if not hashes:
        return t
    h, row, offset = np.concatenate(hashes), np.concatenate(rows), np.concatenate(offsets)
    del hashes, rows, offsets
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    row, offset = row[twice], offset[twice]
    kept, first = np.unique(row, return_index=True)
    if not len(kept):
        return t[:0]
    low, high = offset[first], offset[np.append(first[1:], len(row)) - 1]
    out = t[kept]
    out["start"] += low.astype(np.uint32)
    out["size"] = high - low + LENGTH
    for k in range(0, len(out), HASHED):
        own = slice(k, k + HASHED)
        at = np.minimum(low[own, None] + np.arange(WIDEST), WIDEST - 1)
        out["text"][own] = np.take_along_axis(out["text"][own], at, axis=1)
    return out


def _arrays(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        yield from _gather(batches, held)
        for b in list(held):
            t = unpack(held.pop(b), _TEXT)
            t = _narrowed(t)
            t = t[np.argsort(t["gram"], kind="stable")]
            edge = np.append(np.flatnonzero(np.diff(t["gram"], prepend=~t["gram"][:1]) != 0), len(t)) if len(t) else np.zeros(1, np.int64)
            a = 0
            while a < len(t):
                e = int(edge[max(np.searchsorted(edge, a + ARRAY, "right") - 1, np.searchsorted(edge, a, "right"))])
                part = t[a:e]
                windows = repeated(part["text"], part["size"], part["doc"], part["start"])
                # Neighbouring windows are one place.
                step = np.diff(np.pad(windows, ((0, 0), (1, 1))).astype(np.int8), axis=1)
                row, first = np.nonzero(step == 1)
                _, last = np.nonzero(step == -1)
                p = np.zeros(len(row), _PLACE)
                p["start"], p["size"], p["kind"] = part["start"][row] + first, last - first + LENGTH - 1, COMPARE
                # The digest of the bytes, so that rows of one id do not take each other's places.
                text = np.ascontiguousarray(part["text"])
                where = row.astype(np.int64) * WIDEST + first
                p["check"] = RollingHash(text.reshape(-1), GEAR).of(where, where + p["size"])
                yield _by_document(part["doc"][row], p, buckets)
                a = e

    return run


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        flat, at = text_buffer(part.column("text"))
        hashes = RollingHash(flat)
        covered = [blobs or [] for blobs in part.column("found").to_pylist()]
        compared = [blobs or [] for blobs in part.column("places").to_pylist()]
        _, _, r, row = _runs_of(part) if any(covered) else (None, None, np.zeros(0, _RUN), np.zeros(0, np.int64))
        done = r[k := _known(part, r, row, covered, COVERED)]
        mark = np.zeros(len(flat) + 1, np.int32)
        begin = at[row[k]] + done["start"]
        np.add.at(mark, begin, 1)
        np.add.at(mark, begin + done["size"], -1)
        for i, blobs in enumerate(compared):
            if blobs:
                p = unpack(blobs, _PLACE)
                begin, end = at[i] + p["start"], at[i] + p["start"] + p["size"]
                ok = end <= at[i + 1]
                begin, end, check = begin[ok], end[ok], p["check"][ok]
                ok = hashes.of(begin, end) == check
                np.add.at(mark, begin[ok], 1)
                np.add.at(mark, end[ok], -1)
        gone = np.cumsum(mark[:-1]) > 0
        kept, spans = [], []
        for i in range(part.num_rows):
            own = gone[at[i] : at[i + 1]]
            kept.append(flat[at[i] : at[i + 1]][~own].tobytes())
            turn = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)) if own.any() else ()
            spans.append([{"start": int(x), "end": int(y)} for x, y in zip(turn[::2], turn[1::2], strict=True)])
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(np.diff(at)), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"]
        )


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes long, spans array<struct<start, end>> (removed bytes, maximal runs), kept binary (the rest) for every document."""
    spark_tasks = tasks(docs.sparkSession)
    buckets = spark_tasks * BUCKETS
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def gathered(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("doc_id").agg(F.collect_list("blob").alias(name))

    found = docs.mapInArrow(_map(buckets), _ROWS_SQL).repartition(spark_tasks, "bucket").mapInArrow(_reduce(buckets), _ROWS_SQL)
    found = materialize(gathered(found, "found"))
    located = docs.join(found, "doc_id", "left")
    dealt = located.filter("found is not null").mapInArrow(_compared(buckets), _ROWS_SQL).repartition(spark_tasks, "bucket")
    places = gathered(dealt.mapInArrow(_arrays(buckets), _ROWS_SQL), "places")
    return located.join(places, "doc_id", "left").mapInArrow(_apply, "doc_id long, n_bytes long, spans array<struct<start: int, end: int>>, kept binary")

