"""Quality rules: counts over each whole text, and a log-likelihood ratio of hashed n-grams.

Method: words and pairs of consecutive words are hashed into BUCKETS. One multinomial is estimated from trusted target
documents, one from the whole raw corpus; a document's score is the mean log ratio of its n-grams under the two, and every
document meets one fixed threshold. Raw counts cover all documents, target counts all trusted ones, which a shuffle join on
doc_id finds.

Defined results: null and empty text have zero counts and score 0; repeated rows give repeated rows; without trusted
documents or without any document all scores are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import COUNTS, GEAR_FOLDED, SPACE, RollingHash, collect_counts, count_batch, count_rows, grams, mix, slices, text_buffer, texts, words

BUCKETS = 1 << 16
#: Least mean log ratio of a document that is kept.
THRESHOLD = -0.12
#: N-grams of the raw corpus that the target counts besides its own, for each bucket: what few trusted documents lack is not
#: held against others. With many it has no weight.
PRIOR = 4.0

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_INK = np.array([not SPACE[b] and b & 0xC0 != 0x80 for b in range(256)]).astype(np.int64)


def _per_row(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


def _features(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and word pairs, and their rows."""
    pairs, first = grams(h, row, 2)
    return (np.concatenate([mix(h), pairs]) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([row, row[first]])


def _hashed(batch: pa.RecordBatch):
    flat, at = text_buffer(batch.column("text"))
    start, end, row = words(flat, at)
    return flat, at, start, end, row, RollingHash(flat, GEAR_FOLDED).of(start, end)


def _count(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, np.int64)
        for batch in slices(batches):
            *_, row, h = _hashed(batch)
            sums += np.bincount(_features(h, row)[0], minlength=BUCKETS)
        yield count_batch(count_rows(name, sums))

    return run


def ratios(docs: DataFrame, trusted: DataFrame, prior: float = PRIOR) -> np.ndarray:
    """The log ratio of each bucket: all of docs is the raw corpus, those whose doc_id is in `trusted` are the target.

    0 for buckets that the raw corpus does not have."""
    target = texts(docs).join(trusted.select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_semi")
    both = [df.select("text").mapInArrow(_count(name), COUNTS) for name, df in (("raw", docs), ("target", target))]
    counts = collect_counts(both[0].unionAll(both[1]), BUCKETS)
    if "target" not in counts:
        return np.zeros(BUCKETS)
    target, raw = counts["target"], counts["raw"]
    q = raw / max(raw.sum(), 1)
    p = (target + prior * BUCKETS * q) / (target.sum() + prior * BUCKETS)
    return np.log(p, where=raw > 0, out=np.zeros(BUCKETS)) - np.log(q, where=raw > 0, out=np.zeros(BUCKETS))


def _repeated(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in windows of n words that their row has twice or more."""
    mark = np.zeros(len(h), bool)
    key, first = grams(h, row, n)
    if len(key):
        _, which, times = np.unique(mix(key + mix(row[first].astype(np.uint64))), return_inverse=True, return_counts=True)
        again = first[times[which] > 1]
        for k in range(n):
            mark[again + k] = True
    return mark


def _line_copies(flat: np.ndarray, at: np.ndarray, word_start: np.ndarray, hashes: RollingHash) -> np.ndarray:
    """For each row the lines with a word that equal an earlier line of it."""
    n = len(at) - 1
    breaks = np.flatnonzero(flat == 10)
    of = np.searchsorted(at, breaks, "right") - 1
    start, row = np.concatenate([at[:-1], breaks + 1]), np.concatenate([np.arange(n), of])
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    end = np.concatenate([np.where(row[1:] == row[:-1], start[1:] - 1, at[row[:-1] + 1]), at[row[-1:] + 1]]) if n else start
    inked = np.searchsorted(word_start, end) > np.searchsorted(word_start, start)
    start, end, row = start[inked], end[inked], row[inked]
    once = np.unique(mix(hashes.of(start, end) + mix(row.astype(np.uint64))), return_index=True)[1]
    return np.bincount(row, minlength=n) - np.bincount(row[once], minlength=n)


def _apply(ratio):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ratio.value
        for batch in slices(batches):
            flat, at, start, end, row, folded = _hashed(batch)
            n = batch.num_rows
            exact = RollingHash(flat)
            h = exact.of(start, end)
            bucket, of = _features(folded, row)
            size = np.bincount(of, minlength=n)
            llr = np.bincount(of, table[bucket], n) / np.maximum(size, 1)
            found = [
                np.bincount(row, minlength=n),
                _per_row(_INK[flat], at),
                _per_row(_SYMBOL[flat], at),
                _line_copies(flat, at, start, exact),
                np.bincount(row[_repeated(h, row, 5)], minlength=n),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v.astype(np.int64)) for v in found), pa.array(llr)], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr"])

    return run


def score(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept for every document.

    trusted: the doc_ids of trusted documents. Three reads of the texts, one shuffle of them.
    """
    table = docs.sparkSession.sparkContext.broadcast(ratios(docs, trusted))
    kind = docs.schema["doc_id"].dataType.simpleString()
    df = texts(docs).mapInArrow(_apply(table), f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return df.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
