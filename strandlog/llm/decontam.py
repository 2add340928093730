"""Benchmark decontamination: which words of each document lie in windows of benchmark items.

Method: each benchmark word becomes one character, each window of n consecutive words one pattern, and one Aho-Corasick
automaton over all patterns reads every document once. Positions in the automaton are word numbers, which map back to
character offsets of the original text. No shuffle: documents pass through in their own partitions.

The benchmark is read in blocks of at most BLOCK_BYTES of text, each broadcast on its own; more blocks mean more passes
in one chain, so that no broadcast grows with the benchmark.

Defined results: null text has no words; an item without words has no window; an item of fewer than n words is one window;
items with equal text all count; several items of one id count once, those without an id as one item whose entry in `items`
is null, last, and whose windows hit words like others; repeated documents give repeated rows.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import REST, packed, slices, unpacked, wider

BLOCK_BYTES = 1 << 20

# Fixed by the contract: A-Z is lower-cased, and these bytes separate words.
_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_PLAIN = bytes(0x20 if b in _SEPARATORS else b for b in range(256))
_TABLE = bytes(_PLAIN[_FOLD[b]] for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


class _Symbols(dict):
    def __missing__(self, word: bytes) -> str:
        return " "


class Scanner:
    """The automaton of one block of (item_id, text)."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int):
        self.symbol = _Symbols()
        owners: dict[str, set[str | None]] = defaultdict(set)
        for item, text in items:
            own = "".join([self._new(w) for w in words_of(text)])
            for k in range(max(len(own) - n, 0) + 1):
                if own:
                    owners[own[k : k + n]].add(item)
        self.automaton = ahocorasick.Automaton()
        for pattern, who in owners.items():
            self.automaton.add_word(pattern, (len(pattern), tuple(who)))
        self.automaton.make_automaton()
        self.any = bool(owners)

    def _new(self, word: bytes) -> str:
        if word not in self.symbol:
            k = 0x100 + len(self.symbol)
            self.symbol[word] = chr(k if k < 0xD800 else k + 0x800)
        return self.symbol[word]

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str | None]]:
        """Runs [first, end) of hit words, in order and apart, and the ids of items with a window there."""
        runs: list[list[int]] = []
        items: set[str | None] = set()
        if self.any:
            for at, (size, who) in self.automaton.iter("".join(map(self.symbol.__getitem__, words))):
                start = at + 1 - size
                items.update(who)
                while runs and start <= runs[-1][1]:  # windows come by their ends; a longer one may reach over earlier runs
                    start = min(start, runs.pop()[0])
                runs.append([start, at + 1])
        return runs, items


def _merged(runs: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


_WORD = re.compile(rb"[^ \t-\r]+")


def _offsets(text: str, runs: list[list[int]]) -> list[dict[str, int]]:
    """Character offsets in the original text of runs of words."""
    raw = text.encode()
    spans = [m.span() for m in _WORD.finditer(raw.translate(_TABLE))]
    starts = [0]
    for ch in text:
        starts.append(starts[-1] + len(ch.encode()))
    return [{"start": bisect_right(starts, spans[a][0]) - 1, "end": bisect_right(starts, spans[b - 1][1]) - 1} for a, b in runs]


_scanners: dict[str, Scanner] = {}


def _pass(items, n: int, key: str, last: bool):
    """One block's pass over the documents; `last` also derives the results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanners.get(key)
        if scanner is None:
            _scanners.clear()
            scanner = _scanners[key] = Scanner(items.value, n)
        for batch in slices(batches, 4 << 20):
            out = []
            for text, old, found in zip(*(batch.column(c).to_pylist() for c in ("text", "runs", "items")), strict=True):
                words = words_of(text)
                runs, who = scanner.scan(words)
                if old:
                    runs = _merged([*map(list, zip(old[::2], old[1::2], strict=True)), *runs])
                out.append((len(words), runs, sorted({*found, *who}, key=lambda x: (x is None, x or ""))))
            more = [pa.array([[x for r in runs for x in r] for _, runs, _ in out], pa.list_(pa.int32())), pa.array([w for *_, w in out], pa.list_(pa.string()))]
            if last:
                more += [
                    pa.array([w for w, *_ in out], pa.int64()),
                    pa.array([sum(b - a for a, b in runs) for _, runs, _ in out], pa.int64()),
                    pa.array([_offsets(t, runs) if runs else [] for t, (_, runs, _) in zip(batch.column("text").to_pylist(), out, strict=True)], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                ]
            kept = [k for k in range(batch.num_columns) if batch.schema.names[k] not in ("runs", "items")]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in kept] + more, [batch.schema.names[k] for k in kept] + ["runs", "items"] + ["n_words", "n_hit", "spans"] * last)

    return run


def _blocks(items: DataFrame) -> list[list[tuple[str | None, str | None]]]:
    """The benchmark, a block of bounded size at a time."""
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("b")).first()["b"] or 0
    n = -(-int(size) // BLOCK_BYTES) or 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        yield [tuple(r) for r in (items.filter(block == k) if n > 1 else items).collect()]


def scan(docs: DataFrame, items: DataFrame, n: int = 13, keep: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """The columns `keep` of docs (text among them), and n_words long, n_hit long, items array<string> (ids, sorted), spans
    array<struct<start, end>> (characters of the original text that hit words reach over), runs array<int> (word numbers).

    items: (item_id, text).
    """
    spark = docs.sparkSession
    blocks = list(_blocks(items))
    df = docs.select(*keep).withColumns({"runs": F.array().cast("array<int>"), "items": F.array().cast("array<string>")})
    base = "runs array<int>, items array<string>"
    for k, block in enumerate(blocks):
        last = k == len(blocks) - 1
        df = df.mapInArrow(_pass(spark.sparkContext.broadcast(block), n, uuid.uuid4().hex, last), wider(docs, keep, base + ", n_words long, n_hit long, spans array<struct<start: int, end: int>>" * last))
    return df


#: A document is contaminated if some word is hit, and hit words are at least one in this many.
SHARE = 20


def contaminated(share: int = SHARE):
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))


def clean(docs: DataFrame, items: DataFrame, n: int = 13) -> DataFrame:
    """The rows of docs that are not contaminated, with the columns they had."""
    return unpacked(scan(packed(docs), items, n, ("doc_id", "text", REST)).filter(~contaminated()), docs.columns)
