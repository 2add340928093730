"""Toxicity scores from subword bags.

Method: a word's vector is the mean of the vectors of its character n-grams and of itself, hashed into BUCKETS, so that
unseen misspellings share vectors with known words. The vectors of WINDOW consecutive words are averaged and go through a
linear softmax; a text is as toxic as its most toxic window, and every word of it lies in one. (One average of a whole text
would thin a word out by the text's length.) A run of over LONGEST letters (text without blanks) is cut into overlapping
pieces, each a word of the windows.

Vectors and softmax start at random and are trained jointly in numpy, on the driver (Adagrad, weight decay). A text's logit
is a softly greatest one of its windows', from their mean in the first epoch (SHARP) towards the greatest. N-grams of fewer
than SEEN_IN training texts stay at zero: they would learn single texts by heart. Training takes at most PER_LABEL rows of
each label, those with the smallest hashes of their ids, of texts of at most MOST_BYTES; the bias is corrected for the shares
of the labels among all labelled rows.

Defined results: text without a letter or digit scores 0; null text as empty; labels that are null or whose document is
missing teach nothing; a document labelled twice counts as its greater label, one of several texts as its least text; if a label has no rows all scores are 0.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

BUCKETS = 1 << 18
SIZE = 8
WINDOW = 2
#: Most training rows of each label, and most bytes of one.
PER_LABEL = 1200
MOST_BYTES = 1 << 15
SEEN_IN = 2
#: How sharply the greatest window counts, epoch by epoch.
SHARP = (0.0, 1.0, 2.0, 4.0, 6.0, 6.0)
RATE = 0.3
DECAY = 1e-5
BATCH = 48
#: Letters of a word; a longer run is several words, each with the last OVERLAP letters of the one before.
LONGEST = 200
OVERLAP = 5
#: Words kept with their weights, in each Python worker.
CACHE = 300_000

_WORD = re.compile(r"[^\W_]+")


def buckets(word: str) -> list[int]:
    """The word itself and its n-grams of three to six characters, ends marked."""
    marked = f"<{word}>"
    raw, n = zlib.crc32, len(marked)
    found = [raw(marked.encode())]
    for size in (3, 4, 5, 6):
        found += [raw(marked[k : k + size].encode()) for k in range(n - size + 1)]
    return [h & (BUCKETS - 1) for h in found]


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits; longer ones than LONGEST in pieces that overlap, so that every n-gram of them is in one."""
    found = _WORD.findall((text or "").lower())
    if max(map(len, found), default=0) <= LONGEST:
        return found
    return [w[k : k + LONGEST] for w in found for k in range(0, max(len(w) - OVERLAP, 1), LONGEST - OVERLAP)]


def windows(n: int) -> np.ndarray:
    """Starts of the windows over n words; the last one may be shorter."""
    return np.arange(0, n, WINDOW)


class Trainer:
    """Joint stochastic gradient descent (Adagrad) on n-gram vectors and softmax, from random starts."""

    def __init__(self, docs: list[list[str]], labels: list[int], seed: int = 7):
        self.rng = np.random.default_rng(seed)
        index: dict[str, int] = {}
        self.docs = [np.array([index.setdefault(w, len(index)) for w in d], np.int64) for d in docs]
        self.labels = np.array(labels)
        grams = [buckets(w) for w in index]
        self.size = np.array([len(g) for g in grams])
        gram, word = np.array([x for g in grams for x in g], np.int64), np.repeat(np.arange(len(grams)), self.size)
        ends = np.cumsum([0, *self.size])
        seen = np.zeros(BUCKETS, np.int64)
        for d in self.docs:
            seen[np.unique(np.concatenate([gram[ends[w] : ends[w + 1]] for w in np.unique(d)]))] += 1
        live = seen >= SEEN_IN
        # Of each word only the n-grams that learn; the mean is over all of them.
        self.gram, self.at = gram[live[gram]], np.searchsorted(word[live[gram]], np.arange(len(grams) + 1))
        self.vectors = np.where(live[:, None], self.rng.normal(0, 0.1, (BUCKETS, SIZE)), 0).astype(np.float32)
        self.out, self.bias = self.rng.normal(0, 2, (SIZE, 2)).astype(np.float32), np.zeros(2, np.float32)
        self.steps = [np.full((BUCKETS, SIZE), 1e-8, np.float32), np.full((SIZE, 2), 1e-4, np.float32), np.full(2, 1e-2, np.float32)]

    def step(self, rows: np.ndarray, sharp: float) -> None:
        docs = [self.docs[i] for i in rows]
        word, token = np.unique(np.concatenate(docs), return_inverse=True)
        size = self.at[word + 1] - self.at[word]
        of = np.repeat(np.arange(len(word)), size)
        gram = self.gram[np.arange(size.sum()) + np.repeat(self.at[word] - np.cumsum(size) + size, size)]
        used, at = np.unique(gram, return_inverse=True)
        have, share = self.vectors[used], 1 / self.size[word][:, None]
        vector = np.stack([np.bincount(of, have[at, k], len(word)) for k in range(SIZE)], 1) * share
        base = np.cumsum([0, *map(len, docs)])
        start = np.concatenate([b + windows(len(d)) for b, d in zip(base[:-1], docs, strict=True)])
        owner = np.repeat(np.arange(len(docs)), [len(windows(len(d))) for d in docs])
        length = np.diff(start, append=base[-1])
        window = np.add.reduceat(vector[token], start, axis=0) / WINDOW
        logits = window @ self.out + self.bias
        gap = logits[:, 1] - logits[:, 0]
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        pull = np.exp(sharp * (gap - np.maximum.reduceat(gap, first)[owner]))
        pull /= np.add.reduceat(pull, first)[owner]
        score = 1 / (1 + np.exp(-np.clip(np.add.reduceat(pull * gap, first), -50, 50)))
        slope = pull * (score - self.labels[rows])[owner] / len(docs)
        both = np.stack([-slope, slope], 1)
        spread = np.repeat(both @ self.out.T / WINDOW, length, axis=0)
        d_word = np.stack([np.bincount(token, spread[:, k], len(word)) for k in range(SIZE)], 1) * share
        d_vector = np.stack([np.bincount(at, d_word[of, k], len(used)) for k in range(SIZE)], 1) + DECAY * have
        for held, where, d, sums in ((self.vectors, used, d_vector, self.steps[0]), (self.out, slice(None), window.T @ both, self.steps[1]), (self.bias, slice(None), both.sum(0), self.steps[2])):
            sums[where] += d**2
            held[where] -= RATE * d / np.sqrt(sums[where])

    def weights(self) -> tuple[np.ndarray, float]:
        """What each bucket adds to the difference of the two logits, and the difference of the biases."""
        return self.vectors @ (self.out[:, 1] - self.out[:, 0]), float(self.bias[1] - self.bias[0])


def train(rows: list[tuple[str, int]], odds: float = 1.0) -> tuple[np.ndarray, float] | None:
    """rows: (text, label 0 or 1), in a fixed order; odds: by how much label 1 is commoner among them than it should be.

    None if a label has no row with a word."""
    docs = [(w, y) for text, y in rows if (w := words_of(text))]
    if len({y for _, y in docs}) < 2:
        return None
    t = Trainer([w for w, _ in docs], [y for _, y in docs])
    for sharp in SHARP:
        order = t.rng.permutation(len(docs))
        for k in range(0, len(order), BATCH):
            t.step(order[k : k + BATCH], sharp)
    weights, bias = t.weights()
    return weights, bias - float(np.log(odds))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> tuple[np.ndarray, float] | None:
    """labels: (doc_id, label). The chosen ids, of bounded number, are broadcast; their texts, of bounded size, reach the driver."""
    one = labels.select("doc_id", F.col("label").cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = one.filter("label = 0").orderBy(*order).limit(per_label).unionAll(one.filter("label = 1").orderBy(*order).limit(per_label))
    # Of several texts of an id the least one teaches.
    fitting = texts(docs).filter(F.octet_length("text") <= MOST_BYTES)
    found = fitting.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    all_of = {r["label"]: r["n"] for r in one.groupBy("label").agg(F.count("*").alias("n")).collect()}
    taken = {k: min(n, per_label) for k, n in all_of.items()}
    odds = taken.get(1, 1) / all_of.get(1, 1) / (taken.get(0, 1) / all_of.get(0, 1))
    return train([(r["text"], r["label"]) for r in sorted(found.collect(), key=lambda r: r["doc_id"])], odds)


class Scorer:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self.cache: dict[str, float] = {}

    def _weight(self, word: str) -> float:
        found = float(self.weights[buckets(word)].mean())
        if len(self.cache) >= CACHE:
            self.cache.clear()
        self.cache[word] = found
        return found

    def logits(self, text: str | None) -> np.ndarray:
        """One for each window of the whole text."""
        get, weight = self.cache.get, self._weight
        found = np.array([v if (v := get(w)) is not None else weight(w) for w in words_of(text)])
        if not len(found):
            return found
        at = windows(len(found))
        return np.add.reduceat(found, at) / WINDOW + self.bias


def _apply(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model.value) if model.value else None
        for batch in slices(batches):
            scores, where = [], []
            for text in batch.column("text").to_pylist():
                z = scorer.logits(text) if scorer else np.zeros(0)
                k = int(np.argmax(z)) if len(z) else -1
                scores.append(float(1 / (1 + np.exp(-np.clip(z[k], -50, 50)))) if k >= 0 else 0.0)
                where.append(k * WINDOW if k >= 0 else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(where, pa.int64())], ["doc_id", "score", "worst_word"])

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None) -> DataFrame:
    """doc_id, score double, worst_word long (number of the first word of the most toxic window) for every document; no shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInArrow(_apply(docs.sparkSession.sparkContext.broadcast(model)), f"doc_id {kind}, score double, worst_word long")
