"""Language identification that allows for several languages in one text.

Method: each language is a multinomial over hashed n-grams of bytes of its lower-cased texts. A document's n-grams are a
mixture of them; expectation-maximisation finds its proportions, and the set of languages is the one with the greatest
likelihood less a penalty for each language. The first language is the one with the greatest proportion.

Counts cover every labelled training row; tasks add them as they stream, and only the vectors reach the driver.

A text's margin is its mean log-likelihood of an n-gram beyond that of chance. Texts without one are in none of the languages.

Defined results: null text and text without a letter are `und` with score and margin 0; without training rows all are `und`; ties go to
the language that sorts first; labels with null text or null language teach nothing; repeated rows give repeated rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import COUNTS, REST, collect_counts, count_batch, count_rows, packed, slices, unpacked, wider

BUCKETS = 1 << 16
#: Languages beyond this many are an error: the model goes to every task.
MOST_LANGUAGES = 256
#: Log-likelihood that a further language must add, as a multiple of log(n-grams); half of it is the usual criterion.
PENALTY = 4.0
ROUNDS = 12

#: Letters, and numerals that are no decimal digits.
_LETTER = re.compile(r"[^\W\d_]")
#: ASCII other than lower-case letters counts as one blank.
_FOLD = bytes(b if b >= 0x80 or 97 <= b <= 122 else 0x20 for b in range(256))
_BLANKS = re.compile(rb" +")


def has_letter(text: str) -> bool:
    """Whether some character is of a letter category (L*)."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def codes(text: str) -> np.ndarray:
    """Buckets of the n-grams (two to four bytes) of one text."""
    raw = np.frombuffer(b" " + _BLANKS.sub(b" ", text.lower().encode().translate(_FOLD)).strip() + b" ", np.uint8).astype(np.uint32)
    out = []
    key = raw.copy()
    for n in (2, 3, 4):
        if len(raw) < n:
            break
        key = key[:-1] * np.uint32(0x01000193) + raw[n - 1 :] + np.uint32(n)
        out.append((key * np.uint32(0x9E3779B1)) >> np.uint32(16))
    return np.concatenate(out).astype(np.uint16) if out else np.zeros(0, np.uint16)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in slices(batches):
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            found = np.bincount(codes(text), minlength=BUCKETS)
            sums[lang] = sums[lang] + found if lang in sums else found
    yield count_batch([r for lang, v in sums.items() for r in count_rows(lang, v)])


class Model:
    def __init__(self, counts: dict[str, np.ndarray], smoothing: float = 0.5):
        if len(counts) > MOST_LANGUAGES:
            raise ValueError(f"{len(counts)} languages; at most {MOST_LANGUAGES} are supported")
        self.languages = sorted(counts)
        self.p = np.array([(counts[k] + smoothing) / (counts[k].sum() + smoothing * BUCKETS) for k in self.languages]).reshape(len(counts), BUCKETS)

    def _fit(self, p: np.ndarray, times: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
        """Proportions after so many rounds of expectation-maximisation, and their log-likelihood."""
        n = times.sum()
        for _ in range(rounds):
            each = share @ p
            share = share * (p @ (times / each)) / n
        return share, float(times @ np.log(share @ p))

    def mixture(self, text: str | None) -> dict[str, float]:
        """Language to proportion, greatest first; empty without a letter."""
        return self.analysis(text)[0]

    def analysis(self, text: str | None) -> tuple[dict[str, float], float]:
        """The mixture, and its mean log-likelihood of an n-gram beyond that of chance (each bucket as likely); 0 without a letter."""
        if not self.languages or not text or not has_letter(text):
            return {}, 0.0
        bucket, times = np.unique(codes(text), return_counts=True)
        p = self.p[:, bucket]
        share, _ = self._fit(p, times, np.full(len(p), 1 / len(p)), ROUNDS)
        order = np.argsort(-share, kind="stable")
        best, found, margin = -np.inf, {}, 0.0
        for k in range(1, len(order) + 1):
            chosen = order[:k]
            own, likely = self._fit(p[chosen], times, np.full(k, 1 / k), ROUNDS if k > 1 else 0)
            worth = likely - PENALTY * (k - 1) * np.log(times.sum())
            if worth <= best:
                break
            best, found = worth, {self.languages[i]: float(s) for i, s in zip(chosen, own, strict=True)}
            margin = likely / times.sum() + float(np.log(BUCKETS))
        return dict(sorted(found.items(), key=lambda x: (-x[1], x[0]))), margin


def fit(rows: DataFrame) -> Model:
    """rows: (text, lang) of the training documents, all of which are counted."""
    rows = rows.select("text", F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null")
    return Model(collect_counts(rows.mapInArrow(_count, COUNTS), BUCKETS))


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in slices(batches):
            found, margins = zip(*map(m.analysis, batch.column("text").to_pylist()), strict=True)
            more = [
                pa.array([list(f) for f in found], pa.list_(pa.string())),
                pa.array([[float(x) for x in f.values()] for f in found], pa.list_(pa.float64())),
                pa.array(margins, pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "languages", "proportions", "margin"])

    return run


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """The columns `keep` of docs (text among them), and languages array<string>, proportions array<double>, margin double
    (see analysis), lang_pred, score."""
    df = docs.select(*keep).mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model)), wider(docs, keep, "languages array<string>, proportions array<double>, margin double"))
    # The greatest proportion is the score; texts without one are undetermined.
    return df.withColumn("lang_pred", F.coalesce(F.try_element_at("languages", F.lit(1)), F.lit("und"))).withColumn("score", F.least(F.lit(1.0), F.coalesce(F.try_element_at("proportions", F.lit(1)), F.lit(0.0))))


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs in some language of the model, with the columns they had; a `lang` that is null becomes the one found.

    Rejected are texts without a letter and those whose n-grams are no likelier under their mixture than by chance: texts in
    other languages or scripts, and random letters.
    """
    rows = predict(packed(docs), model, ("doc_id", "text", REST)).filter("lang_pred <> 'und' and margin > 0").withColumnRenamed("lang_pred", "_found")
    found = unpacked(rows, docs.columns, "_found")
    if "lang" in docs.columns:
        found = found.withColumn("lang", F.coalesce("lang", F.col("_found").cast(docs.schema["lang"].dataType)))
    return found.select(*docs.columns)
