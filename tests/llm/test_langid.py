import math
import random
from collections import Counter

import numpy as np

from strandlog.llm import langid

EN = "the quick brown fox jumps over the lazy dog and then the other animals watch what happens there with interest "
DE = "der schnelle braune fuchs springt über den faulen hund und dann sehen die anderen tiere zu was dort geschieht "
FR = "le renard brun rapide saute par dessus le chien paresseux et puis les autres animaux regardent ce qui se passe "


def model(spark):
    rows = [(EN * 5, "en"), (DE * 5, "de"), (FR * 5, "fr"), (None, "en"), ("x", None), ("", "en")]
    return langid.fit(spark.createDataFrame(rows, "text string, lang string"))


def test_single_and_mixed_texts(spark):
    m = model(spark)
    assert [list(m.mixture(t * 3)) for t in (EN, DE, FR)] == [["en"], ["de"], ["fr"]]
    mixed = m.mixture(EN * 4 + FR * 8)
    assert list(mixed) == ["fr", "en"] and 0.55 < mixed["fr"] < 0.8 and abs(sum(mixed.values()) - 1) < 1e-6


def test_counts_equal_a_plain_count(spark):
    m = model(spark)
    plain = np.bincount(langid.codes(DE * 5), minlength=langid.BUCKETS)
    p = (plain + 0.5) / (plain.sum() + 0.5 * langid.BUCKETS)
    assert np.allclose(m.p[m.languages.index("de")], p)


def test_odd_rows(spark, odd, odd_rows, empty):
    m = model(spark)
    rows = langid.predict(odd, m).collect()
    for r, (_, t) in zip(rows, odd_rows, strict=True):
        assert (r["lang_pred"] == "und") == (t is None or not any(c.isalpha() for c in t)) and 0 <= r["score"] <= 1
    kept = langid.identified(odd, m)
    assert kept.columns == odd.columns and sorted(r["text"] for r in kept.collect()) == sorted(t for _, t in odd_rows if t and m.analysis(t)[1] > 0)
    assert langid.identified(empty, m).count() == 0
    nothing = langid.fit(odd.limit(0))
    assert {r["lang_pred"] for r in langid.predict(odd, nothing).collect()} == {"und"}


def plain(counts, text):
    """Expectation-maximisation and the search for the set of languages, n-gram by n-gram."""
    total = {k: sum(v.values()) for k, v in counts.items()}
    grams = Counter(langid.codes(text).tolist())
    n = sum(grams.values())
    p = {k: {g: (counts[k].get(g, 0) + 0.5) / (total[k] + 0.5 * langid.BUCKETS) for g in grams} for k in sorted(counts)}

    def fit(languages, rounds):
        share = dict.fromkeys(languages, 1 / len(languages))
        for _ in range(rounds):
            got = dict.fromkeys(languages, 0.0)
            for g, c in grams.items():
                each = sum(share[k] * p[k][g] for k in languages)
                for k in languages:
                    got[k] += c * share[k] * p[k][g] / each / n
            share = got
        return share, sum(c * math.log(sum(share[k] * p[k][g] for k in languages)) for g, c in grams.items())

    order = sorted(p, key=lambda k: (-fit(list(p), langid.ROUNDS)[0][k], k))
    best = None
    for k in range(1, len(order) + 1):
        share, likely = fit(order[:k], langid.ROUNDS if k > 1 else 0)
        worth = likely - langid.PENALTY * (k - 1) * math.log(n)
        if best and worth <= best[0]:
            break
        best = worth, share, likely / n + math.log(langid.BUCKETS)
    return best[1:]


def test_mixtures_equal_a_plain_search(spark):
    m = model(spark)
    counts = {k: Counter(langid.codes(t * 5).tolist()) for k, t in (("en", EN), ("de", DE), ("fr", FR))}
    counts["en"].update(langid.codes("").tolist())
    rng = random.Random(4)
    for _ in range(40):
        text = " ".join(w for _ in range(rng.randrange(1, 4)) for t in [rng.choice([EN, DE, FR])] for w in rng.sample(t.split(), rng.randrange(1, 12)))
        got, margin = m.analysis(text)
        share, other = plain(counts, text)
        assert set(got) == set(share) and all(abs(got[k] - share[k]) < 1e-6 for k in got) and abs(margin - other) < 1e-6


def test_numerals_are_no_letters_and_ties_go_by_name(spark):
    m = model(spark)
    rows = spark.createDataFrame([(1, "² ½ ①"), (2, "Ⅷ 12"), (3, "ª"), (4, "12 ½ y")], "doc_id long, text string")
    assert [(r["lang_pred"] == "und", r["score"] == 0) for r in langid.predict(rows, m).orderBy("doc_id").collect()] == [(True, True), (True, True), (False, False), (False, False)]
    same = langid.fit(spark.createDataFrame([(EN, "b"), (EN, "a"), (EN, "c")], "text string, lang string"))
    assert next(iter(same.mixture(EN))) == "a"


def test_other_scripts_and_random_letters_are_rejected(spark, table):
    m, rng = model(spark), random.Random(2)
    noise = "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(400))
    russian = "быстрая коричневая лиса прыгает через ленивую собаку и смотрит на других животных"
    docs = table([(1, EN), (2, noise), (3, russian), (4, DE[:60]), (5, None)]).selectExpr("doc_id", "text", "cast(null as string) lang", "source")
    assert sorted((r["doc_id"], r["lang"]) for r in langid.identified(docs, m).collect()) == [(1, "en"), (4, "de")]
