import random

import numpy as np

from strandlog.llm import toxicity

RNG = random.Random(4)
PLAIN = ["table", "window", "garden", "river", "music", "letter", "summer", "paper", "travel", "morning", "colour", "bridge"]
BAD = ["stupidity", "worthless", "disgusting", "pathetic"]


def doc(bad):
    w = [RNG.choice(PLAIN) + RNG.choice(["", "s", "ed"]) for _ in range(RNG.randrange(20, 120))]
    for b in bad:
        w.insert(RNG.randrange(len(w)), b)
    return " ".join(w)


def test_learns_words_and_misspellings(spark, table):
    rows = [(k, doc(RNG.sample(BAD, 2) if k % 4 == 0 else [])) for k in range(240)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(160)] + [(500, 1), (None, 1), (3, None)], "doc_id long, label int")
    tests = [(1000 + k, doc(["worthles", "disgustingg"] if k % 2 else [])) for k in range(40)]
    fitted = toxicity.fit(table(rows), labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(table(rows + tests), fitted).collect()}
    held = [(k, k % 4 == 0) for k in range(160, 240)]
    assert all((got[k] >= 0.3) == bad for k, bad in held)
    assert sum((got[1000 + k] >= 0.3) == bool(k % 2) for k in range(40)) >= 38


def test_odd_rows(spark, odd, odd_rows, empty):
    rows = toxicity.score(odd, None).collect()
    assert len(rows) == len(odd_rows) and {r["score"] for r in rows} == {0.0}
    w = toxicity.train([("bad words here", 1), ("good words here", 0), ("", 1)])
    scores = [r["score"] for r in toxicity.score(odd, w).collect()]
    assert all(0 <= s <= 1 for s in scores) and scores[0] == scores[1] == 0
    assert toxicity.score(empty, w).count() == 0
    assert toxicity.fit(odd, spark.createDataFrame([(5, 1)], "doc_id long, label int")) is None


def test_long_runs_are_trained_and_scored_whole(spark, table):
    for n in (1, 199, 200, 201, 205, 206, 395, 396, 1000):
        run = "".join(RNG.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        words = toxicity.words_of(f"one {run} two")
        assert words[0] == "one" and words[-1] == "two" and (words[1:-1] == [run]) == (n <= 200)
        grams = {run[k : k + size] for size in (3, 4, 5, 6) for k in range(n - size + 1)}
        assert all(any(g in w for w in words) for g in grams) and max(map(len, words)) <= 200
        assert {toxicity.zlib.crc32(g.encode()) & (toxicity.BUCKETS - 1) for g in grams} <= {b for w in words for b in toxicity.buckets(w)}
    model = toxicity.train([(doc(RNG.sample(BAD, 2) if k % 2 else []), k % 2) for k in range(120)])
    clean = "".join(PLAIN * 6)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(table([(1, clean), (2, clean + "".join(BAD * 8))]), model).collect()}
    assert got[2] > got[1]


def plain_logit(vectors, out, bias, text):
    """Mean of the windows' logit differences and the greatest, word by word."""
    words = toxicity.words_of(text)
    found = []
    for k in range(0, len(words), toxicity.WINDOW):
        total = [0.0] * toxicity.SIZE
        for w in words[k : k + toxicity.WINDOW]:
            grams = toxicity.buckets(w)
            for j in range(toxicity.SIZE):
                total[j] += sum(float(vectors[g][j]) for g in grams) / len(grams) / toxicity.WINDOW
        logits = [sum(total[j] * float(out[j][c]) for j in range(toxicity.SIZE)) + float(bias[c]) for c in (0, 1)]
        found.append(logits[1] - logits[0])
    return sum(found) / len(found), max(found)


def test_steps_and_scores_equal_plain_ones():
    docs, labels = [doc(RNG.sample(BAD, 1) if k % 2 else []) for k in range(6)], [0, 1] * 3
    t = toxicity.Trainer([toxicity.words_of(d) for d in docs], labels)
    t.steps = [np.full_like(s, 1.0) for s in t.steps]  # steps are then nearly the gradient times the rate
    vectors, out, bias = t.vectors.astype(float), t.out.astype(float), t.bias.astype(float)

    def loss(v):
        z = np.array([plain_logit(v, out, bias, d)[0] for d in docs])
        return float(np.mean(np.log1p(np.exp(-np.where(labels, z, -z)))))

    t.step(np.arange(6), 0.0)
    moved = np.flatnonzero(np.abs(t.vectors - vectors).max(1) > 0)
    for b in RNG.sample(moved.tolist(), 6):
        j, eps = RNG.randrange(toxicity.SIZE), 1e-4
        up, down = vectors.copy(), vectors.copy()
        up[b, j] += eps
        down[b, j] -= eps
        slope = (loss(up) - loss(down)) / (2 * eps) + toxicity.DECAY * vectors[b, j]
        assert abs((vectors[b, j] - t.vectors[b, j]) / toxicity.RATE - slope) < 1e-5
    scorer = toxicity.Scorer(*t.weights())
    for d in docs:
        assert abs(scorer.logits(d).max() - plain_logit(t.vectors, t.out, t.bias, d)[1]) < 1e-3


def test_several_texts_of_an_id_and_long_ones(spark, table):
    rows = [(k, doc(RNG.sample(BAD, 2) if k % 4 == 0 else [])) for k in range(80)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(80)], "doc_id long, label int")
    one = toxicity.fit(table(rows), labels)
    again = [(k, "zz " + t) for k, t in rows[:40]] + [(41, "a" * (toxicity.MOST_BYTES + 1))]
    for order in (rows + again, again + rows[::-1]):
        weights, bias = toxicity.fit(table(order), labels)
        assert np.array_equal(weights, one[0]) and bias == one[1]
