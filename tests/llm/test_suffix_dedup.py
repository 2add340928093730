import random

import numpy as np

from strandlog.llm import suffix_dedup

RNG = random.Random(6)


def test_suffix_array_against_sorting():
    for _ in range(150):
        n = RNG.randrange(1, 60)
        letters = RNG.choice([b"ab", b"abc", b"a", b"\x00\xffab", b"\xff"])
        t = bytes(RNG.choice(letters) for _ in range(n))
        assert suffix_dedup.suffix_array(np.frombuffer(t, np.uint8), 80).tolist() == sorted(range(n), key=lambda i: t[i:])
    assert len(suffix_dedup.suffix_array(np.zeros(0, np.uint8), 8)) == 0


def brute(rows):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for k in range(len(b) - 99):
            w, at = b[k : k + 100], (i, k)
            first[w] = min(first.get(w, at), at)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            if i is not None and first[b[k : k + 100]] < (i, k):
                gone[k : k + 100] = True
        turn = np.flatnonzero(np.diff(gone.astype(int), prepend=0, append=0))
        out.append((i, len(b), [(int(x), int(y)) for x, y in zip(turn[::2], turn[1::2], strict=True)], np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted([(r["doc_id"], r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in df.collect()], key=repr)


def edited(text):
    t = list(text)
    for _ in range(RNG.randrange(6)):
        t[RNG.randrange(len(t))] = RNG.choice("xyzé")
    return "".join(t)


def test_against_brute_force(table, odd_rows):
    base = ["".join(RNG.choice("abcdé ") for _ in range(RNG.randrange(120, 700))) for _ in range(4)]
    rows = [(k, edited(RNG.choice(base))[RNG.randrange(60) :] + RNG.choice(["", RNG.choice(base), "ab" * RNG.randrange(120)])) for k in range(50, 0, -1)]
    rows += [(i if i is None else i + 100, t) for i, t in odd_rows if len(t or "") < 25_000]
    rows += [(100, base[0]), (100, base[0] + "more"), (100, "shift" + base[0])]  # rows that share an id
    assert rows_of(suffix_dedup.dedup(table(rows))) == brute(rows)


def test_long_runs_of_one_byte(table, empty):
    rows = [(1, "x" * 5000), (2, "x" * 150), (3, "y" * 99), (4, "y" * 99), (5, "z" * 100), (6, "z" * 100)]
    got = {r["doc_id"]: r for r in suffix_dedup.dedup(table(rows)).collect()}
    assert [len(got[i]["kept"]) for i in range(1, 7)] == [1, 0, 99, 99, 100, 0]
    assert suffix_dedup.dedup(empty).count() == 0
