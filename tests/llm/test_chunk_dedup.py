import random

import pyarrow as pa

from strandlog.llm import chunk_dedup

RNG = random.Random(8)
VOCAB = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in ("n", "st", "ring", "é", "tion")]


def prose(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


def pieces(text):
    flat, _, start, end, *_ = chunk_dedup._chunks(pa.array([text], pa.string()))
    return [flat.tobytes()[a:b] for a, b in zip(start, end, strict=True)]


def brute(rows, least):
    seen, out = {}, {}
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    for i, text in order:
        at = 0
        for c in pieces(text):
            seen.setdefault(c, (i, at))
            at += len(c)
    for k, (i, text) in enumerate(rows):
        at, kept, run = 0, b"", []
        for c in [*pieces(text), None]:
            if c is not None and i is not None and seen[c] != (i, at):
                run.append(c)
            else:
                if sum(map(len, run)) < least:
                    kept += b"".join(run)
                run = []
                kept += c or b""
            at += len(c or b"")
        out[k] = (i, None if text is None else kept.decode())
    return sorted(out.values(), key=repr)


def test_against_brute_force(table, odd_rows):
    shared = [prose(60), prose(90)]
    rows = [(k, prose(RNG.randrange(5, 120)) + " " + RNG.choice([*shared, ""]) + " " + prose(RNG.randrange(30))) for k in range(60, 20, -1)] + odd_rows
    got = sorted([(r["doc_id"], r["text"]) for r in chunk_dedup.dedup(table(rows)).collect()], key=repr)
    assert got == brute(rows, chunk_dedup.LEAST)


def test_passages_go_and_clean_texts_stay(table):
    passage = prose(60)
    clean = [(k, prose(200)) for k in range(20)]
    rows = clean + [(100 + k, prose(50) + " " + passage + " " + prose(50)) for k in range(10)]
    got = {r["doc_id"]: r for r in chunk_dedup.dedup(table(rows)).collect()}
    assert all(got[i]["text"] == t for i, t in clean) and got[100]["text"] == rows[20][1]
    for k in range(101, 110):
        gone = sum(s["end"] - s["start"] for s in got[k]["spans"])
        assert gone >= len(passage.encode()) // 2 and passage[100:-100] not in got[k]["text"]


def test_cuts_resist_insertions():
    text = prose(600)
    other = text[:900] + " inserted words " + text[900:]
    a, b = set(pieces(text)), set(pieces(other))
    assert len(a & b) >= len(a) - 4 and b"".join(pieces(text)).decode() == text


def test_neighbours_do_not_matter():
    rows = [prose(50), "", prose(80), None, prose(5)]
    flat, at, start, end, row, *_ = chunk_dedup._chunks(pa.array(rows, pa.string()))
    raw = flat.tobytes()
    for k, t in enumerate(rows):
        assert [raw[a:b] for a, b, r in zip(start, end, row, strict=True) if r == k] == pieces(t)


def test_empty(empty):
    assert chunk_dedup.dedup(empty).count() == 0


def test_text_without_blanks_is_cut_too(table):
    for letters in ("abcdefghijklmnopqrstuvwxyz0123456789+/", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "漢字仮名交文🙂é"):
        run = lambda n: "".join(RNG.choice(letters) for _ in range(n))  # noqa: E731, B023
        passage = run(600)
        rows = [(k, run(700) + passage + run(500)) for k in range(6)]
        assert all(chunk_dedup.REACH < len(c) <= chunk_dedup.MOST for c in pieces(rows[0][1])[1:-1])
        got = {r["doc_id"]: r["text"] for r in chunk_dedup.dedup(table(rows)).collect()}
        assert got[0] == rows[0][1]
        for k in range(1, 6):
            assert passage[150:-150] not in got[k] and got[k].startswith(rows[k][1][:600]) and got[k].endswith(rows[k][1][-400:])


def test_a_character_that_goes_on(table):
    for c in "x漢":
        found = pieces(c * 5000)
        assert max(map(len, found)) <= chunk_dedup.MOST and b"".join(found).decode() == c * 5000
    # The same stretch in two documents, not at the same distance from their beginnings.
    rows = [(1, prose(30) + " " + "=" * 3000 + " " + prose(30)), (2, prose(45) + " " + "=" * 3000 + " " + prose(9))]
    got = {r["doc_id"]: r["text"] for r in chunk_dedup.dedup(table(rows)).collect()}
    assert got[1].count("=") < 200 and got[2].count("=") < 200
    assert chunk_dedup.dedup(table([(3, "For " * 900 + prose(20))])).first()["text"].count("For") < 60
