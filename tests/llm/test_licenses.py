import os

import duckdb
import pytest

from strandlog.llm import licenses


def test_texts_are_found_in_other_dress(spark, table, odd_rows, empty):
    mit = licenses.TEXTS["MIT"]
    dressed = "Copyright (c) 2024 Some One\n\n" + mit.upper().replace(",", " ,").replace("\n", "\r\n").replace("COPYRIGHT HOLDERS", "copyright owner")
    rows = odd_rows + [(20, dressed), (21, mit + " and more"), (22, "Intro\nReleased under the MIT License.\n  licensed under CC BY-NC 4.0\n"), (23, licenses.TEXTS["Zlib"].replace("acknowledgment", "acknowledgment "))]
    got = {r["doc_id"]: (r["license_id"], list(r["notices"])) for r in licenses.scan(table(rows)).collect()}
    assert got[20] == ("MIT", []) and got[21] == (None, []) and got[22] == (None, ["CC-BY-NC-4.0", "MIT"]) and got[23][0] == "Zlib"
    assert all(got[i] == (None, []) for i, _ in odd_rows)
    assert licenses.scan(table(rows)).count() == len(rows) and licenses.scan(empty).count() == 0


def test_every_known_text_finds_itself(spark, table):
    rows = list(enumerate([*licenses.TEXTS.values(), *licenses.NOTICES.values()]))
    ids = [*licenses.TEXTS, *licenses.NOTICES]
    found = licenses.scan(table(rows)).collect()
    assert {r["doc_id"]: r["license_id"] for r in found} == dict(enumerate(ids))
    assert all(i in r["blocks"] for r in found for i in [ids[r["doc_id"]]] if r["doc_id"] < len(licenses.TEXTS))


FOLDER = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no public licence texts here")
def test_long_texts_are_found_whole_and_inside_others(table):
    names = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "LGPL-2.1": "LGPL-2.1"}
    texts = {i: open(f"{FOLDER}/{f}", encoding="utf-8").read() for f, i in names.items()}
    rows = []
    for k, (_, t) in enumerate(texts.items()):
        rows += [(10 * k, t), (10 * k + 1, "\n".join("# " + line.strip() for line in t.upper().split("\n"))), (10 * k + 2, f"A readme of many words.\n{t}\nAnd more.\nSPDX-License-Identifier: MIT"), (10 * k + 3, t[: len(t) * 2 // 3])]
    got = {r["doc_id"]: (r["license_id"], list(r["blocks"]), list(r["notices"])) for r in licenses.scan(table(rows)).collect()}
    for k, i in enumerate(texts):
        assert got[10 * k][0] == got[10 * k + 1][0] == i
        assert got[10 * k][1] == got[10 * k + 1][1] == got[10 * k + 2][1] and i in got[10 * k][1]
        assert got[10 * k + 2][0] is None and got[10 * k + 2][2] == ["MIT"]
        assert got[10 * k + 3][0] is None and i not in got[10 * k + 3][1]


def test_list_items_are_no_copyright_lines(spark):
    rows = spark.createDataFrame([("(c) You must keep it\ncopyright notices stay\n * Copyright (c) 2020 A\n(c) 2021 B\n// Copyright 1999-2001 C\n© D\nend",)], "text string")
    assert rows.select(licenses.canonical(rows.text)).first()[0] == "c you must keep it copyright notices stay end"


def test_the_sql_agrees_on_planted_texts(spark, table):
    rows = [(k, t) for k, t in enumerate([*licenses.TEXTS.values(), "", None, "Intro\n" + licenses.TEXTS["Zlib"] + " " + licenses.TEXTS["ISC"], "x\n-- SPDX-License-Identifier: GPL-2.0-only --"])]
    got = licenses.scan(table(rows)).selectExpr("doc_id", "digest", "license_id", "array_join(blocks, ',')", "array_join(notices, ',')").collect()
    c = duckdb.connect()
    c.execute("create table documents(doc_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", rows)
    other = c.execute(f"select doc_id, digest, license_id, blocks, notices from ({licenses.oracle_sql()})").fetchall()
    assert sorted(map(tuple, got)) == sorted(other) and [r[3] for r in sorted(other)][-2] == "ISC,Zlib"


def test_no_python_runs(spark, odd):
    plan = licenses.scan(odd)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_own_table(spark, table):
    known = spark.createDataFrame([("own", "My Licence"), ("none", None), ("blank", "...")], "license_id string, text string")
    got = licenses.scan(table([(1, "MY  license!"), (2, "")]), known, {}).orderBy("doc_id").collect()
    assert [r["license_id"] for r in got] == ["own", None]


def test_padded_lines_and_own_notices_are_found(table):
    padded = "/* " + "*" * 300 + " Released under the MIT License. " + "." * 300 + " */"
    got = licenses.scan(table([(1, f"first\n{padded}\nlast")])).collect()
    assert [list(r["notices"]) for r in got] == [["MIT"]]
    own = licenses.scan(table([(1, "a\n-- Free for all uses! --"), (2, "free for all")]), None, {"own": "Free for all uses."}).orderBy("doc_id").collect()
    assert [list(r["notices"]) for r in own] == [["own"], []]
