import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sig long, row string, found string, found_id long"


@pytest.fixture
def table(spark):
    """A documents table with columns whose names operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, "r", "f", 2) for i, t in rows], SCHEMA)

    return make


#: Nulls, empty and long texts, ties, repeated rows, odd characters.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "The same text. " * 40), (6, "The same text. " * 40), (6, "The same text. " * 40), (7, "é漢字🙂 ß " * 30),
    (8, "x" * 30_000), (9, "word " * 4_000), (None, "no id at all but some words here"), (None, None), (10, "\x00\x01 control"), (11, "one two three"),
]


@pytest.fixture
def odd_rows():
    return ODD


@pytest.fixture
def odd(table):
    return table(ODD)


@pytest.fixture
def empty(table):
    return table([])
