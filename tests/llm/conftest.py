"""Small documents with the odd cases that every operator must stand."""

import pytest

WORDS = [f"w{i}" for i in range(400)]


def passage(start, n):
    return " ".join(WORDS[(start * 7 + 3 * k) % 400] for k in range(n))


BASE = passage(1, 60)
#: id, text: nulls, empty, blank, short, copies, near copies, a long text, other scripts, repeated rows.
ROWS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one two"), (6, BASE), (7, BASE), (8, BASE + " tail"), (9, BASE.upper()), (10, passage(2, 60)),
    (11, passage(1, 30) + " " + passage(9, 30)), (12, "Ünïcode ñandú 日本語 text. " * 3), (13, passage(3, 5)), (14, passage(3, 6)), (15, passage(4, 3000)), (16, passage(4, 3000) + " x y z"),
    (17, "<|im_end|> <!| a|b"), (17, "<|im_end|> <!| a|b"), (None, "no id here at all"), (40, "!!! ... 123"), (41, "one two three four five"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """With columns whose names the operators use themselves."""
    rows = [(i, t, "en", "s", len(t or ""), 1, "x", False) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words int, row string, rejected boolean").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")
