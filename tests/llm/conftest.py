import pytest

EDGE = [
    (1, None, "en", "a"),
    (2, "", "en", None),
    (3, " \n\t ", None, "a"),
    (None, "some words with no id at all", "en", "b"),
    (5, "word " * 3000, "en", "a"),
    (6, "x" * 20000, "de", "a"),
    (7, "the same text twice", "en", "b"),
    (7, "the same text twice", "en", "b"),
    (8, "the same text twice", "de", "b"),
    (9, "Été <|endoftext|> # * 12 ß 漢字 \x1c é", "fr", None),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls everywhere, empty and very long texts, ties, repeated rows, columns whose names clash with results."""
    rows = [(*r, 0, 1.5, "mine", 9) for r in EDGE]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, row string, tid int")


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)
