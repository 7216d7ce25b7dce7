import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """``docs_of(texts)``: a documents table, ids from 0, with one extra column whose name clashes with internals."""

    def make(texts, langs=None):
        rows = [(i, t, (langs or ["en"] * len(texts))[i], "src", len(t) if t is not None else None) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")

    return make


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and extra columns named like internals."""
    long = "word and more " * 20000
    rows = [
        (1, None, None, None, None, 1, "x", 0), (None, "a b c d", "en", "s", 7, 2, "y", 0), (None, "a b c d", "en", "s", 7, 2, "y", 0), (None, None, None, None, None, None, None, None),
        (2, "", "en", "s", 0, 3, "z", 1), (3, " \n\t ", "de", "s", 4, 4, "z", 1), (4, long, "en", "s", len(long), 5, "z", 1), (5, long, "fr", "s", len(long), 5, "z", 1),
        (6, "same row\nsame row\nagain", "en", "s", 23, 6, "q", 1), (6, "same row\nsame row\nagain", "en", "s", 23, 6, "q", 1), (7, "é😀 9", "es", "s", 4, 7, "q", 1),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, node bigint, spans string, row bigint")
