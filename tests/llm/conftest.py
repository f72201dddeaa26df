"""Small document tables with the awkward cases every operator must take."""

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, label string, kept string, own int"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) pairs, with extra columns whose names clash with inner ones."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", 1) for i, t in rows], DOC).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null id, null text, empty, blanks, one word, a very long text, repeated rows, non-ASCII text."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return [(None, "a row without an id"), (1, None), (2, ""), (3, " \t\n "), (4, "word"), (5, long), (6, "né à Zürich 漢字 😀 ok"),
            (7, "same text in two rows here"), (7, "same text in two rows here"), (8, long)]
