import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Builds a documents table from texts or (id, text) pairs, with columns whose names clash with results."""

    def make(rows, ids=None):
        pairs = [(i, t) for i, t in enumerate(rows)] if ids is None else list(zip(ids, rows))
        return spark.createDataFrame([(i, t, "en", "s", 7, -1) for i, t in pairs], DOCS + ", kept long")

    return make
