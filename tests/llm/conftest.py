import pytest


@pytest.fixture
def docs_of(spark):
    """A documents table of (doc_id, text) rows, with the other columns of the real one."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")

    return make
