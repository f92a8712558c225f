import pytest


@pytest.fixture
def table(spark):
    """A DataFrame of (doc_id, text, lang, source, n_chars) from texts."""

    def make(texts, start=0):
        rows = [(start + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return make
