import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents from texts or (doc_id, text, lang, source) rows, with extra columns whose names clash with inner ones."""

    def make(rows):
        rows = [(k, x, "en", "s", 0) if not isinstance(x, tuple) else (*x, 0) for k, x in enumerate(rows)]
        return spark.createDataFrame(rows, DOCUMENTS).selectExpr("*", "1 as digest", "'x' as keep_id", "2.5 as mix_key", "'y' as copy", "0 as fp", "'z' as words", "3 as score")

    return make
