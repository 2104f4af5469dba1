import pytest


@pytest.fixture
def docs_of(spark):
    """A documents table from (doc_id, text) or (doc_id, text, lang, source) rows,
    with columns whose names clash with those of results."""
    def make(rows):
        full = [(*r, *[None] * (4 - len(r)), len(r[1] or ""), 7.0, "x", -1) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score double, cls string, taken long")
    return make
