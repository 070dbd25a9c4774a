import pytest


@pytest.fixture
def frame(spark):
    """Documents from (doc_id, text) pairs, with columns whose names clash with those the operators use inside."""

    def make(rows, lang="en", source="s", parts=3):
        schema = "doc_id long, text string, lang string, source string, n_chars long, h long, size long, id long, key string"
        full = [(i, t, lang, source, len(t or ""), 7, 8, 9, "k") for i, t in rows]
        return spark.createDataFrame(full, schema).repartition(parts)

    return make
