import pytest


@pytest.fixture()
def docs(spark):
    """A small table with nulls, empty, repeated and long texts, and extra columns whose names clash with results."""

    def make(rows, schema="doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, size int"):
        return spark.createDataFrame([(i, t, "en", s, len(t or ""), True, 1) for i, t, s in rows], schema)

    return make
