import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of documents with the columns of the tables, and columns that clash with the operators' own."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, id string, score int, `key` string, size string"
        return spark.createDataFrame([(i, t, *(list(more) + [None, None])[:2], None if t is None else len(t), "x", 7, "k", "s") for i, t, *more in rows], schema)

    return make
