import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Schema of documents with a column whose name clashes with results, nulls everywhere, empty texts, repeats."""

    def make(rows):
        return spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lang string, source string, score int")

    return make
