import pytest


@pytest.fixture
def docs(spark):
    """A table of (doc_id, text) rows with a column whose name could clash."""

    def make(rows):
        return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, rep string")

    return make
