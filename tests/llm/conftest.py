import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (id, text) or longer tuples."""

    def make(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema)

    return make


#: Columns whose names the operators use themselves.
CLASHES = "doc_id long, text string, id long, n long, region long, score double, source string, lang string, n_chars long"


@pytest.fixture(scope="session")
def clashing(spark):
    return spark.createDataFrame([(1, "under the MIT license now", 7, 7, 7, 0.5, "a", "en", 25), (2, None, None, None, None, None, None, None, None), (3, "", 1, 1, 1, 1.0, "b", "de", 0), (1, "under the MIT license now", 7, 7, 7, 0.5, "a", "en", 25)], CLASHES)
