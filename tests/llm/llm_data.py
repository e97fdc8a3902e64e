import pytest

from strainwise.llm.common import arrow_limits

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, row string, v string"


@pytest.fixture()
def docs(spark):
    """Documents from (id, text) pairs, with extra columns whose names clash with internal ones."""
    arrow_limits(spark)

    def make(pairs, source="s"):
        rows = [(i, t, "en", source, None if t is None else len(t), "x", "y", "z") for i, t in pairs]
        return spark.createDataFrame(rows, DOCS)

    return make
