"""Small tables for the tests of text operators."""

import pytest
from texts import DOCUMENTS, ODD_TEXTS


@pytest.fixture
def make(spark):
    def build(rows):
        """Documents from (doc_id, text[, lang[, source]]) rows."""
        full = [tuple(row) + (None,) * (4 - len(row)) for row in rows]
        return spark.createDataFrame([(*row, len(row[1]) if row[1] else None) for row in full], DOCUMENTS)

    return build


@pytest.fixture
def odd(make):
    rows = [(i, text, "en", "s") for i, text in enumerate(ODD_TEXTS)]
    return make(rows + rows[:4] + [(None, "null id here", None, None), (None, None, None, None), (None, "null id here", None, None), (3, "another text of id three", "fr", None)])


@pytest.fixture
def sample(spark, testdata):
    return spark.read.parquet(f"{testdata}/sf0.001/documents.parquet")
