"""Small documents with columns whose names may clash with an operator's own."""

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fixtures import CLASHING, texts  # noqa: E402


@pytest.fixture(scope="session")
def fixture_rows():
    return texts()


@pytest.fixture(scope="session")
def docs(spark, fixture_rows):
    schema = f"doc_id long, text string, {CLASHING}"
    extra = ("en", "s", 1, "r", 0.5, "s", 3, 4, 5, 6, "k", 7, "x")
    rows = fixture_rows[:]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame([(*r, *extra) for r in rows], schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
