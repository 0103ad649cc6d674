"""Every query with an SQL text gives the same rows as that text."""

import importlib

import oracle
import pytest
from conftest import MEDIUM, SMALL

ENTRY = importlib.import_module("__spark_entry__")
QUERIES, SQL = ENTRY.queries(), ENTRY.oracle_sql()
ON_MEDIUM = {"i9_j7", "i11_n1", "h4_one_hot", "e6_column_std", "h1_label_encode", "i8_j6"}


@pytest.fixture(scope="module")
def small():
    return oracle.connect(SMALL)


@pytest.fixture(scope="module")
def medium():
    return oracle.connect(MEDIUM)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, small, medium, name):
    sf, con = (MEDIUM, medium) if name in ON_MEDIUM else (SMALL, small)
    assert oracle.differences(QUERIES[name](spark, sf), con, SQL[name]) == []


def test_entry(spark):
    df = ENTRY.entry(spark)
    assert df.columns == ["fold", "kappa"]
    assert df.count() == 5


def test_texts_belong_to_queries():
    assert set(SQL) <= set(QUERIES)
