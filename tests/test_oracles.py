"""Every registered query against its SQL, at the smallest scale."""

import check
import pytest

import __spark_entry__ as entry
from loopwright.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return check.duck(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(name, spark, sf_dir, con):
    df = entry.queries()[name](spark, sf_dir)
    assert check.difference(df, con, entry.oracle_sql()[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_has_rows(spark):
    found = entry.entry(spark)
    assert found.columns == ["trace_id", "lang", "n_chars", "label", "_rating"]
    assert found.count() > 0
