"""Every registered query against its DuckDB oracle, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check_oracles import compare, duck


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


OWN = sorted(set(entry.queries()) - set(entry.llm.queries() if entry.llm else ()))


def test_every_query_has_an_oracle():
    assert set(OWN) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", OWN)
def test_query(spark, con, sf_dir, name):
    note = compare(spark, con, sf_dir, name)
    assert note.startswith("="), note


def test_entry(spark):
    assert entry.entry(spark).count() > 0
