"""Every registered query against its SQL on the smallest data."""

import pytest

import __spark_entry__ as entry
from tablecraft.checks.compare import compare, connect

SMALL = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    outcome = compare(spark, duck, SMALL, QUERIES[name], ORACLES.get(name))
    assert outcome.startswith("ok") or (name not in ORACLES and outcome.startswith("rows"))


def test_every_sql_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
