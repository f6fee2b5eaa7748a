"""Every registered query against its SQL oracle."""

import pytest
from check import compare, duck
from conftest import SF

import __spark_entry__ as entry
from fieldgauge.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, con, name):
    msg, _, ok = compare(spark, con, SF, name, QUERIES[name], ORACLES.get(name))
    assert ok is not False, msg
    assert "types" not in msg, msg


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 9


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())
