"""Every registered query against its SQL twin on the smallest data."""

import pytest

import __spark_entry__ as entry
from codestrata.plans import catalog
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
# run at the larger scale by the oracle command; too slow to repeat in every test run
SLOW = {"evidence_scores", "evidence_sensitivity", "confidence_caps"}


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - SLOW))
def test_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    assert compare(got, duck.execute(entry.oracle_sql()[name]).df()) == ""


def test_every_query_has_a_twin():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() == 5
