"""Every registered corpus query: against its SQL twin, or there is a brute-force test of it in this folder."""

import pytest

import __spark_entry__ as entry
from codestrata.llm import catalog
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
BRUTE = {"op1_packing", "op3_sharding", "op6_classifier", "op8_tokens", "op12_brown"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, name):
    got = catalog.QUERIES[name](spark, FOLDER).toPandas()
    assert compare(got, connect(FOLDER).execute(catalog.ORACLES[name]).df()) == ""


def test_all_are_registered():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == BRUTE
    assert {*catalog.QUERIES, "pipeline"} <= set(entry.queries())
    assert [n.split("_")[0] for n in catalog.QUERIES] == [f"op{i}" for i in range(1, 14)]
