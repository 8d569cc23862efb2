"""Manifest changes meet in one exchange, by commit, and keep their meaning on odd versions."""

from codestrata.operators import decisions
from codestrata.plans import catalog
from tests.test_queries import FOLDER

PACKAGES = "sha long, manifest string, package string, dev boolean, ecosystem string"


def test_changes_of_odd_versions(spark):
    after = spark.createDataFrame([(1, "a", "x", False, "pypi"), (1, "b", "x", True, "pypi"), (2, "a", "x", None, "npm"), (2, "a", "y", False, "npm")], PACKAGES)
    before = spark.createDataFrame([(2, "a", "x", True, "npm"), (3, "a", "z", False, "pypi")], PACKAGES)
    got = {tuple(r) for r in decisions.manifest_changes(after, before).collect()}
    assert got == {(1, "a", "x", "added", False, "pypi", True), (1, "b", "x", "added", True, "pypi", True),
                   (2, "a", "y", "added", False, "npm", False), (3, "a", "z", "removed", False, "pypi", False)}


def test_few_exchanges_and_narrow_keys(spark):
    plan = catalog.QUERIES["dependency_decisions"](spark, FOLDER)._jdf.queryExecution().sparkPlan().toString()
    planned = catalog.QUERIES["dependency_decisions"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 2  # the lines are parsed once, and looked up once for the parents
    assert not [line for line in planned.splitlines() if "Exchange hashpartitioning" in line and "sha1(" in line]
    assert planned.count("Exchange hashpartitioning") <= 4
