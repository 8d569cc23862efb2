"""Decisions of one commit and kind merged over its manifests."""

from codestrata.operators import decisions
from codestrata.plans import catalog

CHANGES = "sha string, manifest string, package string, side string, dev boolean, ecosystem string, initial boolean"
FOLDER = "/root/testdata/sf0.001"


def rows(manifest, added=(), removed=(), sha="c1", initial=False):
    return [(sha, manifest, p, side, False, "pypi", initial) for side, ps in (("added", added), ("removed", removed)) for p in ps]


def test_a_decision_brings_its_packages_along(spark):
    """Merging from the sides of decisions gives what joining the changes again gives."""
    data = (rows("a.txt", ["flask", "zz", "left-pad", "numpy", "redis"]) + rows("b.txt", ["flask", "aa"]) + rows("c.txt", [], ["celery"]) + rows("d.txt", ["django"], ["bottle"])
            + rows("a.txt", ["black", "rq"], sha="c2", initial=True) + rows("b.txt", ["mypy"], sha="c2", initial=True) + rows("a.txt", ["yy"], sha="c3"))
    changes = spark.createDataFrame(data, CHANGES)
    plain, along = decisions.dependency_decisions(changes), decisions.dependency_decisions(changes, sides=True)
    assert sorted(along.columns) == sorted([*plain.columns, "added", "removed"])
    got = sorted(decisions.merge_same_commit(along).collect())
    assert got == sorted(decisions.merge_same_commit(plain, changes).collect())
    subjects = {(r["sha"], r["kind"]): (r["subject"], r["n_manifests"], r["manifest"], r["packages"] is None) for r in got}
    assert subjects == {
        # six packages over three manifests: one added twice counts once
        ("c1", "dependency_change"): ("Adopt flask (web framework), redis (cache), aa, left-pad (and 2 more)", 3, "a.txt, b.txt, c.txt", False),
        ("c1", "dependency_replace"): ("Replace bottle (web framework) with django (web framework)", 1, "d.txt", True),
        ("c2", "initial_stack"): ("Initial technology stack: rq (message queue / jobs), mypy", 2, "a.txt, b.txt", False),
        ("c3", "dependency_change"): ("Adopt yy", 1, "a.txt", True)}


def test_the_changes_are_parsed_once(spark, monkeypatch):
    """The decisions are written before they are merged, and the merge reads nothing but them."""
    written, before = [], decisions.stored
    monkeypatch.setattr(decisions, "stored", lambda df: written.append(df) or before(df))
    merged = catalog.QUERIES["merged_decisions"](spark, FOLDER)
    assert len(written) == 1 and "added" in written[0].columns
    plan = merged._jdf.queryExecution().sparkPlan().toString()
    assert "lineitem" not in plan and "regexp_extract" not in plan and plan.count("FileScan parquet") == 2
