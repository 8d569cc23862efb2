"""Violations that come and go: one deal for the differences, rows only for counts that change."""

from pyspark.sql import functions as F

from codestrata.operators import detection, temporal

VERSIONS = "hash string, pos long, idx long, path string, content string"


def test_only_changed_counts_become_rows(spark):
    names = [f"n{i}_" for i in range(40)]
    versions = spark.createDataFrame([(f"c{i}", i, 0, "f", names[i // 4] + " text") for i in range(40)] + [("d", 41, 0, "f", None), ("e", 42, 0, "g", "n1_")], VERSIONS)
    needles = spark.createDataFrame([("f", n) for n in names], "path string, needle string")
    found = detection.needle_changes(versions, needles)
    want = sorted([(names[i], f"c{4 * i}") for i in range(10)] + [(names[i], f"c{4 * i + 4}") for i in range(9)] + [(names[9], "d")])
    assert sorted((r["needle"], r["hash"]) for r in found.collect()) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Window")  # rows of needles are made after versions are compared


def test_differences_in_one_deal(spark):
    rows = [(k, i) for k, held in (("a", (0, 1, 3)), ("b", (2,)), ("c", (3,)), ("d", (0, 1, 2, 3)), (None, (1,))) for i in held] * 2
    presence = spark.createDataFrame(rows, "k string, idx long")
    found = temporal.diffs(presence, ["k"], spark.createDataFrame([(3,)], "last long"))
    assert found.columns == ["k", "idx", "change"] and dict(found.dtypes)["idx"] == "bigint"
    assert sorted(map(tuple, found.collect()), key=str) == sorted([
        ("a", 2, "removed"), ("a", 3, "added"), ("b", 2, "added"), ("b", 3, "removed"), ("c", 3, "added"), (None, 1, "added"), (None, 2, "removed")], key=str)
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_versions_are_grouped_without_sorting(spark):
    from codestrata.plans import detection as plans
    from codestrata.plans.tables import Tables

    plan = plans.versions(Tables(spark, "/root/testdata/sf0.001")).select(F.col("pos"), "content")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
