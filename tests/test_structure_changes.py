"""Module groups that appear or vanish, from one count of files by folder."""

from pyspark.sql import functions as F

from codestrata.operators import detection


def test_groups_nested_and_hot_folders(spark):
    modules = [(0, f"src/a/m{i}.py") for i in range(3)] + [(1, f"src/b/m{i}.py") for i in range(4)] + [(1, "src/b/deep/x.py"), (0, "tool/one.py"), (1, "tool/one.py")]
    touched = [(f"c{i}", 5 + i, i, f"src/b/m{i}.py", "A") for i in (2, 0, 1)] + [("c9", 9, 1, "src/a/m1.py", "D"), ("c8", 3, 1, "src/a/m0.py", "D")]
    frames = (spark.createDataFrame(modules, "idx long, path string"), spark.createDataFrame(touched, "hash string, pos long, ord int, path string, status string"),
              spark.createDataFrame([(0, 4), (1, 10)], "idx long, pos long"))
    found = detection.structure_decisions(*frames, F.lit(False))
    rows = sorted((r["sha"], r["subject"], r["n_files"]) for r in found.collect())
    assert rows == [("c0", "Introduce the src/b/ module group (5 modules)", 5), ("c9", "Remove the src/a/ module group (3 modules)", 3)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("min_by(hash") == 1 and "LeftSemi" not in plan  # grouped inside the tasks before folders are met
    assert detection.structure_decisions(*frames, F.col("path").contains("/b/")).count() == 1
