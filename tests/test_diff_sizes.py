"""Sizes of changed files, counted where their hunks are."""

from pyspark.sql import functions as F

from codestrata.operators import review
from codestrata.sources import gitlog

TEXT = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,3 @@\n keep\n-old\n+new\n+++ more\n\n@@ -9 +9 @@\n+tail\n\\ No newline at end of file\n"
EMPTY = "diff --git a/y.py b/y.py\n--- a/y.py\n+++ b/y.py\n"


def test_sizes_of_files_whose_keys_repeat(spark):
    texts = spark.createDataFrame([(1, TEXT), (1, TEXT), (2, EMPTY), (3, TEXT + EMPTY)], "k long, diff string")
    sized = gitlog.with_sizes(gitlog.diff_files(texts, ["k"]))
    rows = sorted((r["k"], r["section"], r["path"], r["n_added"], r["n_chars"]) for r in sized.collect())
    assert rows == [(1, 0, "x.py", 3, 21), (1, 0, "x.py", 3, 21), (2, 0, "y.py", 0, 0), (3, 0, "x.py", 3, 21), (3, 1, "y.py", 0, 0)]
    assert [r["reason"] for r in sized.orderBy("k", "section").select(review.skip_reasons(sized).alias("reason")).collect()] == ["", "", "no added lines", "", "no added lines"]
    lines = gitlog.diff_lines(gitlog.diff_files(texts.filter("k > 1"), ["k"]), ["k"])
    totals = lines.groupBy("k", "section").agg(F.count_if(F.col("kind") == "+").alias("a"), F.sum(F.length("text")).alias("c")).collect()
    assert [tuple(r) for r in totals] == [(3, 0, 3, 21)]


def test_files_are_not_shuffled_for_their_sizes(spark):
    texts = spark.range(9).select(F.col("id").alias("k"), F.lit(TEXT).alias("diff"))
    plan = gitlog.with_sizes(gitlog.diff_files(texts, ["k"])).filter("path IS NOT NULL")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
