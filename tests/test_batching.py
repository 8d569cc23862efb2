"""Next-fit batches over rows against the plain loop, and parts of files by hunks."""

import random

from codestrata.operators import batching
from codestrata.sources import gitlog


def _loop(sizes, budget):
    out, batch, used, any_ = [], 0, 0, False
    for s in sizes:
        if any_ and used + s > budget:
            batch, used = batch + 1, 0
        used, any_ = used + s, True
        out.append(batch)
    return out


def test_rows_match_the_loop(spark):
    rng = random.Random(4)
    groups = {g: [rng.choice([0, 1, 3, 9, 10, 11, 40]) for _ in range(rng.choice([1, 2, 7, 60]))] for g in range(40)}
    groups[99] = [rng.randint(0, 12) for _ in range(3000)]  # one group holds most rows
    groups[None] = [0, 0, 11, 0, 5, 5, 1]
    rows = [(g, i, s) for g, sizes in groups.items() for i, s in enumerate(sizes)]
    rng.shuffle(rows)
    got = batching.next_fit_rows(spark.createDataFrame(rows, "g long, i int, s int"), ["g"], ["i"], "s", 10).collect()
    assert len(got) == len(rows)
    for g, sizes in groups.items():
        assert [r["batch"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["i"])] == _loop(sizes, 10), g
    empty = spark.createDataFrame([], "g long, i int, s int")
    assert batching.next_fit_rows(empty, ["g"], ["i"], "s", 10).count() == 0


def test_files_are_split_by_hunks(spark):
    hunk = lambda start, n: f"@@ -1 +{start},1 @@\n+{'x' * n}\n"
    head = lambda p: f"diff --git a/{p} b/{p}\nindex 1..2\n--- a/{p}\n+++ b/{p}\n"
    diff = head("a.py") + hunk(1, 20) + hunk(9, 20) + hunk(20, 500) + head("b.py") + hunk(3, 5) + head("c.py") + hunk(4, 5)
    files = gitlog.diff_files(spark.createDataFrame([(1, diff)], "id int, diff string"), ["id"])
    got = batching.diff_batches(files, ["id"], ["section"], 100).orderBy("section", "part").collect()
    # a shown hunk is its header, a line break, eight characters of numbers and marks, and the text
    small = len("@@ -1 +1,1 @@") + 9
    assert [(r["path"], r["part"], r["hunks"], r["chars"], r["batch"]) for r in got] == [
        ("a.py", 0, 2, 2 * (small + 20) + 1, 0), ("a.py", 1, 1, 100, 1), ("b.py", 0, 1, small + 5, 2), ("c.py", 0, 1, small + 5, 2)]


def test_one_pass_whatever_the_chain(spark):
    """A chain of 20,000 batches takes no round of its own: no checkpoint, and the jobs of one sort."""
    rows = spark.range(20000).selectExpr("0 as g", "id as i", "7 as s")
    before = set(spark.sparkContext.statusTracker().getJobIdsForGroup())
    got = batching.next_fit_rows(rows, ["g"], ["i"], "s", 10)
    assert set(spark.sparkContext.statusTracker().getJobIdsForGroup()) == before  # nothing ran to plan it
    assert got.agg({"batch": "max"}).first()[0] == 19999


def test_sizes_of_hunks_are_those_of_the_rendered_lines(spark):
    """Numbers of five digits and more, removed and empty lines, a mark of no newline, hunks without lines."""
    from pyspark.sql import functions as F

    body = "+a\n-bb\n ccc\n\n\\ No newline at end of file\n+d"
    diff = f"diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1 +9998,4 @@ def f\n{body}\n@@ -9 +123456 @@\n+z\n@@ -10 +7 @@\n"
    files = gitlog.diff_files(spark.createDataFrame([(1, diff), (2, None), (3, "")], "id int, diff string"), ["id"])
    lines = gitlog.diff_lines(files, ["id"])
    shown = {r["hunk"]: r["n"] for r in lines.groupBy("hunk").agg(F.sum(F.length(gitlog.render_lines(lines)) + 1).alias("n")).collect()}
    heads = {0: "@@ -1 +9998,4 @@ def f", 1: "@@ -9 +123456 @@", 2: "@@ -10 +7 @@"}
    got = {r["hunk"]: r["chars"] for r in batching.hunk_sizes(files, ["id"]).collect()}
    assert got == {h: len(head) + shown.get(h, 0) for h, head in heads.items()}
