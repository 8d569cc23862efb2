"""The detectors on a small literal history."""

import time

from pyspark.sql import functions as F

from codestrata.operators import detection
from codestrata.session import stored

COMMITS = [(f"c{i}", i, f"2024-01-{i:02d}") for i in range(1, 11)]
SNAPSHOTS = [(0, 3), (1, 6), (2, 9)]
TOUCHED = [  # hash, pos, ord, path, old_path, status
    ("c1", 1, 0, "Dockerfile", None, "A"), ("c1", 1, 1, "app/a.py", None, "A"), ("c2", 2, 0, "docker/Dockerfile", None, "A"),
    ("c4", 4, 0, "app/core/x.py", None, "M"), ("c5", 5, 0, "app/core/x.py", None, "A"), ("c5", 5, 1, "app/core/y.py", None, "A"), ("c6", 6, 0, "app/core/z.py", None, "A"),
    ("c7", 7, 0, "app/core/x.py", None, "D"), ("c8", 8, 0, "app/core/y.py", None, "D"), ("c8", 8, 1, "docs/n.md", None, "A"), ("c10", 10, 0, "app/core/q.py", None, "A"),
    *[("c9", 9, i, f"app/new{i}.py", f"app/old{i}.py", "R") for i in range(6)],
    ("c3", 3, 0, "terraform/main.tf", None, "A"),
]
MODULES = [(0, "app/a.py")] + [(1, f"app/core/{f}.py") for f in "xyz"] + [(1, "app/a.py"), (2, "app/a.py")] + [(i, f"src/{f}.py") for i in (1, 2) for f in "abc"]


def tables(spark):
    return (spark.createDataFrame(COMMITS, "hash string, pos long, date string"),
            spark.createDataFrame(TOUCHED, "hash string, pos long, ord int, path string, old_path string, status string"),
            spark.createDataFrame(SNAPSHOTS, "idx long, pos long"), spark.createDataFrame(MODULES, "idx long, path string"))


PRESENCE = "idx long, rule_name string, caller_module string, caller_class string, caller_name string, callee_module string, callee_class string, callee_name string"
VERSIONS = "hash string, pos long, path string, content string"


def test_gaps(spark):
    rows = spark.createDataFrame([(p,) for p in (0, 3, 4, 6, 9, 10)], "pos long")
    got = {r["pos"]: r["idx"] for r in detection.with_gap(rows, spark.createDataFrame(SNAPSHOTS, "idx long, pos long")).collect()}
    assert got == {0: 0, 3: 0, 4: 1, 6: 1, 9: 2}  # what comes after the last snapshot has none


def test_structure_is_pinned_inside_its_gap(spark):
    _, touched, snapshots, modules = tables(spark)
    got = sorted(tuple(r)[:5] for r in detection.structure_decisions(modules, touched, snapshots, F.lit(False)).collect())
    # c4 only changes a file, c10 lies after the last snapshot; src/ appears without a commit that adds to it
    assert got == [("c5", "structure", "Introduce the app/core/ module group (3 modules)", 1.1, 3), ("c7", "structure", "Remove the app/core/ module group (3 modules)", 1.1, 3)]


def test_infrastructure_decisions(spark):
    _, touched, _, _ = tables(spark)
    got = sorted(tuple(r)[:5] for r in detection.infrastructure_decisions(touched, F.col("path") == "Dockerfile").collect())
    assert got == [("c2", "infrastructure", "Introduce Docker containerization", 1.0, 1), ("c3", "infrastructure", "Introduce Terraform infrastructure", 1.0, 1)]


def test_occurrences(spark):
    row = spark.createDataFrame([("aXaaXa", None)], "t string, none string").select(
        detection.occurrences(F.col("t"), F.lit("aX")), detection.occurrences(F.col("t"), F.lit("aa")), detection.occurrences(F.col("none"), F.lit("a")),
        detection.occurrences(F.lit("aaaa"), F.lit("aa"))).first()
    assert tuple(row) == (2, 1, 0, 2)


def test_needle_changes(spark):
    versions = spark.createDataFrame([("c1", 1, 0, "f", "save()"), ("c2", 2, 0, "f", "save() load()"), ("c4", 4, 1, "f", "save() load() save()"), ("c5", 5, 1, "f", "load() "),
                                      ("c7", 7, 2, "f", None), ("c1", 1, 0, "g", "save()")], "hash string, pos long, idx long, path string, content string")
    needles = spark.createDataFrame([("f", "save"), ("f", "load"), ("h", "save")], "path string, needle string")
    got = sorted((r["needle"], r["hash"]) for r in detection.needle_changes(versions, needles).collect())
    assert got == [("load", "c2"), ("load", "c7"), ("save", "c1"), ("save", "c4"), ("save", "c5")]


def test_violation_decisions(spark):
    key = ("no-x", "app/a.py", None, None, "app/db.py", None, None)
    named = ("no-y", "app/a.py", "A", "run", "app/db.py", "Db", "fetch")
    presence = [(1, *key), (1, *named), (1, "no-y", "app/a.py", "A", "stop", "app/db.py", "Db", "close"), (2, *named), (2, "no-y", "app/a.py", "A", "stop", "app/db.py", "Db", "close")]
    versions = [("c1", 1, "app/a.py", "x"), ("c4", 4, "app/a.py", "import db"), ("c5", 5, "app/a.py", "import db; fetch()"), ("c8", 8, "app/a.py", "fetch()"), ("c9", 9, "app/a.py", None)]
    _, _, snapshots, _ = tables(spark)
    got = sorted(tuple(r)[:5] for r in detection.violation_decisions(spark.createDataFrame(presence, PRESENCE), spark.createDataFrame(versions, VERSIONS), snapshots).collect())
    # several violations of one rule between two modules are one decision, named after the first of them
    assert got == [("c4", "violation_introduced", "Introduce no-x: app/a.py -> app/db.py", 0.9, 2), ("c5", "violation_introduced", "Introduce no-y: app/a.py -> app/db.py", 0.9, 2),
                   ("c8", "violation_resolved", "Resolve no-x: app/a.py -> app/db.py", 0.9, 2)]


def test_all_detectors_in_one_shape(spark):
    commits, touched, snapshots, modules = tables(spark)
    presence, versions = spark.createDataFrame([], PRESENCE), spark.createDataFrame([], VERSIONS)
    dependencies = spark.createDataFrame([("c2", "dependency_change", "Adopt flask (web framework)", 1.5, ["flask"])], "sha string, kind string, subject string, significance double, packages array<string>")
    got = detection.detect(commits, touched, snapshots, modules, presence, versions, dependencies).collect()
    assert sorted((r["kind"], r["sha"]) for r in got) == [("dependency_change", "c2"), ("infrastructure", "c1"), ("infrastructure", "c3"), ("restructure", "c9"), ("structure", "c5"), ("structure", "c7")]
    assert all(len(r["id"]) == 10 and r["date"] for r in got) and len({r["id"] for r in got}) == 6
    # commits that touch nothing but excluded paths can be no decision
    left = detection.detect(commits, touched, snapshots, modules, presence, versions, dependencies, ("app/core/*", "terraform/*", "docker/*")).collect()
    assert sorted((r["kind"], r["sha"]) for r in left) == [("infrastructure", "c1"), ("restructure", "c9")]


def _shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}


def _settled(spark, before):
    for _ in range(50):  # files are removed beside the work that follows
        left = _shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    return left


def test_what_is_stored_leaves_no_shuffle_behind(spark):
    before, setting = _shuffle_files(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    asked = spark.conf.get(setting)
    kept = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().repartition(3, "k"))
    assert _settled(spark, before) == set() and spark.conf.get(setting) == asked
    assert kept.count() == 7


def test_detectors_leave_no_shuffle_and_name_keys_last(spark):
    """Keys that stand for hashes give the same decisions, and the shuffles of a detector end with it."""
    commits, touched, snapshots, modules = tables(spark)
    presence, versions = spark.createDataFrame([], PRESENCE), spark.createDataFrame([], VERSIONS)
    dependencies = spark.createDataFrame([("c2", "dependency_change", "Adopt flask (web framework)", 1.5, ["flask"])], "sha string, kind string, subject string, significance double, packages array<string>")
    want = {tuple(r)[:7] for r in detection.detect(commits, touched, snapshots, modules, presence, versions, dependencies).collect()}
    key = lambda c: F.substring(c, 2, 9).cast("long")
    commits, touched, versions, dependencies = (df.withColumn(c, key(c)) for df, c in ((commits, "hash"), (touched, "hash"), (versions, "hash"), (dependencies, "sha")))
    before = _shuffle_files(spark)
    found = detection.detect(commits, touched, snapshots, modules, presence, versions, dependencies, name=F.concat(F.lit("c"), F.col("sha").cast("string")))
    assert _settled(spark, before) == set()
    assert {tuple(r)[:7] for r in found.collect()} == want and len(want) == 6
