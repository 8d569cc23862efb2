"""Working tree, stored relations, cached artifacts."""

from pyspark.sql import functions as F

from codestrata.sources import store


def test_tree(spark, tmp_path):
    for name, body in {"a/x.py": "import os\n", "a/node_modules/y.js": "x", ".git/z.py": "x", "tsconfig.json": "{}", "data.json": "{}", "b.txt": "x", "big.ts": "x" * 1_000_001}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    assert {(r["path"], r["content"]) for r in store.read_tree(spark, str(tmp_path)).collect()} == {("a/x.py", "import os\n"), ("tsconfig.json", "{}")}


def test_analyses_stay_apart(spark, tmp_path):
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "path string")
    folder = str(tmp_path / "graph")
    store.save({"Module": rows("a", "b")}, folder, "one")
    store.save({"Module": rows("c")}, folder, "two")
    store.save({"Module": rows("d")}, folder, "one")
    assert [r[0] for r in store.load(spark, folder, "Module", "one").collect()] == ["d"]
    assert [r[0] for r in store.load(spark, folder, "Module", "two").collect()] == ["c"]


def test_upsert_and_cache(spark):
    old = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, title string")
    new = spark.createDataFrame([("2", "c"), ("3", "d")], "id string, title string")
    assert {tuple(r) for r in store.upsert_records(old, new).collect()} == {("1", "a"), ("2", "c"), ("3", "d")}
    made = spark.createDataFrame([("r", "v1", False), ("r", "v2", True)], "repo string, version string, degraded boolean").withColumn("digest", store.artifact_digest(F.col("repo"), F.col("version")))
    assert [r["version"] for r in store.cache_misses(made, store.storable(made)).collect()] == ["v2"]


def test_lines_keep_their_order(spark, tmp_path):
    lines = spark.createDataFrame([(i, f"line {i:02d}") for i in reversed(range(20))], "n int, line string")
    store.save_lines(lines, ["n"], str(tmp_path / "doc"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "doc").glob("part-*")))
    assert text.splitlines() == [f"line {i:02d}" for i in range(20)]
