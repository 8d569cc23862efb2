"""Views over a small literal graph."""

from codestrata.operators import views


def _graph(spark):
    labels = {
        "Module": spark.createDataFrame([(i, f"m{i:04d}.py", f"m{i:04d}.py") for i in range(900)], "key long, id string, path string"),
        "Commit": spark.createDataFrame([(i, f"c{i}", i // 2) for i in range(300)], "key long, id string, timestamp long"),
        "Developer": spark.createDataFrame([(1, "a", "Zoe"), (2, "b", "Ann"), (3, "c", "Ann")], "key long, id string, name string"),
        "Snapshot": spark.createDataFrame([(0, "0", 0), (1, "1", 1)], "key long, id string, idx long"),
        "HModule": spark.createDataFrame([("m1", "m1", "m1"), ("m2", "m2", "m2")], "key string, id string, path string"),
    }
    edge = "src long, dst long"
    kinds = [
        views.Kind("IMPORTS", ("Module", "key"), ("Module", "key"), spark.createDataFrame([(1, 2), (1, 899), (5, 3)], edge)),
        views.Kind("AUTHORED", ("Developer", "key"), ("Commit", "key"), spark.createDataFrame([(1, 299), (1, 0), (2, 298)], edge)),
        views.Kind("AT", ("Snapshot", "key"), ("Commit", "id"), spark.createDataFrame([(0, "c7"), (1, "c4")], "src long, dst string")),
        views.Kind("NEXT", ("Snapshot", "key"), ("Snapshot", "key"), spark.createDataFrame([(0, 1)], edge)),
        views.Kind("H_IMPORTS", ("HModule", "key"), ("HModule", "key"), views.spans(
            spark.createDataFrame([("m1", "m2", 1, None), ("m1", "m2", 0, 1)], "a string, b string, valid_from_idx long, valid_to_idx long"), *map(views.F.col, "ab"))),
    ]
    return labels, kinds


def test_caps_and_order(spark):
    labels, kinds = _graph(spark)
    got = views.nodes("dependencies", labels, kinds).collect()
    assert sorted(r["id"] for r in got) == [f"m{i:04d}.py" for i in range(800)]
    edges = views.relationships("dependencies", labels, kinds).collect()
    assert [(r["src"], r["dst"]) for r in edges] == [("m0001.py", "m0002.py"), ("m0005.py", "m0003.py")]  # 899 is beyond the cap
    assert len(views.relationships("dependencies", labels, kinds, limit=1).collect()) == 1
    assert [tuple(r) for r in views.hidden("dependencies", labels, kinds).collect()] == [("Module", 900, 800)]


def test_newest_commits_first(spark):
    labels, kinds = _graph(spark)
    commits = {r["id"] for r in views.nodes("history", labels, kinds).where("label = 'Commit'").collect()}
    assert commits == {f"c{i}" for i in range(50, 300)}
    edges = [(r["type"], r["src"], r["dst"]) for r in views.relationships("history", labels, kinds).collect()]
    assert edges == [("AUTHORED", "a", "c299"), ("AUTHORED", "b", "c298")]


def test_time_travel(spark):
    labels, kinds = _graph(spark)
    got = {(r["label"], r["id"]) for r in views.nodes("temporal", labels, kinds).collect()}
    assert got == {("Snapshot", "0"), ("Snapshot", "1"), ("Commit", "c4"), ("Commit", "c7"), ("HModule", "m1"), ("HModule", "m2")}
    edges = [tuple(r) for r in views.relationships("temporal", labels, kinds).collect()]
    assert edges == [("AT", "0", "c7", None, None), ("AT", "1", "c4", None, None), ("H_IMPORTS", "m1", "m2", 0, 1), ("H_IMPORTS", "m1", "m2", 1, None),
                     ("NEXT", "0", "1", None, None)]


def test_code_view_ranks_its_nodes_once(spark):
    from codestrata.plans import catalog

    plan = catalog.QUERIES["view_edges"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "MODIFIED" not in plan
