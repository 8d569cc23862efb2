"""Several revisions parsed and resolved in one job."""

import hashlib

from codestrata.operators import layers, revisions
from codestrata.sources import rules_doc

BLOBS = {
    "svc": "from .util import helper\nimport shared\n\n\ndef run():\n    helper()\n",
    "util1": "def helper():\n    pass\n",
    "util2": "def helper():\n    pass\n\n\nclass Extra:\n    pass\n",
    "shared": "X = 1\n",
    "page": "import { a } from './part';\nimport '../lib/tool.js';\n",
    "part": "export const a = 1;\n",
    "tool": "export const t = 1;\n",
    "ctl": "from app.db import store\n",
    "store": "import json\n",
}
TREES = {
    # the same contents stand at other paths, vanish, change and make names ambiguous
    "r0": {"app/svc.py": "svc", "app/util.py": "util1", "lib/shared.py": "shared", "web/page.ts": "page", "web/part.ts": "part"},
    "r1": {"app/svc.py": "svc", "app/util.py": "util2", "lib/shared.py": "shared", "other/shared.py": "shared", "web/page.ts": "page", "lib/tool.ts": "tool"},
    "r2": {"app/svc.py": "svc", "app/db/store.py": "store", "app/controllers/ctl.py": "ctl", "app/db/__init__.py": "store", "web/page.ts": "page", "web/part.ts": "part", "lib/tool.ts": "tool"},
}
EDGES = {
    ("r0", "app/svc.py", "app/util.py"), ("r0", "app/svc.py", "lib/shared.py"), ("r0", "web/page.ts", "web/part.ts"),
    ("r1", "app/svc.py", "app/util.py"), ("r1", "web/page.ts", "lib/tool.ts"),  # two files claim the name shared
    ("r2", "web/page.ts", "web/part.ts"), ("r2", "web/page.ts", "lib/tool.ts"),
    ("r2", "app/controllers/ctl.py", "app/db/__init__.py"), ("r2", "app/controllers/ctl.py", "app/db/store.py"),
}


def sha(name):
    return hashlib.sha1(BLOBS[name].encode()).hexdigest()


def inputs(spark):
    tree = spark.createDataFrame([(r, p, sha(b)) for r, files in TREES.items() for p, b in files.items()], "revision string, path string, digest string")
    contents = spark.createDataFrame([(sha(b), c) for b, c in BLOBS.items()], "digest string, content string")
    return tree, revisions.blob_facts(tree, contents)


def test_versions_are_parsed_once(spark):
    tree, facts = inputs(spark)
    rows = facts.collect()
    versions = {(p, sha(b)) for files in TREES.values() for p, b in files.items()}
    assert {(r["path"], r["digest"]) for r in rows} <= versions
    stems = [(r["path"], r["owner"], r["name"]) for r in rows if r["fact"] == "import" and r["language"] == "python" and r["path"] == "app/svc.py"]
    assert sorted(stems, key=str) == [("app/svc.py", "app.util", "helper"), ("app/svc.py", "shared", None)]
    assert {r["language"] for r in rows} == {"python", "script"}
    functions = [(r["path"], r["name"]) for r in rows if r["fact"] == "function"]
    assert functions.count(("app/util.py", "helper")) == 2  # two versions, whatever number of revisions
    assert functions.count(("app/svc.py", "run")) == 1


def test_edges_belong_to_their_revision(spark):
    tree, facts = inputs(spark)
    assert {tuple(r) for r in revisions.snapshot_edges(tree, facts).collect()} == EDGES


def test_facts_of_a_revision(spark):
    tree, facts = inputs(spark)
    rows = revisions.snapshot_facts(tree, facts).filter("fact = 'class'").collect()
    assert [(r["revision"], r["path"], r["name"]) for r in rows] == [("r1", "app/util.py", "Extra")]


def test_build(spark):
    tree, facts = inputs(spark)
    document = rules_doc.default_rules()
    from pyspark.sql import functions as F

    tagged = tree.select("path").distinct().withColumn("layer_type", layers.classify(F.col("path"), document))
    order = spark.createDataFrame([("r0", 0), ("r1", 1), ("r2", 2)], "revision string, idx long")
    built = {r["revision"]: r for r in revisions.build(tree, facts, tagged, rules_doc.rules_table(spark, document), order).collect()}
    assert [built[r]["n_modules"] for r in ("r0", "r1", "r2")] == [5, 6, 7]
    assert [built[r]["n_parsed"] for r in ("r0", "r1", "r2")] == [5, 3, 3]  # part.ts comes back and is not parsed again
    assert [built[r]["n_imports"] for r in ("r0", "r1", "r2")] == [3, 2, 4]
    assert [(built[r]["new_imports"], built[r]["gone_imports"]) for r in ("r0", "r1", "r2")] == [(0, 0), (1, 2), (3, 1)]
    assert [built[r]["n_violations"] for r in ("r0", "r1", "r2")] == [0, 0, 2]
    assert built["r2"]["new_violations"] == 2 and built["r2"]["weighted_violations"] == 4


def test_empty_tree(spark):
    tree, facts = inputs(spark)
    assert revisions.snapshot_edges(tree.limit(0), facts).count() == 0


def test_names_one_file_claims_need_no_index_of_a_revision(spark, monkeypatch):
    tree = spark.createDataFrame([(r, p, "d") for r in (1, 2) for p in ("a/one.py", "b/two.py", "w/x.ts", "w/y.ts")], "revision long, path string, digest string")
    rows = [("a/one.py", "d", "python", "import", 0, "two", None, "two", None, None), ("w/x.ts", "d", "script", "import", 0, "./y", None, None, None, None)]
    facts = spark.createDataFrame(rows, "path string, digest string, language string, fact string, ord int, owner string, name string, detail string, obj string, target string")

    def unwanted(*_):
        raise AssertionError("names are looked up in every revision")

    monkeypatch.setattr(revisions.resolve_python, "module_index", unwanted)
    monkeypatch.setattr(revisions.resolve_script, "resolve_specifiers", unwanted)
    want = {(r, *e) for r in (1, 2) for e in (("a/one.py", "b/two.py"), ("w/x.ts", "w/y.ts"))}
    assert {tuple(r) for r in revisions.snapshot_edges(tree, facts).collect()} == want


def test_random_trees_against_an_index_of_each_revision(spark):
    import random

    rng = random.Random(7)
    python = [f"{d}{n}.py" for d in ("", "a/", "b/", "a/b/") for n in ("__init__", "a", "b", "c", "only_" + d.replace("/", "_"))]
    script = [f"{d}{n}" for d in ("w/", "w/v/") for n in ("p.ts", "p.js", "q.tsx", "index.js", "p/index.ts", "r.jsx")]
    names = ["a", "b", "c", "a.b", "a.b.c", "b.a", "a.__init__", "only_a_", "a.only_a_", "nothing"]
    tree = [(r, p, rng.choice("xy")) for r in range(12) for p in python + script if rng.random() < 0.45]
    facts = []
    for p in python:
        for d in "xy":
            facts += [(p, d, "python", "import", i, rng.choice(names), rng.choice([None, "a", "b", "c", "only_a_"]), "m", None, None) for i in range(4)]
            facts += [(p, d, "python", rng.choice(["function", "class"]), 9, None, rng.choice(["a", "b", "c", "run"]), None, None, None)]
    for p in script:
        for d in "xy":
            facts += [(p, d, "script", "import", i, rng.choice(["./p", "./q", "../w", "./v", "./v/r", "./p.js", "../v/p", "x"]), None, None, None, None) for i in range(3)]
    files = spark.createDataFrame(tree, "revision long, path string, digest string")
    rows = spark.createDataFrame(facts, "path string, digest string, language string, fact string, ord int, owner string, name string, detail string, obj string, target string")
    here, paths = revisions.snapshot_facts(files, rows), files.select("revision", "path")
    index = revisions.resolve_python.module_index(paths.filter("path LIKE '%.py'"), ("revision",))
    want = {tuple(r) for r in revisions.resolve_python.import_edges(here.filter("language = 'python'"), index, ("revision",)).collect()}
    specs = here.filter("language = 'script'").select("revision", "path", here["owner"].alias("spec")).distinct()
    found = revisions.resolve_script.resolve_specifiers(specs, paths.filter("path NOT LIKE '%.py'"), None, ("revision",))
    want |= {(r["revision"], r["path"], r["target"]) for r in found.collect() if r["path"] != r["target"]}
    got = [tuple(r) for r in revisions.snapshot_edges(files, rows).collect()]
    assert len(want) > 100 and len(got) == len(set(got)) and set(got) == want
