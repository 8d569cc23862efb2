"""Parsing holds a few files at a time, and specifiers meet files without a row for each candidate."""

import itertools

import pyarrow as pa

from codestrata.operators import resolve_script
from codestrata.sources import python_source


def test_a_worker_holds_few_files():
    files = pa.RecordBatch.from_arrays([pa.array([f"a{i}.py" for i in range(1000)]), pa.array(["def f(): g()\n"] * 999 + [None])], names=["path", "content"])
    got = list(python_source.emitted(python_source._facts)([files]))
    assert max(len(set(b.column("path").to_pylist())) for b in got) <= 256 and sum(b.num_rows for b in got) == 2 * 999


def _candidates(base, own_ts):
    ts, js = [".ts", ".tsx"], [".js", ".jsx"]
    exts = ts + js if own_ts else js + ts
    index = [(f"{base}/index" if base else "index") + e for e in exts]
    stem, dot, last = base.rpartition(".")
    return [base, *[base + e for e in exts], *index, *([stem + e for e in ts] if dot and last in ("js", "jsx", "mjs", "cjs") else [])]


def test_odd_endings_meet_the_same_files(spark):
    known = {f"{d}{n}" for d, n in itertools.product(["", "a/", "a.js/"], ["index.ts", "index.js", "a.js", "a.ts", "a.js.ts", "a.index.js", "a.tsx", "b.mjs.js", "index/index.ts"])}
    specs = [f"./{s}" for s in ("", "a", "a.js", "a.mjs", "index", "index.js", "a.js/index", "a/a.js", "b.mjs", "a.index", "a.js.ts", "index/", "a.py")]
    wanted = spark.createDataFrame([(p, s) for p in ("x.ts", "x.js", "a/y.ts") for s in specs], "path string, spec string")
    got = resolve_script.resolve_specifiers(wanted, spark.createDataFrame([(k,) for k in sorted(known)], "path string"))
    want = set()
    for path, spec in itertools.product(("x.ts", "x.js", "a/y.ts"), specs):
        base = "/".join(p for p in [*path.split("/")[:-1], *spec.split("/")] if p not in ("", "."))
        found = [c for c in _candidates(base, path.endswith(".ts")) if c in known]
        want |= {(path, spec, found[0])} if found else set()
    assert {tuple(r) for r in got.collect()} == want
    assert "posexplode" not in got._jdf.queryExecution().analyzed().toString()


def test_imports_alone_look_at_no_calls(spark):
    files = spark.createDataFrame([("a.ts", "import { f } from './b';\nf();\n"), ("b.ts", "export function f() {}\n")], "path string, content string")
    assert [tuple(r) for r in resolve_script.resolve_imports(files).collect()] == [("a.ts", "b.ts")]


def test_a_path_is_normalized_once_a_specifier(spark):
    """A filter on what a specifier means works nothing out a second time, nor before specifiers are distinct."""
    wanted = spark.createDataFrame([(f"a/f{i}.ts", "./b") for i in range(3)] + [("a/f.ts", "../../up")], "path string, spec string")
    found = resolve_script.resolve_specifiers(wanted, spark.createDataFrame([("a/b.ts",)], "path string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_position(") == 1
    assert {tuple(r) for r in found.collect()} == {(f"a/f{i}.ts", "./b", "a/b.ts") for i in range(3)}


def test_a_hop_is_followed_once(spark, monkeypatch):
    """Names go on from what a hop wrote: no binding is met again for the names that end."""
    written, before = [], resolve_script.stored
    monkeypatch.setattr(resolve_script, "stored", lambda df: written.append(df) or before(df))
    sources = {"a.ts": "import { f, g } from './b';\nexport function run() { f(); g(); hidden(); }\n", "b.ts": "export { h as f } from './c';\nexport * from './c';\nfunction own() { return f(); }\n",
               "c.ts": "export function h() {}\nexport function g() {}\n"}
    files = spark.createDataFrame(list(sources.items()), "path string, content string")
    calls = resolve_script.resolve(files)[2]
    # a re-export binds from outside only, so b.ts itself calls nothing by it
    assert sorted((r["caller_module"], r["caller_name"], r["callee_module"], r["callee_name"]) for r in calls.collect()) == [("a.ts", "run", "c.ts", "g"), ("a.ts", "run", "c.ts", "h")]
    hops = [df for df in written if "next_outside" in df.columns and "way" in df.columns]
    assert len(hops) >= 3
    plan = calls._jdf.queryExecution().optimizedPlan().toString()
    assert "next_outside" not in plan  # nothing of the hops is left to do
