"""Layers, rules, health: the six-module baseline and the classification and document cases."""

import pytest
from pyspark.sql import functions as F

from codestrata.operators import rules, scope
from codestrata.operators.layers import classify, default_layer
from codestrata.sources.rules_doc import RulesError, default_rules, parse_rules, rules_table

MODULES = ["app.py", "controller.py", "database.py", "models.py", "service.py", "utils.py"]
IMPORTS = [("app.py", "models.py"), ("app.py", "utils.py"), ("controller.py", "database.py"), ("controller.py", "service.py"), ("service.py", "database.py")]
CALLS = [("controller.py", None, "handle_request", "service.py", None, "process"),
         ("controller.py", None, "handle_request_direct", "database.py", None, "save_record"),
         ("service.py", None, "process", "database.py", None, "save_record")]
CALL_SCHEMA = "caller_module string, caller_class string, caller_name string, callee_module string, callee_class string, callee_name string"


def judged(spark):
    doc = default_rules()
    modules = spark.createDataFrame([(m,) for m in MODULES], "path string").withColumn("layer_type", classify(F.col("path"), doc))
    edges = rules.import_edges(spark.createDataFrame(IMPORTS, "`from` string, `to` string")).unionByName(
        rules.call_edges(spark.createDataFrame(CALLS, CALL_SCHEMA)))
    table = rules_table(spark, doc)
    return rules.judged_edges(edges, modules, table), table


def test_baseline_checks_and_health(spark):
    found, table = judged(spark)
    checks = {r["rule_name"]: (r["checks"], r["violations"]) for r in rules.rule_checks(found, table).collect()}
    assert checks == {"no-controller-to-db": (2, 1), "no-controller-imports-db": (2, 1), "no-service-imports-controller": (1, 0),
                      "no-db-imports-service": (0, 0), "no-db-imports-controller": (0, 0)}
    score = rules.health(found, table).first()
    assert score["health"] == pytest.approx(100 * (1 - 2.5 / 7))
    assert score["health_legacy"] == pytest.approx(0.0)
    shown = {(r["caller"], r["callee"]) for r in rules.format_violations(rules.violations(found)).collect()}
    assert shown == {("controller.py", "database.py"), ("controller.py::handle_request_direct", "database.py::save_record")}


def test_no_tagged_edge_is_not_scored(spark):
    found, table = judged(spark)
    score = rules.health(found.filter("false"), table).first()
    assert score["health"] is None and score["health_legacy"] == 100.0


@pytest.mark.parametrize("path, layer", [
    ("controller.py", "controller"), ("src/user.controller.ts", "controller"), ("app/controllers/x.py", "controller"),
    ("app/services/db/session.py", "database"), ("app/db/services/session.py", "service"), ("App/Services/X.py", "service"),
    ("tests/controllers/x.py", None), ("src/user.service.spec.ts", None), ("src/test_service.py", None), ("lib/models/user.py", "model"),
    ("lib/util.py", None), ("order_repository.py", "database"), ("services.py", None)])
def test_classification(spark, path, layer):
    assert spark.range(1).select(classify(F.lit(path), default_rules())).first()[0] == layer


def test_glob_outranks_file_and_folder(spark):
    doc = parse_rules("layers:\n  a:\n    - {glob: 'src/modules/x/*'}\n  b:\n    - {file: 'y.py'}\n    - {dir: x}\n"
                      "rules:\n  - {name: r, from_layer: a, to_layer: b, allowed: false, severity: 1}\n")
    got = spark.createDataFrame([("src/modules/x/deep/y.py",), ("src/x/y.py",), ("src/x/z.py",)], "path string").select(classify(F.col("path"), doc)).collect()
    assert [r[0] for r in got] == ["a", "b", "b"]


def test_default_layers_without_a_layers_section(spark):
    doc = parse_rules("rules:\n  - {name: r, from_layer: a, to_layer: b, allowed: false, severity: 1}\n")
    row = spark.range(1).select(classify(F.lit("controller.py"), doc), default_layer(F.lit("x/service.py"))).first()
    assert tuple(row) == (None, "service")


RULE = "rules:\n  - {name: r, from_layer: a, to_layer: b, allowed: false, severity: %s}\n"


@pytest.mark.parametrize("text, message", [
    ("x" * 20_001, "too long"), ("[1, 2]", "mapping"), ("rules: [", "could not be parsed"), ("layers: {}", "rules"), (RULE % 11, "severity"),
    ("layers:\n  a: [{file: x}]\n" + RULE % 1, "doesn't define"), ("layers:\n  A1: [{file: x}]\n" + RULE % 1, "lowercase"),
    ("layers:\n  a: [{file: x, dir: y}]\n  b: [{file: z}]\n" + RULE % 1, "exactly one"),
    (RULE % 1 + "  - {name: r, from_layer: a, to_layer: b, allowed: true, severity: 0}\n", "duplicate")])
def test_invalid_documents(text, message):
    with pytest.raises(RulesError, match=message):
        parse_rules(text)


def test_priority_orders_by_score(spark):
    found, _ = judged(spark)
    imports = spark.createDataFrame(IMPORTS, "`from` string, `to` string")
    violations = rules.violations(found)
    seen = rules.first_seen(violations.withColumn("idx", F.lit(2)))
    ranked = rules.prioritize(violations, imports, seen, 4).orderBy("rank").collect()
    assert [r["rule_name"] for r in ranked] == ["no-controller-to-db", "no-controller-imports-db"]
    import math
    assert ranked[0]["score"] == pytest.approx(3 * (1 + math.log(3)) * 1.25)
    assert [r["priority"] for r in ranked] == ["High", "High"]


def test_pick_groups_skips_what_does_not_fit(spark):
    sizes = {"a": 5, "b": 4, "c": 3, "d": 1}
    files = spark.createDataFrame([(f"{g}/f{i}.py",) for g, n in sizes.items() for i in range(n)], "path string")
    picked = {r["group"]: r["chosen"] for r in scope.pick_groups(scope.split_groups(files, 6), 6).collect()}
    assert picked == {"a": True, "b": False, "c": False, "d": True}


def test_oversized_folders_are_split(spark):
    files = spark.createDataFrame([(f"packages/core/x/f{i}.py",) for i in range(4)] + [("packages/core/top.py",), ("packages/ui/a.py",), ("main.py",)], "path string")
    groups = {r["group"]: r["files"] for r in scope.split_groups(files, 4).collect()}
    assert groups == {"packages/core/x": 4, "packages/core/*": 1, "packages/ui": 1, "*": 1}
    chosen = scope.choose(files, large_files=3, cap=5)
    kept = {r["path"] for r in files.filter(scope.includes(F.col("path"), chosen)).collect()}
    assert chosen["large"] and chosen["groups_skipped"] and len(kept) == chosen["files_included"] == 5
