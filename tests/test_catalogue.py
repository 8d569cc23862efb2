"""Every catalogue tool answers on the smallest data."""

import pytest
from pyspark.sql import functions as F

from codestrata.operators.catalogue import TOOLS, Model, ask
from codestrata.plans.evolution import snapshot_health
from codestrata.plans.reports import _sources
from codestrata.plans.structure import module_path
from codestrata.plans.tables import Tables


@pytest.fixture(scope="module")
def model(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    found = t.commits.limit(3).select(F.substring("hash", 1, 10).alias("id"), F.col("hash").alias("sha"), F.lit("restructure").alias("kind"),
                                      F.concat(F.lit("Adopt redis "), "short").alias("subject"), "date", F.array(F.lit("redis")).alias("packages"), F.col("subject").alias("commit_subject"))
    records = spark.createDataFrame([("x", "t", "High")], "id string, title string, confidence string")
    return Model(t.modules.withColumn("language", F.lit("python")), t.classes, t.functions, t.imports, t.calls, t.commits, t.commit_files,
                 t.snap_imports, snapshot_health(t), _sources(t), found, records, t.rules, ("date", "k")), module_path(t, 3), t


ARGUMENTS = {"search_entities": {"query": "pkg_1"}, "get_function_details": {"name": "ClassR.fn_2()"}, "search_source_text": {"query": "the"},
             "explain_decision": {"decision": "why was redis adopted"}, "compare_snapshots": {"from_snapshot": 99, "to_snapshot": -4}}


@pytest.mark.parametrize("tool", sorted(TOOLS))
def test_tool(model, tool):
    m, path, t = model
    arguments = ARGUMENTS.get(tool, {})
    if tool in ("get_module_details", "get_change_impact", "get_file_history"):
        arguments = {"path": path}
    elif tool == "read_source":
        arguments = {"path": m.sources.orderBy("path").first()["path"]}
    elif tool == "get_commit":
        arguments = {"commit": m.commits.first()["hash"][:12]}
    answers = {name: df.count() for name, df in ask(m, tool, **arguments).items()}
    assert any(answers.values()), answers
    if tool == "explain_decision":
        assert answers["decision"] == 1


def test_unknown_tool(model):
    with pytest.raises(KeyError):
        ask(model[0], "drop_everything")
