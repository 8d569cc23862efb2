"""Decision ids are short: two decisions may share one, and their records still stay apart."""

from pyspark.sql import functions as F

from codestrata.operators import decisions
from codestrata.plans import catalog
from tests.test_queries import FOLDER


def test_records_of_decisions_that_share_an_id(spark, monkeypatch):
    whole = decisions.decision_id
    monkeypatch.setattr(decisions, "decision_id", lambda *c: F.substring(whole(*c), 1, 2))
    listed = catalog.QUERIES["list_decisions"](spark, FOLDER)
    commits = spark.read.parquet(f"{FOLDER}/lineitem.parquet").select("l_orderkey").distinct().count()
    assert listed.count() == commits
    assert listed.filter("(kind = 'restructure') <> (title is not null)").isEmpty()
