"""Evidence is worked out on integer keys; no exchange carries a hash, and terms are dealt by commit once."""

from pyspark.sql import functions as F

from codestrata.operators import relevance
from codestrata.plans import catalog
from tests.test_queries import FOLDER


def test_terms_of_a_commit(spark):
    commits = spark.createDataFrame([(1, "Big change"), (2, None), (3, "plain")], "hash long, subject string")
    touched = spark.createDataFrame([(1, "src/alpha.py", 0), (1, "src/beta.py", 1), (1, "src/gamma.py", 2), (2, "src/alpha.py", 0)], "hash long, path string, file_ord int")
    made = relevance.commit_terms(commits, touched, [F.col("subject")], per_commit=2)
    planned = made._jdf.queryExecution().executedPlan().toString()
    got = {(r["hash"], r["token"]): r["n"] for r in made.collect()}
    assert got == {(1, "big"): 1, (1, "change"): 1, (1, "alpha"): 1, (1, "beta"): 1, (2, "alpha"): 1, (3, "plain"): 1}
    assert planned.count("Exchange") == 1


def test_band_on_keys(spark):
    planned = catalog.QUERIES["evidence_band"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in planned and not [line for line in planned.splitlines() if "Exchange" in line and "sha1" in line]
