"""Similarities from lengths and products as sums, against vectors put together."""

import random

from pyspark.sql import functions as F

from codestrata.operators import relevance
from codestrata.session import stored


def test_rare_and_frequent_tokens_weigh_alike(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(d, " ".join(f"{w}word" for w in rng.choices("abcdefghij", k=rng.randint(0, 12)) + [f"own{chr(97 + d % 26)}"])) for d in range(60)], "doc long, words string")
    asked = spark.createDataFrame([(1, "aword aword bword unknown"), (2, "jword ownc")], "q long, words string")
    n = docs.agg(F.count(F.lit(1)).cast("double").alias("n_docs"))
    terms = stored(relevance.term_counts(docs, "doc", [F.col("words")]))
    idf = stored(relevance.inverse_frequency(terms, n))
    q = relevance.vectors(relevance.term_counts(asked, "q", [F.col("words")]), idf, n, "q")
    want = {(r["q"], r["doc"]): round(r["similarity"], 9) for r in relevance.cosines(q, relevance.vectors(terms, idf, n, "doc"), "q", "doc").collect()}
    got = {(r["q"], r["doc"]): round(r["similarity"], 9) for r in relevance.similarities(q, terms, idf, n, "q", "doc").collect()}
    assert got == want and len(want) > 20
    every = {tuple(r) for r in relevance.weights(terms, idf, n, "doc").collect()}
    assert {tuple(r) for r in relevance.weights(terms, idf, n, "doc", frequent=3).collect()} == every


def test_terms_are_not_dealt_by_document_and_token(spark):
    docs = spark.createDataFrame([(d, "aword bword") for d in range(9)], "doc long, words string")
    plan = relevance.term_counts(docs, "doc", [F.col("words")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc#") == 1 and plan.count("Exchange") == 1
