"""Extra columns named like an operator's helpers or outputs, in any case: helpers step aside, outputs replace."""

import pytest
from pyspark.sql import functions as F

from codestrata.llm import op1_packing, op2_quality_rules, op3_sharding, op7_mixing, op9_substrings, op10_minhash

HELPERS = ["_at", "_Part", "_first", "_rows", "_offset", "_p", "_g0", "_slot", "_best", "_now", "_top", "_RACK", "_source", "_e", "_U", "_w", "_l", "_row",
           "_copies", "_copy", "_id", "_slice", "_c0", "_key", "_digest", "kind", "h1", "n", "start"]
OPERATORS = {
    "op1": (op1_packing.pack, "N_WORDS"), "op2": (op2_quality_rules.ledger, "Word_Chars"), "op3": (op3_sharding.shard, "Shard"),
    "op7": (op7_mixing.mix, "Target"), "op7 emit": (op7_mixing.emit, None), "op9": (op9_substrings.dedup, "N_removed"), "op10": (op10_minhash.keep_one, None)}


@pytest.mark.parametrize("name", OPERATORS)
@pytest.mark.parametrize("shared", [False, True])
def test_helpers_step_aside(documents, name, shared):
    run, output = OPERATORS[name]
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(25)), "ab"[i % 2]) for i in range(1, 9)] + ([(3, "again three", None), (None, None, None)] if shared else [])
    docs = documents(rows)
    marked = docs.select("*", *[F.concat(F.lit(c), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in HELPERS])
    plain = run(docs)
    got = run(marked.withColumn(output, F.lit("mine")) if output else marked)
    assert [c.lower() for c in got.columns if c not in HELPERS] == [c.lower() for c in plain.columns]
    rows_ = got.collect()
    assert sorted(map(str, (tuple(r[c] for c in plain.columns) for r in rows_))) == sorted(str(tuple(r)) for r in plain.collect())
    for r in rows_:
        assert all(r[c] == f"{c}/{'-' if r['doc_id'] is None else r['doc_id']}" for c in HELPERS)
