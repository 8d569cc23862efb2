"""The pipeline against a brute-force run, and on an empty table."""

from collections import Counter

import corpus_pipeline
from codestrata.llm import op1_packing, op7_mixing
from codestrata.llm.common import scratch
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"


def _kept_texts(docs):
    """{id: text} after the first three stages."""
    docs = {i: t for i, t in docs.items() if brute.kept_v1(t)}
    near = brute.near(docs)
    docs = {i: t for i, t in docs.items() if near[i][1] == i}
    return {i: docs[i] if len(w) == len(kept) else " ".join(kept) for i, (w, kept) in brute.substrings(docs).items()}


def test_run_matches_brute_force(spark, documents):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r["doc_id"]: r for r in table.collect()}
    texts = _kept_texts({i: r["text"] for i, r in rows.items()})
    mixed = op7_mixing.mix(documents([(i, t, rows[i]["source"]) for i, t in texts.items()]).repartition(3)).collect()
    copies = {r["doc_id"]: r["copies"] for r in mixed if r["copies"]}
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert Counter(r["doc_id"] for r in got) == copies
    lengths = [n for i, c in copies.items() for n in [len(brute.words(texts[i]))] * c]
    bins = [(n, k, n * k) for n, k in sorted(Counter(lengths).items())]
    edges = op1_packing.boundaries(bins)
    for r in got:
        assert r["n_words"] == len(brute.words(texts[r["doc_id"]])) and r["pad_to"] == min(e for e in edges if e >= r["n_words"])
    seats = Counter((r["bucket"], r["batch"], r["row_in_batch"]) for r in got)
    assert max(seats.values()) == 1


def test_stages_keep_columns(spark, documents, awkward):
    docs = documents(awkward + [(None, None, None)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        path = scratch(spark, "stage-test")
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
    for r in docs.collect():
        assert r["n_chars"] == len(r["text"])


def test_empty_table(spark, documents):
    docs = documents([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0
