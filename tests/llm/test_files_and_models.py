"""Token files, WARC archives, vectors and the classifier on awkward rows, against brute force or a round trip."""

import hashlib
import io
import random
import zlib
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F

from codestrata.llm import op4_warc, op5_embeddings, op6_classifier, op8_tokens
from codestrata.llm.common import scratch
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(op8_tokens.VOCABULARY))


def _ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [op8_tokens.END_ID]


def test_pieces_give_the_ids_of_the_whole_text(tokenizer):
    rng, encode = random.Random(1), op8_tokens.encoder(op8_tokens.VOCABULARY)
    parts = ["a", "b", "Foo", "don't", "  ", " ", "\n", "\t", "\x1c", " ", "\xa0", "!", "??", "12", "é", "<|endoftext|>", "\r\n", "\x0b", "\x85", ".", "_.", ",", "²", "ß", "中", "'s", " '"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for text in texts:
        plain, spaced = op8_tokens.pieces(text)
        assert "".join(plain) + "".join(" " + p for p in spaced) == text
    for at in range(0, len(texts), 100):
        for text, ids in zip(texts[at:at + 100], encode(texts[at:at + 100]), strict=True):
            assert ids == array("I", _ids(tokenizer, text)).tobytes(), repr(text)


def test_token_files(spark, documents, awkward, tokenizer):
    rows = awkward + [(None, "null id", "s"), (4, awkward[3][1], "b")]
    path = scratch(spark, "tokens-test")
    op8_tokens.write_tokens(documents(rows).repartition(5), path)
    got = op8_tokens.read_tokens(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, *sorted(i for i, _, _ in rows if i is not None)]
    texts, at = {i: t for i, t, _ in rows}, 0
    for r in got:
        assert r["tokens"] == _ids(tokenizer, texts[r["doc_id"]]) and r["n_tokens"] == len(r["tokens"]) and r["start"] == at
        at += r["n_tokens"]
    some = op8_tokens.read_tokens(spark, path, F.col("doc_id").between(9, 12), ["doc_id", "n_tokens"]).orderBy("start").collect()
    assert [tuple(r) for r in some] == [(r["doc_id"], r["n_tokens"], r["start"]) for r in got if r["doc_id"] and 9 <= r["doc_id"] <= 12]


def test_token_query(spark, tokenizer):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()
    got, at = {r["doc_id"]: r for r in op8_tokens.op8_tokens(spark, FOLDER).collect()}, 0
    assert len(got) == len(docs)
    for d in docs:
        ids = _ids(tokenizer, d["text"])
        assert tuple(got[d["doc_id"]]) == (d["doc_id"], at, len(ids), zlib.crc32(array("I", ids).tobytes()))
        at += len(ids)


def test_token_files_empty(spark, documents):
    path = scratch(spark, "tokens-test")
    op8_tokens.write_tokens(documents([]), path)
    assert op8_tokens.read_tokens(spark, path).count() == 0


PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc_round_trip(spark, compression):
    big, hard = "<p>é</p>" * 400, "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\n" * 30
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (9, None, big), (3, "http://a/3\r\nX: y", hard), (4, "u", hard), (5, "u", "short"), (6, "u", "short"),
            (7, "u", None), (8, "u", ""), (None, "u", big), (10, "u", "z" * 999), (11, "u", "z" * 999), (12, "u", "y" * 1000), (13, "u", "y" * 1000), (12, "u", "y" * 1000)]
    path = scratch(spark, "warc-test")
    op4_warc.write_warc(spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit("mine")).repartition(3), path, compression)
    read = op4_warc.read_warc(spark, path)
    got = read.collect()
    assert len(got) == len(rows)
    top = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 1000:
            top[html] = max(top.get(html, i), i)
    by = {(r["record_id"], r["record_type"]): r for r in got}
    for i, url, html in rows:
        raw = (html or "").encode()
        later = i is not None and i < top.get(html, i)
        r = by[f"{op4_warc.ID}{'' if i is None else i}", "revisit" if later else "response"]
        assert r["payload_digest"] == hashlib.sha1(raw).hexdigest() and r["payload_length"] == len(raw)
        assert bytes(r["payload"]) == (b"" if later else raw)
        assert r["refers_to"] == (f"{op4_warc.ID}{top[html]}" if later else None)
        assert (r["target_uri"] is None) == (url is None)
    kept = read.where((F.col("record_type") == "revisit") & F.col("target_uri").isin("http://a/1", "nowhere"))
    assert [r["record_id"] for r in kept.collect()] == [f"{op4_warc.ID}1"]
    assert "record_type" not in kept._jdf.queryExecution().executedPlan().toString().partition("Filter")[2].partition("\n")[0]
    assert all(r["payload"] is None for r in op4_warc.read_warc(spark, path, payload=False).collect())


def test_warc_skips_payloads():
    class Counted(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            self.taken += n
            return super().read(n)

    one = lambda kind, n: f"WARC/1.1\r\nWARC-Type: {kind}\r\nContent-Length: {n}\r\n\r\n".encode() + b"x" * n + b"\r\n\r\n"
    stream = Counted(one("response", 5000) + one("revisit", 0) + one("response", 70))
    assert len(list(op4_warc.records(stream, True, [("record_type", frozenset(["revisit"]))], True))) == 1 and stream.taken == 0


def test_warc_empty(spark):
    path = scratch(spark, "warc-test")
    op4_warc.write_warc(spark.createDataFrame([], PAGES), path)
    assert op4_warc.read_warc(spark, path).count() == 0


def _vectors(rng, rows):
    return [(i, label, None if v is None else [float(np.float32(x)) for x in v]) for i, label, v in rows]


def _check_vectors(spark, rows, least=0.99):
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("links", F.lit(1))
    got = {r["vec_id"]: r for r in op5_embeddings.link(frame).collect()}
    usable = {i: (label, np.array(v, np.float64)) for i, label, v in rows if label is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    ids = sorted(usable)
    links = []
    for label in {usable[i][0] for i in ids}:
        for length in {len(usable[i][1]) for i in ids}:
            mine = [i for i in ids if usable[i][0] == label and len(usable[i][1]) == length]
            if mine:
                x = np.stack([usable[i][1] for i in mine])
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                links += [(mine[a], mine[b]) for a, b in zip(*np.nonzero(np.triu(x @ x.T >= 0.98, 1)), strict=True)]
    n = {i: 0 for i, _, _ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    assert len(got) == len(rows)
    found = sum(r["n_links"] for r in got.values())
    assert all(got[i]["n_links"] <= n[i] for i in n) and found >= least * sum(n.values())
    if found == sum(n.values()):
        want = brute.reach(n, links)
        assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((40, 24))
    rows = [(i, i % 3, base[i % 40] + rng.standard_normal(24) * 0.03 * (i % 7)) for i in range(600)]
    rows += [(1000 + i, 1, base[0] + rng.standard_normal(24) * 0.02) for i in range(700)]  # one hot group, several blocks
    rows += [(3000, None, base[0]), (3001, 1, None), (3002, 1, np.zeros(24)), (3003, 1, [float("nan")] * 24), (3004, 1, base[0][:5]), (3005, 1, base[0][:5] * 2),
             (3006, 1, []), (3007, 2, base[3]), (3008, 2, base[3]), (3009, 2, base[3]), (3010, 1, [float("inf")] + [1.0] * 23)]
    rows = _vectors(rng, rows) + [(3011, 1, [1.0, None, 2.0])]
    _check_vectors(spark, rows)


def test_vectors_recall_on_random_pairs(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.standard_normal(x.shape)
    noise -= (noise * x).sum(axis=1, keepdims=True) * x
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    close = 0.9805 * x + np.sqrt(1 - 0.9805 ** 2) * noise
    _check_vectors(spark, _vectors(rng, [(2 * i, 0, x[i]) for i in range(1500)] + [(2 * i + 1, 0, close[i]) for i in range(1500)]))


def test_vectors_empty(spark):
    assert op5_embeddings.link(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).count() == 0


def test_classifier_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in op6_classifier.op6_classifier(spark, folder).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [i for i in labels if got[i]["held_out"]]
    assert held == [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum(got[i]["predicted"] == labels[i] for i in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())


def test_classifier_compiles_rules(spark, documents, awkward):
    debug = "RandomForest\n  Tree 0 (weight 1.0):\n    If (feature 1 <= 0.5)\n     If (feature 0 <= 2.0)\n      Predict: 1.0\n     Else (feature 0 > 2.0)\n      Predict: 0.0\n    Else (feature 1 > 0.5)\n     Predict: 0.0\n"
    rules = op6_classifier.rules_of(debug)
    a, b, c, d = ("symbols_per_word", "<=", 0.5), ("log_words", "<=", 2.0), ("log_words", ">", 2.0), ("symbols_per_word", ">", 0.5)
    assert {frozenset(r) for r in rules} == {frozenset([a]), frozenset([a, b]), frozenset([a, c]), frozenset([d])}
    model = op6_classifier.Ensemble(0.5, [((a, c), 2.0), ((d,), -3.0)])
    rows = documents(awkward).select("doc_id", op6_classifier.statistics(F.col("text")).alias("s")).select("doc_id", "s.*").withColumn("score", model.score())
    for r in rows.collect():
        want = 0.5 + (2.0 if r["symbols_per_word"] <= 0.5 and r["log_words"] > 2 else 0) - (3.0 if r["symbols_per_word"] > 0.5 else 0)
        assert abs(r["score"] - 1 / (1 + np.exp(-want))) < 1e-12


def test_classifier_statistics(documents, awkward):
    got = {r["doc_id"]: r["s"] for r in documents(awkward).select("doc_id", op6_classifier.statistics(F.col("text")).alias("s")).collect()}
    for i, text, _ in awkward:
        w = brute.words(text)
        n = max(len(w), 1)
        assert abs(got[i]["symbols_per_word"] - brute.measures(text)["n_symbols"] / n) < 1e-12
        assert abs(got[i]["echo_share"] - sum(x == y for x, y in zip(w, w[1:], strict=False)) / n) < 1e-12
        assert abs(got[i]["distinct_share"] - len(set(w)) / n) < 1e-12 and got[i]["longest_word"] == max(map(len, w), default=0)


def test_classifier_few_labels(spark, documents, awkward):
    docs = documents(awkward + [(None, "x", "s")])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in op6_classifier.classify(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(4, 1), (5, 1), (9, None)], "doc_id long, quality int")
    got = op6_classifier.classify(docs, one).collect()
    assert len(got) == len(awkward) + 1 and len({r["score"] for r in got}) == 1
    assert op6_classifier.classify(documents([]), one).count() == 0
