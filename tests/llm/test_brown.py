"""Class model scores against plain Python; the classes themselves are checked through the likelihood they reach."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codestrata.llm import op12_brown
from tests.llm import brute

ADD = 0.1


def unit_of(word, lexicon):
    known = lexicon.words.to_pylist()[:lexicon.own]
    return known.index(word) if word in known else lexicon.own + int(op12_brown.tails(pa.array([word], pa.large_string()))[0])


def plain(train, texts, model):
    """(n_tokens, n_known, base, score) of each text, from the model's classes alone."""
    tokens = lambda text: brute.words(brute.lower(text))
    count, after = Counter(), Counter()
    end = model.lexicon.end
    cls = lambda w: int(model.classes[end if w is None else unit_of(w, model.lexicon)])
    for text in train:
        chain = [None, *tokens(text), None]
        count.update(chain[1:])
        after.update((cls(a), cls(b)) for a, b in zip(chain, chain[1:], strict=False))
    total, kinds = sum(count.values()), len(count)
    assert (total, kinds) == (model.total, model.kinds)
    size, words = Counter(), Counter()
    for w, n in count.items():
        size[cls(w)] += n
        words[cls(w)] += w is not None
    width = len(model.transitions)
    from_ = Counter()
    for (a, _), n in after.items():
        from_[a] += n
    share = {c: (size[c] + 1) / (total + width) for c in range(width)}

    def step(a, b):
        return math.log10((after[a, b] + op12_brown.PRIOR * share[b]) / (from_[a] + op12_brown.PRIOR))

    for a in range(width):
        assert abs(sum(10 ** step(a, b) for b in range(width)) - 1) < 1e-9
    out = []
    for text in texts:
        chain = [None, *tokens(text), None]
        score = sum(step(cls(a), cls(b)) for a, b in zip(chain, chain[1:], strict=False))
        score += sum(math.log10((count[w] + ADD) / (size[cls(w)] + ADD * (words[cls(w)] + 1))) for w in chain[1:-1])
        base = sum(math.log10((count[w] + ADD) / (total + ADD * (kinds + 1))) for w in chain[1:])
        out.append((len(chain) - 1, sum(count[w] > 0 for w in chain[1:]), base, score))
    return out


def rows_of(awkward):
    rng = random.Random(4)
    nouns, verbs = ([p + "".join(rng.choice("abcde") for _ in range(4)) for _ in range(25)] for p in "nv")
    prose = [(300 + i, " ".join(rng.choice(nouns if k % 2 else verbs) for k in range(rng.randint(2, 50))), "s") for i in range(150)]
    return [*awkward, *prose, (None, "null id one", "s"), (None, "null id two", "s"), (4, "an id again", "s"), (400, "L" * 5000 + " " + "ß" * 70, "s"), (401, "İ K Ⅷ", "s")]


@pytest.mark.parametrize("shares", [(1 << 16, 1 << 20), (50, 200)])
def test_scores(spark, documents, awkward, monkeypatch, shares):
    """Whatever share makes a word a unit or known to all tasks, scores are those of the formula."""
    monkeypatch.setattr(op12_brown, "UNIT_SHARE", shares[0])
    monkeypatch.setattr(op12_brown, "FREQUENT_SHARE", shares[1])
    monkeypatch.setattr(op12_brown, "SLICE_BYTES", 4000)
    rows = rows_of(awkward)
    docs = documents(rows).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").withColumn("word", F.lit(1))
    train = [t for i, t, _ in rows if i is None or zlib.crc32(str(i).encode()) % 10]
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    model = op12_brown.train(docs.where(~held), classes=6, rounds=2)
    texts = [r["text"] for r in docs.orderBy("row").collect()]
    got = [(r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in op12_brown.score(docs, model).orderBy("row").collect()]
    for g, w in zip(got, plain(train, texts, model), strict=True):
        assert g[:2] == w[:2] and g[2:] == pytest.approx(w[2:], rel=1e-9)


def test_query_columns_and_rows(spark, documents, awkward, tmp_path):
    rows = rows_of(awkward)
    documents(rows).withColumn("row", F.lit(0)).withColumn("Held_out", F.lit(1)).withColumn("n", F.lit("x")).write.parquet(str(tmp_path / "documents.parquet"))
    got = op12_brown.op12_brown(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] for r in got), key=str) == sorted((i for i, _, _ in rows), key=str)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
        assert r["score"] < 0 and r["n_known"] <= r["n_tokens"] and (r["held_out"] or r["n_known"] == r["n_tokens"])
    assert {r["train_tokens"] for r in got} == {sum(len(brute.words(t)) + 1 for i, t, _ in rows if i is None or zlib.crc32(str(i).encode()) % 10)}


def test_nothing_to_learn_from(spark, documents):
    model = op12_brown.train(documents([]))
    assert (model.total, model.kinds) == (0, 0)
    rows = documents([(1, "a b", "s"), (2, None, "s")]).withColumnRenamed("doc_id", "row")
    got = op12_brown.score(rows, model).orderBy("row").collect()
    assert [(r["n_tokens"], r["n_known"], r["base_score"]) for r in got] == [(3, 0, 0.0), (1, 0, 0.0)]
    assert all(r["score"] < 0 for r in got) and op12_brown.score(rows.limit(0), model).count() == 0


def test_gains_are_differences_of_likelihood():
    rng = np.random.default_rng(2)
    units, width = 12, 5
    pairs = rng.integers(0, 9, (units, units)).astype(float)
    classes = rng.integers(0, width, units)

    def bigrams(of):
        m = np.zeros((width, width))
        np.add.at(m, (of[:, None].repeat(units, 1), of[None, :].repeat(units, 0)), pairs)
        return m

    now = bigrams(classes)
    for unit in range(units):
        after, before = np.bincount(classes, pairs[unit], width), np.bincount(classes, pairs[:, unit], width)
        got = op12_brown.gains(now, int(classes[unit]), after, before, pairs[unit, unit])
        for to in range(width):
            other = classes.copy()
            other[unit] = to
            assert got[to] == pytest.approx(op12_brown.likelihood(bigrams(other)) - op12_brown.likelihood(now), abs=1e-6)


def test_exchange_finds_the_two_kinds(spark, documents):
    """Texts whose words of one kind follow those of the other: the classes tell the kinds apart."""
    rng = random.Random(1)
    kinds = [[p + a + b + p for a in "abcdef" for b in "abcdef"] for p in "xy"]
    rows = [(i, " ".join(rng.choice(kinds[k % 2]) for k in range(40)), "s") for i in range(200)]
    model = op12_brown.train(documents(rows), classes=2, rounds=6)
    words = model.lexicon.words.to_pylist()
    of = {w: int(model.classes[i]) for i, w in enumerate(words)}
    assert len({of[w] for w in kinds[0]}) == 1 and len({of[w] for w in kinds[1]}) == 1 and of[kinds[0][0]] != of[kinds[1][0]]
    assert max(model.history) > model.history[0]


def test_held_out_texts_are_foreseen_better(spark):
    got = op12_brown.op12_brown(spark, "/root/testdata/sf0.001").where("held_out").agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first()
    assert got[1] > got[0] + 0.1 * got[2]
