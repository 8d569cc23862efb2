"""Substring and near-dedup on awkward and skewed rows, against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from codestrata.llm import op9_substrings, op10_minhash
from codestrata.llm.shingles import Words, rolled, sliding
from tests.llm import brute


def test_words_and_rolling():
    texts = ["a b\tc", None, "", " \x0b x\x0cy\r\n", "é\x1c z", "A\xa0B"]
    for lower in (False, True):
        w = Words(pa.array(texts), lower=lower)
        want = [brute.words(brute.lower(t) if lower else t) for t in texts]
        assert w.words.to_pylist() == [x for t in want for x in t] and w.counts.tolist() == [len(t) for t in want]
    values = np.random.default_rng(0).integers(0, 5, 200).astype(np.uint64)
    for k in (1, 3, 8, 13, 20):
        assert sliding(values, k, np.minimum).tolist() == [values[i:i + k].min() for i in range(200)]
        hashes = rolled(values, k)
        kinds = {}
        assert len(hashes) == 201 - k
        for i, h in enumerate(hashes.tolist()):
            assert kinds.setdefault(tuple(values[i:i + k].tolist()), h) == h
        assert len(set(kinds.values())) == len(kinds)
    assert len(rolled(values[:2], 3)) == 0


def _check_substrings(docs, rows):
    want = brute.substrings({i: t for i, t, _ in rows})
    got = op9_substrings.dedup(docs, want_text=False).collect()
    assert len(got) == len(rows)
    for r in got:
        w, kept = want[r["doc_id"]]
        assert (r["n_words"], r["n_removed"]) == (len(w), len(w) - len(kept)), r["doc_id"]
        assert r["kept_sha256"] == hashlib.sha256(" ".join(kept).encode()).hexdigest()


def test_substrings(documents, awkward):
    _check_substrings(documents(awkward), awkward)


def test_substrings_overlaps_and_hot_passages(documents):
    rng = random.Random(9)
    few = ["a", "b", "c"]
    passage = " ".join(rng.choice("defgh") + str(i) for i in range(55))
    rows = [(i, " ".join(rng.choice(few) for _ in range(rng.randint(15, 70))), "s") for i in range(60)]
    rows += [(100 + i, f"w{i} " * 3 + passage + f" end{i}", "s") for i in range(120)]
    rows += [(300 + i, passage, "s") for i in range(40)] + [(400, "rep " * 4000, "s")]
    _check_substrings(documents(rows), rows)


def test_automata_locate_every_occurrence(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    words = Words(pa.array(texts))
    k = op9_substrings.PHRASE
    places = [int(i) for i in np.flatnonzero(words.left() >= k)]
    phrase = {p: tuple(words.codes[p:p + k].tolist()) for p in places}
    kinds = sorted({phrase[p]: p for p in reversed(places)}.values())[:90]
    apart = words.owner == 5
    want = sorted((p, i) for i, kind in enumerate(kinds) for p in places if phrase[p] == phrase[kind] and words.owner[p] != 5)
    for shard in (7, 1 << 17):
        monkeypatch.setattr(op9_substrings, "SHARD", shard)
        at, row = op9_substrings._occurrences(words, np.array(kinds), apart)
        assert sorted(zip(at.tolist(), row.tolist(), strict=True)) == want
    numbers = np.array([1, 0xD7FF, 0xD800, 1 << 20])
    assert len(set(op9_substrings._letters(numbers))) == 4


def test_automata_carry_the_result(monkeypatch):
    """What the automata do not locate is not removed."""
    passage = " ".join(f"p{i}" for i in range(20))
    words = Words(pa.array([passage, passage]))
    at, phrases = op9_substrings._phrases(words)
    spans = op9_substrings._spans(words, at, op9_substrings._Ranges(words, 1))
    first = at < 20
    n = int(first.sum())
    told = pa.table({"kind": [2] * n, "h1": phrases[first].view(np.int64), "h2": spans[first].view(np.int64), "id": [1] * n, "start": at[first],
                     "own": [1] * n, "begin": at[first]})
    ids, copies = np.array([1, 2]), np.zeros(2, bool)
    assert op9_substrings._covered(words, ids, copies, told).tolist() == [False] * 20 + [True] * 20
    monkeypatch.setattr(op9_substrings, "_occurrences", lambda *_: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert not op9_substrings._covered(words, ids, copies, told).any()


def test_substrings_text_and_columns(documents):
    long = " ".join(f"w{i}" for i in range(30))
    docs = documents([(1, long + "\n  x", "s"), (2, "y  y\t" + long, None), (None, None, "s"), (3, " spaced  out ", "s")]).withColumn("n_words", F.lit("mine"))
    got = {r["doc_id"]: r for r in op9_substrings.dedup(docs).collect()}
    assert got[1]["text"] == long + "\n  x" and got[2]["text"] == "y y" and got[3]["text"] == " spaced  out "
    assert got[None]["text"] in (None, "") and got[2]["source"] is None and got[2]["n_words"] == 32
    assert op9_substrings.dedup(documents([])).count() == 0


def _check_near(docs, rows):
    want = brute.near({i: t for i, t, _ in rows})
    got = op10_minhash.link(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r["doc_id"]
        assert r["kept"] == (r["component_id"] == r["doc_id"])


def test_near(documents, awkward):
    _check_near(documents(awkward), awkward)


def _skewed(rng, groups, copies, stable):
    vocabulary = [f"v{i}" for i in range(3000)]
    rows, line = [], " ".join(rng.choice(vocabulary) for _ in range(40))
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(120)]
        for c in range(copies if g == 0 else 3):
            w = list(base)
            for _ in range(rng.randint(1, 6)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(w), "s"))
    for _ in range(stable):  # unlike texts that share a long line
        rows.append((len(rows), line + "\n" + " ".join(rng.choice(vocabulary) for _ in range(rng.randint(10, 90))), "s"))
    return rows


def test_near_hot_groups_and_common_lines(documents):
    rows = _skewed(random.Random(4), 25, 260, 240)
    _check_near(documents(rows), rows)


def test_near_small_nodes_branch(documents, monkeypatch):
    monkeypatch.setattr(op10_minhash, "SMALL", 40)
    rows = _skewed(random.Random(8), 10, 60, 80)
    _check_near(documents(rows), rows)


def test_near_keep_one(documents):
    docs = documents([(5, "a b c d", "s"), (2, "A b c  d", "t"), (None, None, None), (7, "", "s"), (8, "other words here", "s")]).withColumn("kept", F.lit("mine"))
    got = op10_minhash.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in got.collect()) == ["2", "7", "8", "None"]
    assert op10_minhash.link(documents([])).count() == 0
    alone = {r["doc_id"]: r for r in op10_minhash.link(docs).collect()}
    assert alone[7]["n_shingles"] == 0 and alone[7]["component_id"] == 7 and alone[None]["kept"]
