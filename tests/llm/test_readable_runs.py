"""op9: automata read only runs of words in which a phrase can lie. op10: signatures of rows go once classes have theirs."""

from __future__ import annotations

import os
import random

import numpy as np
import pyarrow as pa

from codestrata.llm import common, op9_substrings, op10_minhash
from codestrata.llm.shingles import Words


def test_readable_places():
    rng, k = np.random.default_rng(3), op9_substrings.PHRASE
    for size in (0, 1, k - 1, k, 50, 400):
        for share in (0.0, 0.5, 0.9, 1.0):
            stream = (rng.random(size) < share) * rng.integers(1, 5, size)
            want = sorted({i for at in range(size - k + 1) if (stream[at:at + k] > 0).all() for i in range(at, at + k + 1) if i < size})
            assert op9_substrings._readable(stream).tolist() == want


def test_occurrences_read_few_words(monkeypatch):
    rng, k, read = random.Random(5), op9_substrings.PHRASE, []
    phrase = [f"p{i}" for i in range(k)]
    texts = [" ".join([f"w{rng.randrange(900)}" if rng.random() < 0.8 else rng.choice(phrase) for _ in range(300)] + phrase * 2) for _ in range(20)] + [" ".join(phrase * 3)]
    words, letters = Words(pa.array(texts)), op9_substrings._letters
    monkeypatch.setattr(op9_substrings, "_letters", lambda numbers: read.append(len(numbers)) or letters(numbers))
    coded = words.words.to_pylist()
    want = [at for at in range(len(coded) - k + 1) if coded[at:at + k] == phrase and words.left()[at] >= k]
    at, row = op9_substrings._occurrences(words, np.array(want[:1]), np.zeros(len(coded), bool))
    assert sorted(at.tolist()) == want and set(row.tolist()) == {0}
    assert read[0] == k and read[1] < len(coded) / 5  # all words were read before


def test_signatures_of_rows_are_dropped(spark, documents, monkeypatch):
    kept, cut = [], common.cut
    monkeypatch.setattr(op10_minhash, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    rows = [(i, f"one two three four {'five' if i % 2 else 'six'}", "s") for i in range(10)]
    got = op10_minhash.link(documents(rows)).collect()
    assert sorted((r["doc_id"], r["component_id"], r["n_shingles"]) for r in got) == [(i, i % 2, 3) for i in range(10)]
    signed = [df for df in kept if "signature" in df.columns and "n" in df.columns]
    assert [os.path.exists(df._cut_folder.removeprefix("file:")) for df in signed] == [False, True]  # of rows, of classes
