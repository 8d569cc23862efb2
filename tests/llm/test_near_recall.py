"""Pairs at the threshold whose signatures agree on few positions."""

import random

from codestrata.llm import op10_minhash


def test_low_agreement_at_the_threshold(documents):
    rows = []
    for seed in (3727, 9907, 57555):  # 34 of 40 shingles are shared, but 92, 92 and 90 of 128 positions agree
        rng = random.Random(seed)
        w = [f"w{rng.randrange(100000)}" for _ in range(42)]
        rows += [(len(rows), " ".join(w), "s"), (len(rows) + 1, " ".join(w[:36]), "s")]
    got = {r["doc_id"]: r["component_id"] for r in op10_minhash.link(documents(rows)).collect()}
    assert got == {i: i - i % 2 for i in range(6)}
