"""The near-dedup stage against brute force with both of its measures."""

import random

import corpus_pipeline
from tests.llm import brute


def _linked(texts, k, percent):
    sets = {i: brute.shingles(t, k) for i, t in texts.items()}
    return [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]


def test_blocks_and_scattered_changes(spark, documents):
    rng = random.Random(12)
    prose = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows = []
    for g in range(12):
        base, extra = prose(200), prose(60)
        spread = list(base)
        for at in range(8, 200, 40):  # J = 0.86 with three words, 0.78 with five
            spread[at] = f"new{g}x{at}"
        for w in (base, base + extra[:38], base + extra[:44], base + extra, base[:164], base[:140], spread):
            rows.append((len(rows), " ".join(w), "s"))
    texts = {i: t for i, t, _ in rows}
    old, new = _linked(texts, 3, 85), _linked(texts, 5, 80)
    assert set(new) - set(old) and set(old) - set(new)
    top = brute.reach(list(texts), old + new)
    got = corpus_pipeline.near_dedup(spark, documents(rows), "").collect()
    assert sorted(r["doc_id"] for r in got) == [i for i in texts if top[i] == i]
