"""The divergence audit and its transducers against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codestrata.llm import op11_divergence
from tests.llm import brute

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def found(text):
    return TERM.findall(brute.lower(text))


def audit(rows, least=3, top=200):
    """Rows of the audit from (text, lang, source) triples."""
    rows = [tuple(v or "" for v in r) for r in rows]
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        docs[lang].update(set(found(text)))
        counts[lang, source].update(found(text))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted((t for t, n in docs[lang].items() if n >= least), key=lambda t: t.encode())

        def p(count, total, kept=kept):
            return 1 + 10**9 * (count + 1) // (total + len(kept))

        n = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        ps = {s: [p(counts[lang, s][t], n[s]) for t in kept] for s in sources}
        whole = [p(sum(counts[lang, s][t] for s in sources), sum(n.values())) for t in kept]
        for s in sources:
            pair = [(sum((a - b) ** 2 // b for a, b in zip(ps[s], ps[o], strict=True)), o) for o in sources - {s}]
            term = [((a - b) ** 2 // b, t) for a, b, t in zip(ps[s], whole, kept, strict=True) if counts[lang, s][t] and a > b]
            for part, items, most in (("pair", pair, None), ("term", term, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(items[:most])]
    return sorted(out)


def skewed(seed=5):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdéüß中") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    rows = []
    for i in range(250):
        lang = rng.choice(["en", "en", "en", "fr", None])
        source = "hot" if rng.random() < 0.4 else rng.choice(["b", "B", "é", None, ""] + [f"s{k}" for k in range(9)])
        rows.append((" ".join(vocabulary[int(rng.random() ** 3 * 300)] for _ in range(rng.randint(0, 60))).upper() + "42 it's", lang, source))
    return rows + [(None, "xx", "a"), ("rare words here", "xx", "b"), ("", "yy", None), ("\x00 9 ~", "yy", "c"), ("Tail", "en", "hot"), ("tail", "en", "hot")]


def run(spark, rows, **kwargs):
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    got = op11_divergence.audit(df.withColumn("slot", F.lit("x")).withColumn("Term", F.lit(1)).withColumn("_at", F.lit(2)), **kwargs)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    return sorted(tuple(r) for r in got.collect())


def test_audit(spark):
    rows = skewed()
    assert run(spark, rows) == audit(rows)
    assert run(spark, rows, top=3) == audit(rows, top=3)


def test_many_shards_and_blocks(spark, monkeypatch):
    """Tiny shards, blocks sent one at a time, small matrices and slices give the same rows."""
    for name, value in (("SHARD_TERMS", 16), ("CELLS", 40), ("SIDE", 3), ("SLICE_BYTES", 500), ("KEPT_COUNTS", 50)):
        monkeypatch.setattr(op11_divergence, name, value)
    rows = skewed(8)
    assert run(spark, rows, most=9000) == audit(rows)


def test_awkward_and_empty(spark, awkward):
    rows = [(t, "en" if i % 3 else None, s) for i, t, s in awkward]
    assert run(spark, rows) == audit(rows)
    assert run(spark, []) == []
    assert run(spark, [(None, None, None)]) == []


def test_counts_beyond_a_long(spark):
    """The distributions stay exact where count * SCALE leaves 64 bits."""
    n, total, kinds = 7_000_000_000_123, 90_000_000_000_000_007, 1_000_003
    got = spark.createDataFrame([(n, total, kinds)], "n long, total long, kinds long").select(op11_divergence._p("n", "total").alias("p")).first()["p"]
    assert got == 1 + 10**9 * (n + 1) // (total + kinds)


@pytest.mark.parametrize("seed", range(4))
def test_transducer(seed):
    rng = random.Random(seed)
    terms = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(1, 7))).encode() for _ in range(400)})
    machine = op11_divergence.Transducer(op11_divergence.built(terms))
    asked = terms + [b"", b"a" * 40, b"zz", terms[0] + b"a", terms[5][:-1]]
    lengths = np.array([len(t) for t in asked])
    data = np.frombuffer(b"".join(asked), np.uint8)
    got = machine.ordinals(data, np.cumsum(lengths) - lengths, lengths)
    assert got.tolist() == [terms.index(t) if t in terms else -1 for t in asked]
    # minimal: no two states have the same future
    futures = set()
    states = {int(k) >> 8 for k in machine.keys} | set(machine.targets.tolist())

    def future(state):
        arcs = [(int(k) & 255, int(t)) for k, t in zip(machine.keys, machine.targets, strict=True) if int(k) >> 8 == state]
        return (bool(machine.final[state]), tuple((b, future(t)) for b, t in arcs))

    for state in states:
        futures.add(future(state))
    assert len(futures) == len(states) < sum(len(t) for t in terms)


def test_terms_of_texts():
    texts = ["", None, "Ab1cd", "é\u0080x-Ü", "", "end", "start"]
    got, owner = op11_divergence.terms(pa.array(["drop", *texts])[1:])
    want = [(i, t) for i, text in enumerate(texts) for t in found(text)]
    assert [(o, t.decode()) for o, t in zip(owner.tolist(), got.to_pylist(), strict=True)] == want
