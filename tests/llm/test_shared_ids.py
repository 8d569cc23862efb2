"""Rows without an id of their own: several null ids, and rows that repeat an id."""

from collections import Counter

from codestrata.llm import op7_mixing, op9_substrings, op10_minhash


def _text(mark, n=30):
    return " ".join(f"{mark}{i}" for i in range(n))


A, B, C, D = (_text(x) for x in "abcd")
ROWS = [(1, A, "s"), (2, B, "s"), (None, A, "s"), (None, C, "s"), (None, D, "t"), (2, B, "s"), (2, _text("e"), "s"), (None, C + " " + _text("f"), "t"),
        (3, None, "s"), (None, None, "s"), (None, None, "s")]


def test_substrings(documents):
    got = Counter((r["doc_id"], r["text"] or "") for r in op9_substrings.dedup(documents(ROWS).repartition(3)).collect())
    # of C and C with a tail the one whose digest comes first keeps the passage
    tails = Counter({(None, C): 1, (None, _text("f")): 1}), Counter({(None, ""): 1, (None, C + " " + _text("f")): 1})
    rest = Counter({(1, A): 1, (2, B): 1, (None, D): 1, (2, ""): 1, (2, _text("e")): 1, (3, ""): 1, (None, ""): 3})
    assert got in [rest + x for x in tails]


def test_near(documents):
    docs = documents(ROWS).repartition(3)
    kept = Counter((r["doc_id"], r["text"]) for r in op10_minhash.keep_one(docs).collect())
    want = Counter((i, t) for i, t, _ in ROWS) - Counter([(None, A), (2, B)])
    assert kept == want
    assert Counter((r["doc_id"], r["text"]) for r in op10_minhash.keep_one(docs, also=((5, 80),)).collect()) == want
    linked = op10_minhash.link(docs).collect()
    assert len(linked) == len(ROWS)
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in linked if not r["kept"]) == [("2", "2"), ("None", "1")]


def test_mix_draws_each_row(documents):
    rows = [(None, _text("x", n), s) for n in range(1, 40) for s in ("a", "b", "c")]
    docs = documents(rows).repartition(3)
    sizes = Counter((r["source"], r["size"]) for r in op7_mixing.mix(docs).collect() for _ in range(r["copies"]))
    assert Counter((r["source"], len(r["text"].split())) for r in op7_mixing.emit(docs).collect()) == sizes
