"""Best decisions of records against the plain loop; no row for each pair."""

import datetime
import random

from codestrata.operators import evaluation


def _loop(records, decisions, words):
    out = {}
    for r, date, title in records:
        found = []
        for k, other, topic in decisions:
            gap = abs((date - other).days) if date and other else 99
            shared = len(words(title) & words(topic))
            if gap <= 30:
                found.append((-shared, gap, k))
        best = min((f for f in found if f[0]), default=None)
        out[r] = (bool(found), best[2] if best else None, -best[0] if best else 0)
    return out


def test_matches_the_loop_in_small_blocks(spark, monkeypatch):
    rng = random.Random(7)
    names = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta"]
    day = lambda: rng.choice([None, *[datetime.date(2024, 1, 1) + datetime.timedelta(rng.randint(0, 200)) for _ in range(9)]])
    text = lambda: " ".join(rng.choices(names, k=rng.choice([0, 1, 2, 5])))
    records = [(i, day(), text()) for i in range(120)] + [(500, datetime.date(2030, 1, 1), "alpha")]
    decisions = [(i, day(), text()) for i in range(90)]
    schema = "{} int, date string, {} string"
    frame = lambda rows, a, b: spark.createDataFrame([(k, str(d) if d else None, t) for k, d, t in rows], schema.format(a, b))
    want = _loop(records, decisions, lambda t: set(t.split()))
    for size in (2_000_000, 10):
        monkeypatch.setattr(evaluation, "BLOCK_WORDS", size, raising=False)
        got = evaluation.match_records(frame(records, "record", "title"), frame(decisions, "decision", "topic")).collect()
        assert {r["record"]: (r["temporal"], r["decision"], r["shared"]) for r in got} == want
    empty = frame(decisions, "decision", "topic").limit(0)
    assert all(r["decision"] is None for r in evaluation.match_records(frame(records, "record", "title"), empty).collect())


def test_no_rows_for_pairs(spark):
    """300 records and 300 decisions that share every word give no join on words, whose rows would be pairs times words."""
    records = spark.range(300).selectExpr("id as record", "'2024-01-01' as date", "'alpha beta gamma' as title")
    decisions = spark.range(300).selectExpr("id as decision", "'2024-01-05' as date", "'alpha beta gamma' as topic")
    got = evaluation.match_records(records, decisions)
    assert {(r["decision"], r["shared"]) for r in got.collect()} == {(0, 3)} and "[word" not in got._jdf.queryExecution().toString()
