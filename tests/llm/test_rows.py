"""Packing, quality rules, sharding and mixing on awkward rows, against brute force."""

import math
import random
import zlib
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from codestrata.llm import op1_packing, op2_quality_rules, op3_sharding, op7_mixing
from codestrata.llm.common import components, with_slots
from tests.llm import brute


def test_slots_are_gapless(spark):
    rows = [(g, i % 3, i) for i, g in enumerate(["a"] * 500 + ["b"] * 3 + [None] * 40)]
    got = with_slots(spark.createDataFrame(rows, "g string, o int, i int").repartition(7), ["g"], ["o", "i"], "slot").collect()
    for g in ("a", "b", None):
        mine = sorted((r["slot"], r["o"], r["i"]) for r in got if r["g"] == g)
        assert [m[0] for m in mine] == list(range(len(mine)))
        assert [m[1:] for m in mine] == sorted(m[1:] for m in mine)


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 180)] + [(500, i) for i in range(501, 700)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(150)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = brute.reach({x for p in links for x in p}, links)
    assert got == {i: c for i, c in want.items() if i in got} and all(want[i] == i for i in set(want) - set(got))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality_measures(documents, awkward):
    got = {r["doc_id"]: r for r in op2_quality_rules.apply_policy(op2_quality_rules.ledger(documents(awkward)), "v1").collect()}
    for i, text, _ in awkward:
        want = brute.measures(text)
        assert {k: got[i][k] for k in want} == want, i
        assert got[i]["kept"] == brute.kept_v1(text), i
    assert not got[10]["kept"] and not got[16]["kept"] and got[20]["kept"] and not got[19]["kept"]


def test_quality_ablations_read_only_bits(documents, awkward):
    rows = op2_quality_rules.ledger(documents(awkward))
    bits = [r["fail_bits"] for r in rows.collect()]
    for r in op2_quality_rules.ablations(rows).collect():
        mask, allowed = next((m, a) for v, m, a in op2_quality_rules.POLICIES if v == r["version"])
        without = mask & ~op2_quality_rules.BIT[r["rule"]]
        assert r["kept"] == sum((b & mask).bit_count() <= allowed for b in bits)
        assert r["kept_without"] == sum((b & without).bit_count() <= allowed for b in bits)


def test_quality_empty_and_clashing(spark, documents):
    assert op2_quality_rules.ledger(documents([])).count() == 0
    extra = documents([(1, "a b", "s")]).withColumn("n_words", F.lit("mine")).withColumn("_other", F.lit(1))
    row = op2_quality_rules.ledger(extra).first()
    assert row["n_words"] == 2 and row["_other"] == 1


def _shard(doc_id, n, base=40):
    """Level by level down the tree of 5 shards a rack and 2 racks a region, later shards against the winning region's draw."""
    def draw(level, node, weight):
        seed = xxhash.xxh64_intdigest(level.encode(), seed=xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), seed=42))
        h = xxhash.xxh64_intdigest(node.to_bytes(4, "little"), seed=seed)
        return -math.log(((h >> 12) + 0.5) / (1 << 52)) / weight, node
    below = lambda width, node: len(range(node * width, min((node + 1) * width, base)))
    least, region = min(draw("region", r, below(10, r)) for r in range(-(-base // 10)))
    rack = min(draw("rack", r, below(5, r)) for r in (region * 2, region * 2 + 1) if below(5, r))[1]
    shard = min(draw("shard", s, 1) for s in range(rack * 5, min(rack * 5 + 5, base)))[1]
    return min([(least, shard)] + [draw("increment", s, 1) for s in range(base, n)])[1]


def test_sharding(documents, awkward):
    rows = awkward + [(1000 + i, "t", "s") for i in range(3000)]
    got = op3_sharding.shard(documents(rows)).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    texts = {i: t for i, t, _ in rows}
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
        assert r["shard"] == _shard(r["doc_id"], 40)
        assert r["grown_shard"] == _shard(r["doc_id"], 41) and r["grown_shard"] in (r["shard"], 40)
        by[r["shard"]].append(r["slot"])
    assert set(by) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in by.values())


def test_sharding_weights_move_only_through_what_grew(documents):
    docs = documents([(i, "t", "s") for i in range(4000)])
    before = {r["doc_id"]: r["shard"] for r in op3_sharding.assign(docs).collect()}
    after = {r["doc_id"]: r["shard"] for r in op3_sharding.assign(docs, weights={17: 3.0}).collect()}
    moved = [(before[i], after[i]) for i in before if before[i] != after[i]]
    # into region 1 from others, inside it into rack 3, inside that into shard 17
    assert moved and all(b // 10 == 1 and (a // 10 != 1 or (b // 5 == 3 and (a // 5 != 3 or b == 17))) for a, b in moved)
    share = sum(s == 17 for s in after.values()) / len(after)
    assert abs(share - 3 / 42) < 0.02
    drained = {r["doc_id"]: r["shard"] for r in op3_sharding.assign(docs, weights={17: 0.0}).collect()}
    assert 17 not in drained.values() and all(drained[i] // 10 == s // 10 for i, s in before.items() if s // 10 != 1)


def test_sharding_grows_by_increments(documents):
    docs = documents([(i, "t", "s") for i in range(3000)])
    for shards, base in ((1, 1), (7, 7), (43, 40), (13, 12)):
        got = {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in op3_sharding.assign(docs, shards, base=base).collect()}
        assert got == {i: (_shard(i, shards, base), _shard(i, shards + 1, base)) for i in got}
    with pytest.raises(ValueError):
        op3_sharding.tree_weights(2, {0: 0.0, 1: 0.0})


def test_sharding_nulls_and_empty(documents):
    assert op3_sharding.shard(documents([])).count() == 0
    got = op3_sharding.shard(documents([(None, None, None), (None, None, None), (3, "x", "s")])).collect()
    assert len(got) == 3 and len({r["shard"] for r in got if r["doc_id"] is None}) == 1


def _targets(sizes):
    """Sharing the excess until nobody is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not full:
            return out | {s: weight[s] * level for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_mixing(documents, awkward):
    rng = random.Random(5)
    rows = awkward + [(2000 + i, "w " * rng.randint(0, 90), rng.choice(["hot"] * 6 + ["p", "q", "ü"])) for i in range(1500)]
    got = op7_mixing.mix(documents(rows)).collect()
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(brute.words(text))
    want, taken, largest = _targets(sizes), defaultdict(int), defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], abs_tol=1e-6)
        assert r["taken"] == r["copies"] * r["size"] and r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert len(got) == len(rows)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * largest[s] + 1, s
    again = {r["doc_id"]: r["taken"] for r in op7_mixing.mix(documents(rows[::-1])).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}


def test_mixing_emits_copies(documents, awkward):
    docs = documents(awkward)
    copies = {r["doc_id"]: r["copies"] for r in op7_mixing.mix(docs).collect()}
    emitted = defaultdict(int)
    for r in op7_mixing.emit(docs).collect():
        emitted[r["doc_id"]] += 1
    assert emitted == {i: c for i, c in copies.items() if c}
    assert op7_mixing.emit(documents([])).count() == 0 and op7_mixing.emit(documents([])).columns == docs.columns
    blank = op7_mixing.mix(documents([(1, None, None), (1, None, None)])).collect()
    assert [r["taken"] for r in blank] == [0, 0]


def test_packing_boundaries_are_optimal():
    rng = random.Random(2)
    for _ in range(60):
        lengths = [rng.choice([rng.randint(0, 12), rng.randint(0, 60)]) for _ in range(rng.randint(1, 14))]
        buckets = rng.randint(1, 4)
        kinds = sorted(set(lengths))
        bins = [(n, lengths.count(n), n * lengths.count(n)) for n in kinds]
        edges = op1_packing.boundaries(bins, buckets)
        assert len(edges) <= buckets and brute.padding(lengths, edges) == brute.least_padding(lengths, buckets)
    assert op1_packing.boundaries([]) == []


def test_packing(documents, awkward):
    rows = awkward * 2
    got = op1_packing.pack(documents(rows), buckets=5, budget=256).collect()
    assert len(got) == len(rows)
    counts = {i: len(brute.words(t)) for i, t, _ in rows}
    batches = defaultdict(list)
    for r in got:
        assert r["n_words"] == counts[r["doc_id"]] <= r["pad_to"]
        batches[r["bucket"], r["batch"]].append(r)
    edges = {r["bucket"]: r["pad_to"] for r in got}
    assert len(edges) <= 5 and sorted(edges.values()) == [edges[b] for b in sorted(edges)]
    for rows_ in batches.values():
        assert len(rows_) == 1 or len(rows_) * rows_[0]["pad_to"] <= 256
        assert sorted(r["row_in_batch"] for r in rows_) == list(range(len(rows_)))
    for bucket in edges:
        numbers = sorted(b for k, b in batches if k == bucket)
        room = max(1, 256 // max(edges[bucket], 1))
        assert numbers == list(range(len(numbers))) and all(len(batches[bucket, b]) == room for b in numbers[:-1])
    assert op1_packing.pack(documents([])).count() == 0
