"""The scripted eight-commit history, and skewed inputs against plain Python."""

import random

from pyspark.sql import functions as F

from codestrata.operators import decisions, history, temporal
from codestrata.session import global_index, running_total
from codestrata.sources import gitlog

# presence of import edges over eight snapshots
EDGES = {("controller.py", "service.py"): range(0, 8), ("controller.py", "database.py"): range(2, 7), ("service.py", "cache.py"): range(4, 8)}


def presence(spark):
    return spark.createDataFrame([(a, b, i) for (a, b), at in EDGES.items() for i in at], "`from` string, `to` string, idx long")


def last(spark, n=7):
    return spark.createDataFrame([(n,)], "last long")


def test_intervals(spark):
    got = {(r["from"], r["to"]): (r["valid_from_idx"], r["valid_to_idx"]) for r in temporal.intervals(presence(spark), ["from", "to"], last(spark)).collect()}
    assert got == {("controller.py", "service.py"): (0, None), ("controller.py", "database.py"): (2, 7), ("service.py", "cache.py"): (4, None)}


def test_diffs_leave_the_first_snapshot_empty(spark):
    got = {(r["to"], r["idx"], r["change"]) for r in temporal.diffs(presence(spark), ["from", "to"], last(spark)).collect()}
    assert got == {("database.py", 2, "added"), ("database.py", 7, "removed"), ("cache.py", 4, "added")}


def test_intervals_match_a_loop_on_random_presence(spark):
    rng = random.Random(7)
    rows = sorted({(f"e{rng.randrange(6)}", rng.randrange(12)) for _ in range(50)})
    expected = set()
    for key in {k for k, _ in rows}:
        at = {i for k, i in rows if k == key}
        for start in sorted(i for i in at if i - 1 not in at):
            end = next(i for i in range(start, 13) if i not in at)
            expected.add((key, start, end if end <= 11 else None))
    df = spark.createDataFrame(rows, "e string, idx long")
    got = {tuple(r) for r in temporal.intervals(df, ["e"], last(spark, 11)).select("e", "valid_from_idx", "valid_to_idx").collect()}
    assert got == expected


def test_sampling_is_even_and_ends_at_head(spark):
    commits = spark.createDataFrame([(i,) for i in range(8)], "idx long")
    assert sorted(r[0] for r in temporal.evenly_spaced(commits, 4).collect()) == sorted({round(i * 7 / 3) for i in range(4)})
    assert temporal.evenly_spaced(commits, 12).count() == 8


def test_largest_moves_break_ties(spark):
    health = spark.createDataFrame([(0, 90.0), (1, 80.0), (2, 90.0), (3, 80.0), (4, 90.0), (5, None)], "idx long, health double")
    got = {r["move"]: r["idx"] for r in temporal.largest_moves(temporal.trend(health)).collect()}
    assert got == {"largest_drop": 1, "largest_gain": 4}


def test_global_index_with_one_hot_key(spark):
    rows = [("hot" if i % 3 else f"k{i}", i) for i in range(900)]
    df = spark.createDataFrame(rows, "key string, n long")
    got = {(r["key"], r["n"]): r["idx"] for r in global_index(df, [F.col("key"), F.col("n")]).collect()}
    assert got == {row: i for i, row in enumerate(sorted(rows))}


def test_running_total(spark):
    rows = [(f"p{i:03d}", i * 7 % 13) for i in range(300)]
    got = {r["p"]: r["before"] for r in running_total(spark.createDataFrame(rows, "p string, n long"), [F.col("p")], "n", "before").collect()}
    total = 0
    for p, n in rows:
        assert got[p] == total
        total += n


LOG = ("\x1eaaaa1111\x1f\x1fAnn\x1fANN@x.org\x1f1700000000\x1fFirst \x1f body\n\x1f\x00\n3\t1\ta.py\x00-\t-\tlogo.png\x00"
       "\x1ebbbb2222\x1faaaa1111\x1f \x1f\x1fnever\x1fRename\x1f\x1f\x00\n0\t0\t\x00utils.py\x00helpers.py\x00")


def test_log_text(spark, tmp_path):
    path = tmp_path / "log.txt"
    path.write_text(LOG)
    commits = gitlog.parse_commits(gitlog.read_log(spark, str(path)))
    by_hash = {r["hash"]: r for r in commits.collect()}
    assert by_hash["aaaa1111"]["author"] == "Ann" and by_hash["aaaa1111"]["body"] == "body" and by_hash["aaaa1111"]["timestamp"] == 1_700_000_000
    assert by_hash["bbbb2222"]["author"] == "unknown" and by_hash["bbbb2222"]["timestamp"] == 0 and by_hash["bbbb2222"]["parents"] == ["aaaa1111"]
    files = {(r["path"], r["old_path"], r["added"], r["deleted"]) for r in gitlog.commit_files(commits).collect()}
    assert files == {("a.py", None, 3, 1), ("logo.png", None, 0, 0), ("helpers.py", "utils.py", 0, 0)}


def test_range_resolution(spark):
    chain = spark.createDataFrame([(f"c{i}", i) for i in range(4)], "hash string, step int")
    pick = lambda base, n: history.resolve_range(chain, F.lit("c0"), base, n, "empty").first().asDict()
    assert pick(F.lit("c3"), 1) == {"head": "c0", "base": "c3", "empty_base": False, "fell_back": False}
    assert pick(F.lit("gone"), 2) == {"head": "c0", "base": "c2", "empty_base": False, "fell_back": True}
    assert pick(None, 9) == {"head": "c0", "base": "empty", "empty_base": True, "fell_back": False}


def test_rank_matches_the_greedy_loop(spark):
    rng = random.Random(3)
    kinds = list(decisions.KIND_WEIGHT)
    rows = [(f"s{rng.randrange(9)}", f"2024-01-{rng.randrange(1, 28):02d}", rng.choice(kinds), f"subject {i}", rng.randrange(1, 40) / 10, rng.randrange(1, 9)) for i in range(60)]
    df = spark.createDataFrame(rows, "sha string, date string, kind string, subject string, significance double, n_files long")
    ranked = [(r["sha"], r["kind"], r["subject"]) for r in decisions.rank(df).collect()]
    with_ids = decisions.rank(df, limit=60, per_kind=60).count()
    import hashlib
    import math
    ident = lambda r: hashlib.sha1(f"{r[0]}|{r[2]}|{r[3]}".encode()).hexdigest()[:10]
    score = lambda r: decisions.KIND_WEIGHT[r[2]] * r[4] * (1 + math.log1p(r[5]))
    bucket = lambda r: "dependency" if r[2].startswith("dependency") else r[2]
    kept, used, seen = [], {}, set()
    for r in sorted(rows, key=lambda r: (-score(r), r[1], ident(r))):
        if (r[0], bucket(r)) not in seen and used.get(bucket(r), 0) < 3 and len(kept) < 8:
            kept.append((r[0], r[2], r[3]))
            seen.add((r[0], bucket(r)))
            used[bucket(r)] = used.get(bucket(r), 0) + 1
    assert sorted(ranked) == sorted(kept)
    assert with_ids >= len(kept)


def test_structure_and_pickaxe(spark):
    rows = [("src/api", f"src/api/{i}.py", s) for i in range(3) for s in (1, 2)] + [("old", f"old/{i}.py", 0) for i in range(3)]
    got = {(r["folder"], r["idx"], r["change"], r["n"]) for r in decisions.folder_changes(spark.createDataFrame(rows, "folder string, path string, idx long"), last(spark, 2)).collect()}
    assert got == {("src/api", 1, "appeared", 3), ("old", 1, "vanished", 3)}
    versions = spark.createDataFrame([("h0", None, "c.py", "x = 1"), ("h1", "h0", "c.py", "db.save()"), ("h2", "h1", "c.py", "db.save()  # same"), ("h3", "h2", "c.py", "")],
                                     "hash string, parent string, path string, content string")
    needles = spark.createDataFrame([("c.py", "save")], "path string, needle string")
    assert {r["hash"] for r in decisions.pickaxe(versions, needles).collect()} == {"h1", "h3"}
