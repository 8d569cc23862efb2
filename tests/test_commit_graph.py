"""Labels on the commit graph against walks of it, on random histories with nested and criss-cross merges."""

import random

import pytest

from codestrata.operators import commit_graph

PARENTS = "hash string, parent string, ord int"


def history(seed, n=60):
    """parents of each commit, oldest first; the last one is the head."""
    rng = random.Random(seed)
    parents = {"c0": []}
    for i in range(1, n):
        mine = [f"c{max(0, i - 1 - int(rng.random() ** 3 * 8))}"]
        if rng.random() < 0.35:
            other = f"c{max(0, i - 1 - int(rng.random() * 12))}"
            if other not in mine:
                mine.append(other)
        parents[f"c{i}"] = mine
    return parents


def reached(parents, start):
    seen, open_ = set(), [start]
    while open_:
        commit = open_.pop()
        if commit not in seen:
            seen.add(commit)
            open_ += parents[commit]
    return seen


def chain_of(parents, start):
    chain = [start]
    while parents[chain[-1]]:
        chain.append(parents[chain[-1]][0])
    return chain


def relation(spark, parents):
    return spark.createDataFrame([(c, p, i) for c, ps in parents.items() for i, p in enumerate(ps)], PARENTS)


def brought(parents, numbers, head, inside=None):
    """The merge rule, walked: main merges oldest first; what an unnumbered one brought is a history of its own."""
    inside = set(parents) if inside is None else inside
    chain = [c for c in chain_of(parents, head) if c in inside]
    out, taken = {}, set(chain)
    for merge in reversed(chain):
        mine = (reached(parents, merge) & inside) - taken
        taken |= mine
        if merge in numbers:
            out |= dict.fromkeys(mine, numbers[merge])
        elif mine and len(parents[merge]) > 1 and parents[merge][1] in mine:
            out |= brought(parents, numbers, parents[merge][1], mine)
    return out


@pytest.mark.parametrize("seed", [3])
def test_entries_and_ranges(spark, seed):
    parents = history(seed)
    df, head, base = relation(spark, parents), "c59", "c37"
    chain = chain_of(parents, head)
    got = {r["hash"]: (r["step"], r["entry_step"]) for r in commit_graph.entries(df, commit_graph.one_head(df, head)).collect()}
    assert set(got) == reached(parents, head)
    for commit, (step, entry) in got.items():
        assert step == (chain.index(commit) if commit in chain else None)
        assert entry == max(i for i, c in enumerate(chain) if commit in reached(parents, c))
    spans = {r["hash"] for r in commit_graph.commits_in_range(df, base, head).collect()}
    assert spans == {c for c in reached(parents, head) - reached(parents, base) if len(parents[c]) < 2}
    whole = {r["hash"] for r in commit_graph.commits_in_range(df, commit_graph.EMPTY_TREE, head).collect()}
    assert whole == {c for c in reached(parents, head) if len(parents[c]) < 2}


@pytest.mark.parametrize("seed", [3])
def test_pull_requests(spark, seed):
    parents = history(10 + seed)
    numbers = {c: int(c[1:]) for c, ps in parents.items() if len(ps) == 2 and int(c[1:]) % 3}
    numbered = spark.createDataFrame(list(numbers.items()), "hash string, number long")
    got = {r["hash"]: r["number"] for r in commit_graph.pull_request_commits(relation(spark, parents), numbered, "c59").collect()}
    want = brought(parents, numbers, "c59")
    assert got == {c: n for c, n in want.items() if len(parents[c]) < 2} and got


def test_resolved_ranges(spark):
    parents = {"a": [], "b": ["a"], "c": ["b"], "d": ["b"], "e": ["c", "d"], "x": ["b"]}
    df = relation(spark, parents)
    commits = spark.createDataFrame([(c,) for c in parents], "hash string")

    def ask(base, count=2):
        return tuple(commit_graph.resolve_range(df, commits, "e", base, count).first())

    assert ask("d") == ("d", "e", False, None)  # any ancestor, not only a first parent
    assert ask("x") == ("b", "e", False, "x is not an ancestor of HEAD (force push?)")
    assert ask("missing-commit-name") == ("b", "e", False, "base missing-comm is not a commit in this history")
    assert ask("0" * 40) == ask(None) == ("b", "e", False, None)
    assert ask(None, 9) == (commit_graph.EMPTY_TREE, "e", True, None)
    assert ask(None, 0) == ("c", "e", False, None)


def test_long_histories_take_few_rounds(spark, monkeypatch):
    rounds = []
    twice = commit_graph._twice
    monkeypatch.setattr(commit_graph, "_twice", lambda jump: rounds.append(1) or twice(jump))
    parents = {"c0": [], **{f"c{i}": [f"c{i - 1}"] for i in range(1, 300)}}
    chain = commit_graph.first_parent_chain(relation(spark, parents), "c299")
    assert {r["hash"]: r["step"] for r in chain.collect()} == {f"c{i}": 299 - i for i in range(300)}
    assert len(rounds) <= 9
    points = {r["step"] for r in commit_graph.spread_over(chain, 4).collect()}
    assert points == {299, 199, 100, 0}
    assert commit_graph.spread_over(chain, 1000).count() == 300


def test_one_labelling_answers_all_ranges_of_a_head(spark, monkeypatch):
    df = relation(spark, {"a": [], "b": ["a"], "c": ["b"], "d": ["b"], "e": ["c", "d"]})
    commits, found = df.select("hash").distinct(), commit_graph.entries(df, commit_graph.one_head(df, "e"))
    monkeypatch.setattr(commit_graph, "chains", None)  # nothing is walked again
    answers = [tuple(commit_graph.resolve_range(df, commits, "e", base, 2, found).first()) for base in ("d", None)]
    assert answers == [("d", "e", False, None), ("b", "e", False, None)]


def test_contraction_follows_long_histories_in_few_rounds(spark, monkeypatch):
    """Chains by contraction, with side lines hanging off the history, several heads and more pointers than one task follows."""
    rng = random.Random(5)
    parents = {f"c{i}": [f"c{i - 1}"] if i else [] for i in range(400)}
    parents |= {f"s{i}": [f"s{i - 1}" if i % 7 else f"c{rng.randrange(400)}"] for i in range(140)}
    parents |= {f"d{i}": [f"d{i - 1}"] if i else [] for i in range(50)}
    first = commit_graph.first_parents(relation(spark, parents))
    heads, levels, joins = ["c399", "d49"], [], []
    spliced, twice = commit_graph._spliced, commit_graph._twice
    monkeypatch.setattr(commit_graph, "FOLLOWED", 30)
    monkeypatch.setattr(commit_graph, "_spliced", lambda pointers, level: levels.append(pointers.count()) or spliced(pointers, level))
    monkeypatch.setattr(commit_graph, "_twice", lambda jump: joins.append(1) or twice(jump))
    got = commit_graph.chains(first, spark.createDataFrame([(h,) for h in heads], "hash string")).collect()
    assert {(r["head"], r["hash"], r["step"]) for r in got} == {(h, c, i) for h in heads for i, c in enumerate(chain_of(parents, h))} and len(got) == 450
    assert not joins and 3 < len(levels) < 20 and sum(levels) < 5 * levels[0]  # a few times the commits in all, not so many a round


@pytest.mark.parametrize("steps", [0, 2])
def test_labels_move_along_first_parents_in_few_rounds(spark, monkeypatch, steps):
    """A long side line that a merge brings is labelled by doubling; commits the head does not reach cost no longer pointers."""
    made, twice = [], commit_graph._twice
    monkeypatch.setattr(commit_graph, "STEPS", steps)
    monkeypatch.setattr(commit_graph, "_twice", lambda jump: made.append(1) or twice(jump))
    parents = {"c0": [], "c1": ["c0"], "s0": ["c0"], **{f"s{i}": [f"s{i - 1}"] for i in range(1, 20)}, "c2": ["c1", "s19"], "c3": ["c2", "s9"],
               "n0": ["c3"], **{f"n{i}": [f"n{i - 1}"] for i in range(1, 100)}}
    df = relation(spark, parents)
    got = {r["hash"]: r["entry_step"] for r in commit_graph.entries(df, commit_graph.one_head(df, "c3")).collect()}
    assert got == {"c3": 0, "c2": 1, "c1": 2, "c0": 3} | {f"s{i}": 1 for i in range(20)}
    assert 1 <= len(made) <= 6


def test_nothing_lies_between_a_commit_and_one_it_reaches(spark):
    df = relation(spark, {"a": [], "b": ["a"], "c": ["b"]})
    assert commit_graph.commits_in_range(df, "c", "b").count() == 0
    assert [r["hash"] for r in commit_graph.commits_in_range(df, "a", "c").orderBy("hash").collect()] == ["b", "c"]
