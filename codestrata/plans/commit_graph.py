"""Reachability queries over a commit graph made of the orders: eight orders a block. Orders 0, 6 and 7 of a block are the main
line; 1, 2, 5 a side branch that 7 merges, with a branch of its own, 3, that 4 merges into it. Of the main merges all but every
third carry a pull-request number, of the inner ones every second. The twins state each answer directly from the keys."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.operators import commit_graph
from codestrata.plans.registry import query
from codestrata.plans.tables import hash_of

KEYS = f"z AS (SELECT CAST(o_orderkey AS BIGINT) AS k, o_orderkey // 8 AS b, o_orderkey % 8 AS j, {hash_of('o_orderkey')} AS hash, (SELECT COUNT(*) // 8 FROM orders) AS nb FROM orders), y AS (SELECT * FROM z WHERE b < nb)"
# place in a block -> first parents, second parents
FIRST = {1: 0, 2: 1, 3: 1, 4: 2, 5: 4, 6: 0, 7: 6}
SECOND = {4: 3, 7: 5}


def key_hash(k: int) -> str:
    return hashlib.sha1(str(k).encode()).hexdigest()


def blocks(t) -> int:
    return t.table("orders").count() // 8


def parents(t):
    """(hash, parent, ord) of the whole blocks, by order keys: the hashes are built where rows leave (``hashed``)."""
    orders = t.table("orders").select(F.col("o_orderkey").alias("k")).filter(F.col("k") < 8 * blocks(t))
    place, first = F.col("k") % 8, F.when(F.col("k") % 8 == 0, F.col("k") - 1)
    second = None
    for at, to in FIRST.items():
        first = first.when(place == at, F.col("k") - at + to)
    for at, to in SECOND.items():
        second = (F.when if second is None else second.when)(place == at, F.col("k") - at + to)
    both = orders.select("k", F.posexplode(F.array(first, second)).alias("ord", "p")).filter("p >= 0")
    return both.select(F.col("k").cast("long").alias("hash"), F.col("p").cast("long").alias("parent"), "ord")


def hashed(found):
    return found.withColumn("hash", F.expr(hash_of("hash")))


def head(t) -> int:
    return 8 * blocks(t) - 1


def middle(t) -> int:
    """A merge of a side branch in the middle of the history."""
    return 8 * (blocks(t) // 2) + 4


CHAIN = "chain AS (SELECT hash, 3 * (nb - 1 - b) + CASE j WHEN 7 THEN 0 WHEN 6 THEN 1 ELSE 2 END AS step FROM y WHERE j IN (0, 6, 7))"


@query("first_parent_chain", f"WITH {KEYS}, {CHAIN} SELECT hash, step FROM chain")
def first_parent_chain(t):
    """The first-parent history of the newest commit, by doubling."""
    return hashed(commit_graph.first_parent_chain(parents(t), head(t)))


@query("snapshot_points", f"""WITH {KEYS}, {CHAIN}, span AS (SELECT MAX(step) AS n FROM chain), pick AS (SELECT DISTINCT CAST(round_even(i * n::DOUBLE / 19, 0) AS BIGINT) AS age FROM range(20) r(i), span)
 SELECT hash, step FROM chain, span WHERE n - step IN (SELECT age FROM pick)""")
def snapshot_points(t):
    """Twenty commits spread evenly over the first-parent history."""
    return hashed(commit_graph.spread_over(commit_graph.first_parent_chain(parents(t), head(t)), 20))


@query("commits_in_range", f"WITH {KEYS} SELECT hash FROM y WHERE j NOT IN (4, 7) AND (b > nb // 2 OR (b = nb // 2 AND j IN (5, 6)))")
def commits_in_range(t):
    """Commits after a merge of a side branch, merges left out."""
    return hashed(commit_graph.commits_in_range(parents(t), middle(t), head(t)))


@query("resolved_range", f"""WITH {KEYS}, e AS (SELECT '{commit_graph.EMPTY_TREE}' AS empty, MAX(CASE WHEN k = 8 * nb - 1 THEN hash END) AS head, MAX(CASE WHEN b = nb // 2 AND j = 4 THEN hash END) AS mid,
  MAX(CASE WHEN b = nb - 4 AND j = 6 THEN hash END) AS back, MAX(CASE WHEN b = nb // 2 AND j = 5 THEN hash END) AS late FROM y)
 SELECT 'ancestor' AS ask, mid AS base, head, false AS empty_base, CAST(NULL AS VARCHAR) AS fallback FROM e
 UNION ALL SELECT 'unknown', back, head, false, 'base 123456789012 is not a commit in this history' FROM e
 UNION ALL SELECT 'zeros', back, head, false, NULL FROM e UNION ALL SELECT 'none', back, head, false, NULL FROM e
 UNION ALL SELECT 'short', empty, mid, true, substr(late, 1, 7) || ' is not an ancestor of HEAD (force push?)' FROM e""")
def resolved_range(t):
    """Where a range starts: at a given ancestor, else some first parents back, else at the empty tree."""
    graph, newest, mid = parents(t), head(t), middle(t)
    # each head's history is labelled once, whatever is asked of it
    known = {key_hash(k): hashed(commit_graph.entries(graph, commit_graph.one_head(graph, k))) for k in (newest, mid)}
    late = key_hash(mid + 1)
    asks = [("ancestor", newest, key_hash(mid), 10), ("unknown", newest, "1234567890123456", 10), ("zeros", newest, "0" * 40, 10), ("none", newest, None, 10), ("short", mid, late, 1 << 40)]
    rows = [commit_graph.resolve_range(graph, t.commits, key_hash(at), base, count, known[key_hash(at)]).withColumn("ask", F.lit(ask)) for ask, at, base, count in asks]
    return reduce(DataFrame.unionByName, rows)


@query("pull_request_commits", f"""WITH {KEYS} SELECT hash, CASE WHEN b % 3 <> 0 THEN b + 1 ELSE 100000 + b END AS number FROM y
 WHERE (b % 3 <> 0 AND j IN (1, 2, 3, 5)) OR (b % 3 = 0 AND b % 2 = 0 AND j = 3)""")
def pull_request_commits(t):
    """The pull request that brought each commit: main merges first, then merges inside unnumbered ones."""
    place, block = F.col("k") % 8, F.expr("k div 8")
    orders = t.table("orders").select(F.col("o_orderkey").alias("k")).filter(F.col("k") < 8 * blocks(t))
    number = F.when((place == 7) & (block % 3 != 0), block + 1).when((place == 4) & (block % 2 == 0), block + 100000)
    numbered = orders.select(F.col("k").cast("long").alias("hash"), number.alias("number")).filter("number is not null")
    return hashed(commit_graph.pull_request_commits(parents(t), numbered, head(t)))
