"""Sharding by a hierarchical weighted hash tree (region, rack, shard).

A document descends level by level: every child of the node it stands at draws ``-ln(u) / weight``, u hashed from the
document, the level and the child's number, and the least draw wins; a region's or rack's weight is the sum of those
below. So it draws for 4 regions, 2 racks and 5 shards of the default table, not for 40 shards. If a weight changes, only
the draws of the nodes above that shard change: a document moves into or out of these nodes, and nothing moves between
subtrees whose weights stayed. A weight of 0 drains a shard.

Law ``key``: document id and shard table decide, and one more shard takes rows only into itself. The first ``base``
shards are the tree (5 shards a rack, 2 racks a region); every later shard is an increment with a draw of its own
against the draw of the winning region, which is an exponential draw with the whole tree's weight as its rate. So an
increment takes its share from all shards and moves nothing else. A table keeps the base it began with.

Nulls and edge cases: a null id is hashed like any value (all null ids meet in one shard); a null text has size 16 and
the checksum of no bytes. Repeated rows go to the same shard and take their slots in any order. Extra columns are kept
unless an output column has their name, compared without case. An empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm.common import free, others, table, with_slots

SHARDS = 40
SHARDS_PER_RACK, RACKS_PER_REGION = 5, 2
OVERHEAD = 16


def tree_weights(base: int, weights: dict[int, float] | None = None) -> list[list[float]]:
    """The weights of all regions, racks and shards of the tree; node n's children are the consecutive numbers from n times
    the fan-out. Bounded by the shard table."""
    levels = [[float((weights or {}).get(s, 1.0)) for s in range(base)]]
    for fan in (SHARDS_PER_RACK, RACKS_PER_REGION):
        levels.insert(0, [sum(levels[0][i:i + fan]) for i in range(0, len(levels[0]), fan)])
    if min(levels[2]) < 0 or sum(levels[2]) <= 0:
        raise ValueError("shard weights may not be negative or all zero")
    return levels


def _draw(key: Column, level: str, node: Column, weight: Column) -> Column:
    """(d, n): an exponential draw with the node's weight as its rate, null for a weight of 0 or none; u has 52 bits and is
    never 0. Draws tie only if two 52-bit hashes agree; then the smaller number wins."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(level), node), 12).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return F.when(weight > 0, F.struct((-F.log(u) / weight).alias("d"), node.alias("n")))


def _least(draws: list[Column]) -> Column:
    return F.least(*draws) if len(draws) > 1 else draws[0]


def _child(key: Column, level: str, parent: Column, fan: int, weights: list[float]) -> Column:
    """The winning child of a node: its fan-out's draws, children beyond the table's end drawing nothing."""
    table_ = F.array(*[F.lit(w) for w in weights])
    nodes = [parent * F.lit(fan) + F.lit(i) for i in range(fan)]
    return _least([_draw(key, level, n, F.get(table_, n)) for n in nodes])["n"]


def descend(df: DataFrame, key: Column, base: int, weights: dict[int, float] | None, name: str) -> DataFrame:
    """``df`` with the struct ``name`` of (d, n): the winning region's draw and the shard the key descends to in the tree."""
    regions, racks, shards = tree_weights(base, weights)
    top, rack = free(df, "_top", "_rack")
    placed = df.withColumn(top, _least([_draw(key, "region", F.lit(r), F.lit(w)) for r, w in enumerate(regions)]))
    placed = placed.withColumn(rack, _child(key, "rack", F.col(top)["n"], RACKS_PER_REGION, racks))
    shard_ = _child(key, "shard", F.col(rack), SHARDS_PER_RACK, shards)
    return placed.withColumn(name, F.struct(F.col(top)["d"].alias("d"), shard_.alias("n"))).drop(top, rack)


def assign(docs: DataFrame, shards: int = SHARDS, weights: dict[int, float] | None = None, base: int | None = None) -> DataFrame:
    """``docs`` without the text, with size, text_crc32, law, shard and grown_shard. ``base`` is how many shards the table
    began with (all of up to 40, if it is not given)."""
    base = min(shards, SHARDS) if base is None else base
    if not 1 <= base <= shards:
        raise ValueError("a table has at least the shards it began with")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rest = others(docs, "size", "text_crc32", "law", "shard", "slot", "grown_shard", "text")
    best, now = free(docs, "_best", "_now")
    key = F.col("doc_id")

    def increment(s: int) -> Column:
        return _draw(key, "increment", F.lit(s), F.lit(float((weights or {}).get(s, 1.0))))

    sized = docs.select(*rest, (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"))
    picked = descend(sized, key, base, weights, best).withColumn(now, _least([F.col(best), *[increment(s) for s in range(base, shards)]]))
    return picked.select(*rest, "size", "text_crc32", F.lit("key").alias("law"), F.col(now)["n"].alias("shard"),
                         F.least(F.col(now), increment(shards))["n"].alias("grown_shard"))


def shard(docs: DataFrame, shards: int = SHARDS, weights: dict[int, float] | None = None, base: int | None = None) -> DataFrame:
    """``assign`` and a gapless ``slot`` inside each shard, by id."""
    return with_slots(assign(docs, shards, weights, base), ["shard"], ["doc_id"], "slot")


def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in shards 0 to 39 under law ``key``."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return shard(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
