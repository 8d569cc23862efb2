"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Sources share a budget of words by weight; a target stops at twice its source's size and the excess is shared again by
weight among the rest. Inside a source every document expects ``target / source_size`` copies. Documents stand in order
of size and id, their expected copies are prefix-summed, one offset per source is added, and a document is emitted once
for each whole number its interval crosses. Sorting by size spreads the draw over all sizes, so the words taken follow
the target closely; the offset comes from a hash of seed and source, so a rerun takes the same copies.

Nulls and edge cases: a null source is a source of its own, ordered last; a null or blank text has size 0 and, like
every document of a source without words, is taken only as its source's copies say (0 words either way). Repeated rows
are documents of their own. Extra columns are kept unless an output column has their name, compared without case. An
empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.llm.common import cut, free, n_words, numbered, others, table, with_slots

WEIGHTS = (3, 1, 2)      # by rank of the source's name, repeating
SHARE_PERCENT = 150      # of all words
MOST = 2                 # times its source's size, for a target
SEED = "mix-1"


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size).

    Sharing the excess again and again ends where every source has ``weight * level`` or its limit, whichever is less.
    In order of limit / weight the limited sources come first, so the level is the one for which the next source stays
    within its limit: running sums over the source table (one row per source) find it."""
    cycle = F.array(*[F.lit(w).cast("long") for w in WEIGHTS])
    ranked = sizes.withColumn("_rank", F.expr("row_number() over (order by source asc nulls last) - 1"))
    weighed = ranked.withColumn("weight", F.get(cycle, (F.col("_rank") % len(WEIGHTS)).cast("int"))).withColumn(
        "_limit", F.col("source_size") * MOST)
    # cross products of exact longs order limit / weight without rounding ties apart
    order = "order by cast(_limit as double) / weight, _rank"
    level = weighed.selectExpr(
        "*", "sum(source_size) over () as _all",
        f"coalesce(sum(_limit) over ({order} rows between unbounded preceding and 1 preceding), 0) as _limited",
        f"sum(weight) over ({order} rows between current row and unbounded following) as _open")
    level = level.withColumn("_level", (F.col("_all") * SHARE_PERCENT - F.col("_limited") * 100).cast("double")
                             / (F.col("_open") * 100).cast("double"))
    # the first source (in that order) that the level leaves within its limit fixes the level for all after it
    first = F.min(F.when(F.col("_level") * F.col("weight") <= F.col("_limit"), F.struct(
        (F.col("_limit").cast("double") / F.col("weight")).alias("o"), F.col("_rank").alias("r"), F.col("_level").alias("level"))))
    least = level.withColumn("_first", first.over(Window.partitionBy()))
    return least.select("source", "source_size", "weight", F.least(
        F.col("_limit").cast("double"), F.coalesce(F.col("_first.level") * F.col("weight"), F.col("_limit").cast("double"))).alias("target"))


def _offset(source: Column, seed: str) -> Column:
    """One number in [0, 1) per source; a null source hashes as an empty name with a mark."""
    name = F.concat(F.lit(seed + "/"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")))
    return F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("double") / F.lit(float(16 ** 12))


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (= copies * size)."""
    kept = others(docs, "size", "source_size", "target", "copies", "taken", "text")
    slot, name, each, start = free(docs, "_slot", "_source", "_e", "_u")
    # sizes are counted once: source totals and positions read them, not the texts
    sized = cut(docs.select(*kept, n_words(F.col("text")).alias("size")))
    shares = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    slotted = with_slots(sized, ["source"], ["size", "doc_id"], slot)
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    shares = shares.select(F.col("source").alias(name), "source_size", "target", expected.alias(each), _offset(F.col("source"), seed).alias(start))
    # one row per source against all rows: joined on the name, null equal to null
    joined = slotted.join(shares, F.col("source").eqNullSafe(F.col(name)))

    def crossed(n: Column) -> Column:
        return F.floor(n.cast("double") * F.col(each) + F.col(start))

    copies = F.least(crossed(F.col(slot) + 1) - crossed(F.col(slot)), F.lit(MOST)).cast("long")
    return joined.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).drop(slot, name, each, start)


def emit(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself: each document once per copy, with the columns of ``docs``. Copies are joined back by a
    number of each row, which keeps texts out of the sort; rows that share an id, a null one too, each take their own."""
    row, copies, copy = free(docs, "_row", "_copies", "_copy")
    rows, _ = numbered(docs, row)
    picked = mix(rows.select("doc_id", "source", "text", row), seed).where("copies > 0").select(row, F.col("copies").alias(copies))
    return rows.join(picked, row).withColumn(
        copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Copies of every document in the 150 % mix of all sources."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS k FROM d GROUP BY source),
 w AS (SELECT source, source_size, k, CASE k % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS most FROM s),
 fill(step, capped, level) AS (
  SELECT 0, CAST([] AS BIGINT[]), (SELECT CAST(sum(source_size) * 150 AS DOUBLE) / CAST(sum(weight) * 100 AS DOUBLE) FROM w)
  UNION ALL
  SELECT step + 1, now, (SELECT CAST((SELECT sum(source_size) FROM w) * 150 - coalesce(sum(CASE WHEN list_contains(now, k) THEN most END), 0) * 100 AS DOUBLE)
    / CAST(sum(CASE WHEN list_contains(now, k) THEN 0 ELSE weight END) * 100 AS DOUBLE) FROM w)
  FROM (SELECT step, capped, (SELECT list(CAST(k AS BIGINT) ORDER BY k) FROM w WHERE weight * level > most) AS now FROM fill) WHERE len(coalesce(now, [])) > len(capped)),
 last AS (SELECT level FROM fill ORDER BY step DESC LIMIT 1),
 t AS (SELECT source, source_size, least(CAST(most AS DOUBLE), weight * level) AS target,
  CAST(('0x' || substr(md5('mix-1/' || coalesce('s' || source, 'n')), 1, 12)) AS BIGINT) / 281474976710656.0 AS u FROM w, last),
 n AS (SELECT d.doc_id, size, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS e,
  row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id) - 1 AS slot FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target,
 CAST(least(floor(CAST(slot + 1 AS DOUBLE) * e + u) - floor(CAST(slot AS DOUBLE) * e + u), 2) AS BIGINT) * size AS taken FROM n
"""
