"""Records held against their evidence: an order is a record, its lines are what it cites and (some of them) its evidence."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from codestrata.operators import record_check
from codestrata.plans.registry import query
from codestrata.plans.tables import hash_of

POSITION = "CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey"
SHORT = f"substr({hash_of('l_partkey')}, 1, 7 + 2 * CAST(l_partkey % 3 AS INT))"
IN_TEXT = f"substr({hash_of('l_partkey')}, 1, 7 + CAST(l_suppkey % 34 AS INT))"
ITEM = f"CONCAT(' [', upper(substr({hash_of('l_partkey')}, 1, 5 + CAST(l_partkey % 20 AS INT))), ']')"
PATH = "CONCAT('src/m', CAST(l_suppkey % 50 AS STRING), '.py')"
NUMBER = "CAST(l_linenumber * 10 + l_suppkey % 3 AS BIGINT)"

SQL = f"""WITH l AS (SELECT l_orderkey AS record_id, l_linenumber AS ln, {POSITION} AS pos, {hash_of('l_partkey')} AS hash, {SHORT} AS short, {IN_TEXT} AS in_text,
  {ITEM} AS item, {PATH} AS path, {NUMBER} AS number, l_returnflag <> 'R' AS evident, l_linestatus = 'O' AS shown FROM lineitem),
 drafts AS (SELECT o_orderkey AS record_id, o_custkey FROM orders),
 said AS (SELECT record_id, item AS cited, lower(item[3:-2]) AS normal, ln <= 3 AS in_items, false AS in_text, pos FROM l WHERE ln <= 3
  UNION ALL SELECT record_id, in_text, in_text, false, true, NULL FROM l JOIN drafts USING (record_id)),
 one AS (SELECT record_id, cited, normal, bool_or(in_items) AS in_items, bool_or(in_text) AS in_text, MIN(pos) AS place FROM said GROUP BY 1, 2, 3),
 held AS (SELECT o.record_id, o.cited, o.in_items, o.in_text, o.place, arg_min(e.short, e.pos) AS match FROM one o LEFT JOIN l e ON e.evident AND e.record_id = o.record_id
  AND length(normal) >= 7 AND (starts_with(e.hash, normal) OR starts_with(normal, e.short)) GROUP BY ALL),
 v AS (SELECT record_id, 'commit' AS kind, cited, in_items, in_text, place, match, match IS NOT NULL AS supported FROM held
  UNION ALL SELECT record_id, 'path', path, false, true, NULL, NULL, bool_or(shown) FROM l JOIN drafts USING (record_id) GROUP BY record_id, path
  UNION ALL SELECT DISTINCT record_id, 'path', 'Node.js', false, true, CAST(NULL AS BIGINT), NULL, true FROM l JOIN drafts USING (record_id)
  UNION ALL SELECT DISTINCT record_id, 'number', '#' || number, false, true, CAST(NULL AS BIGINT), NULL, number % 10 = 0 FROM l JOIN drafts USING (record_id))"""


def of_each(text: str) -> Column:
    """``text``, an expression on a line, of every line of the array ``_lines``: lines are gathered as keys."""
    return F.expr(f"sort_array(transform(_lines, x -> {re.sub(r'\bl_', 'x.l_', text)}))")


def drafts(t):
    """One draft for each order; its context names what its lines cite, some lack a decision or an inference."""
    sentence = f"concat('Since [', {IN_TEXT}, '] ', {PATH}, ' runs on Node.js, see #', cast({NUMBER} AS STRING), '.')"
    lines = t.table("lineitem").groupBy(F.col("l_orderkey").alias("record_id")).agg(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_linenumber")).alias("_lines"))
    said = lines.select("record_id", F.array_join(of_each(sentence), " ").alias("context"))
    key = F.col("o_orderkey")
    return t.table("orders").join(said, key == F.col("record_id"), "left").select(
        key.alias("record_id"), F.concat(F.lit("Record "), key.cast("string")).alias("title"), "context", F.when(key % 11 != 0, F.lit("Split it")).alias("decision"),
        F.lit(None).cast("string").alias("consequences"), F.lit("").alias("alternatives"), F.when(key % 13 == 0, F.lit(" \n")).otherwise(F.lit("It follows")).alias("inference"),
        ((F.col("o_custkey") % 12) / 10.0).alias("confidence"))


def cited(t, records):
    lines = t.table("lineitem")
    record = F.col("l_orderkey").alias("record_id")
    items = lines.where("l_linenumber <= 3").select(record, F.expr(POSITION).alias("ord"), F.expr(ITEM).alias("commit"))
    evidence = lines.where("l_returnflag <> 'R'").select(record, F.expr(POSITION).alias("pos"), F.expr(hash_of("l_partkey")).alias("hash"), F.expr(SHORT).alias("short"))
    shown = lines.where("l_linestatus = 'O'").groupBy(record).agg(F.collect_list(F.struct("l_suppkey")).alias("_lines"))
    payloads = shown.select("record_id", F.array_join(of_each(f"concat('Files: ', upper({PATH}))"), "\n").alias("payload"))
    attached = lines.select(record, (F.col("l_linenumber") * 10).alias("number"))
    return record_check.citations(records, items, evidence, payloads, attached)


@query("record_citations", SQL + " SELECT record_id, kind, cited, in_items, in_text, match, supported FROM v")
def record_citations(t):
    """Every commit, file and number a drafted record cites, and whether its evidence holds it."""
    return cited(t, drafts(t)).drop("place")


@query("record_verdicts", SQL + """,
 lists AS (SELECT record_id, string_agg(DISTINCT cited, ',' ORDER BY cited) FILTER (kind = 'commit' AND NOT supported) AS invalid,
  string_agg(cited, ',' ORDER BY cited) FILTER (kind <> 'commit' AND NOT supported) AS unsupported, string_agg(cited, ',' ORDER BY cited) FILTER (kind = 'number' AND supported) AS numbers FROM v GROUP BY 1),
 named AS (SELECT record_id, string_agg(match, ',' ORDER BY place) AS cited_commits FROM (SELECT record_id, match, MIN(place) AS place FROM v WHERE kind = 'commit' AND in_items AND supported GROUP BY 1, 2) GROUP BY 1),
 s AS (SELECT record_id, concat_ws(',', CASE WHEN c.record_id IS NULL THEN 'context' END, CASE WHEN record_id % 11 = 0 THEN 'decision' END, CASE WHEN record_id % 13 = 0 THEN 'inference' END) AS missing,
  COALESCE(cited_commits, '') AS cited_commits, COALESCE(invalid, '') AS invalid, COALESCE(unsupported, '') AS unsupported, COALESCE(numbers, '') AS numbers,
  LEAST(1.0, (o_custkey % 12) / 10.0) AS claimed,
  ROUND(GREATEST(0.1, LEAST(0.95, 0.3 + 0.35 * COALESCE((record_id % 6) / 5.0, 0) + 0.05 * LEAST(COALESCE(n, 0), 6) + CASE WHEN record_id % 4 = 0 AND n IS NOT NULL THEN 0.15 ELSE 0 END - CASE WHEN unsupported IS NULL THEN 0 ELSE 0.1 END)), 2) AS cap
  FROM drafts LEFT JOIN (SELECT DISTINCT record_id FROM l) c USING (record_id) LEFT JOIN lists USING (record_id) LEFT JOIN named USING (record_id)
  LEFT JOIN (SELECT record_id, COUNT(*) AS n FROM l WHERE evident GROUP BY 1) USING (record_id)),
 f AS (SELECT *, missing = '' AND cited_commits <> '' AS usable, CASE WHEN missing = '' AND cited_commits <> '' THEN ROUND(LEAST(claimed, cap), 2) ELSE 0.1 END AS confidence FROM s)
 SELECT record_id, missing, cited_commits, invalid, unsupported, numbers, usable, CAST(cap AS DOUBLE) AS cap, CAST(confidence AS DOUBLE) AS confidence,
  CASE WHEN confidence >= 0.7 THEN 'High' WHEN confidence >= 0.45 THEN 'Medium' ELSE 'Low' END AS label FROM f""")
def record_verdicts(t):
    """Every drafted record: what it lacks, which of its citations hold, and the confidence its evidence allows."""
    records = drafts(t)
    counted = t.table("lineitem").where("l_returnflag <> 'R'").groupBy(F.col("l_orderkey").alias("record_id")).agg(F.count(F.lit(1)).alias("others"))
    scores = records.select("record_id").join(counted, "record_id", "left").select(
        "record_id", ((F.col("record_id") % 6) / 5.0).alias("relevance"), "others", ((F.col("record_id") % 4 == 0) & F.col("others").isNotNull()).alias("rationale"))
    got = record_check.verdicts(records, cited(t, records), scores)
    return got.select("record_id", *[F.array_join(c, ",").alias(c) for c in ("missing", "cited_commits", "invalid", "unsupported", "numbers")], "usable", "cap", "confidence", "label")
