"""Four views of the graph the tables hold. A month is a snapshot, at the newest order with a line shipped in it; an order of four
or more moved lines is a restructuring decision, evidenced by itself and affecting the modules of its lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.operators import graph, temporal, views
from codestrata.plans.registry import query
from codestrata.plans.tables import COMMITS_SQL, FILES_SQL, IMPORTS_SQL, MODULES_SQL, MONTHS_SQL, SNAP_IMPORTS_SQL, author_of, hash_of, month_of, path_of, with_

SHOWN = ("dependencies", "history", "temporal", "decisions")
AUTHOR_ID = "substr(sha1(lower(CONCAT('c', CAST(o_custkey AS STRING)))), 1, 12)"

SQL = with_(
    months=MONTHS_SQL, snap=SNAP_IMPORTS_SQL, modules=MODULES_SQL, imports=IMPORTS_SQL, commits=COMMITS_SQL, files=FILES_SQL,
    decided="SELECT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 HAVING COUNT(*) >= 4",
    runs="SELECT src, dst, MIN(idx) AS a, MAX(idx) AS b FROM (SELECT src, dst, idx, idx - ROW_NUMBER() OVER (PARTITION BY src, dst ORDER BY idx) AS g FROM snap) GROUP BY src, dst, g",
    edges=f"""SELECT 'IMPORTS' AS type, src, dst, CAST(NULL AS BIGINT) AS valid_from_idx, CAST(NULL AS BIGINT) AS valid_to_idx FROM imports
 UNION ALL SELECT 'AUTHORED', author_id, hash, NULL, NULL FROM commits UNION ALL SELECT DISTINCT 'MODIFIED', hash, path, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM files
 UNION ALL SELECT 'NEXT', CAST(idx AS VARCHAR), CAST(idx + 1 AS VARCHAR), NULL, NULL FROM months WHERE idx < (SELECT MAX(idx) FROM months)
 UNION ALL SELECT 'AT', CAST(idx AS VARCHAR), {hash_of('MAX(l_orderkey)')}, NULL, NULL FROM lineitem JOIN months ON m = {month_of('l_shipdate')} GROUP BY idx
 UNION ALL SELECT 'H_IMPORTS', src, dst, a, CASE WHEN b < (SELECT MAX(idx) FROM months) THEN b + 1 END FROM runs
 UNION ALL SELECT 'EVIDENCED_BY', 'd' || k, {hash_of('k')}, NULL, NULL FROM decided
 UNION ALL SELECT DISTINCT 'AFFECTS', 'd' || k, path, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM files JOIN decided USING (k)""",
    nodes="""SELECT 'dependencies' AS view, 'Module' AS label, path AS id, ROW_NUMBER() OVER (ORDER BY path) AS r, 800 AS cap FROM modules
 UNION ALL SELECT 'history', 'Developer', author_id, ROW_NUMBER() OVER (ORDER BY author, author_id), 100 FROM (SELECT DISTINCT author, author_id FROM commits)
 UNION ALL SELECT 'history', 'Commit', hash, ROW_NUMBER() OVER (ORDER BY date DESC, hash), 250 FROM commits
 UNION ALL SELECT 'history', 'Module', path, ROW_NUMBER() OVER (ORDER BY path), 400 FROM modules
 UNION ALL SELECT 'temporal', 'Snapshot', CAST(idx AS VARCHAR), ROW_NUMBER() OVER (ORDER BY idx), 100 FROM months
 UNION ALL SELECT 'temporal', 'Commit', hash, ROW_NUMBER() OVER (ORDER BY date, hash), 100 FROM commits WHERE hash IN (SELECT dst FROM edges WHERE type = 'AT')
 UNION ALL SELECT 'temporal', 'HModule', path, ROW_NUMBER() OVER (ORDER BY path), 400 FROM (SELECT src AS path FROM snap UNION SELECT dst FROM snap)
 UNION ALL SELECT 'decisions', 'Decision', 'd' || k, ROW_NUMBER() OVER (ORDER BY date, 'd' || k), 50 FROM commits JOIN decided USING (k)
 UNION ALL SELECT 'decisions', 'Commit', hash, ROW_NUMBER() OVER (ORDER BY date, hash), 200 FROM commits WHERE hash IN (SELECT dst FROM edges WHERE type = 'EVIDENCED_BY')
 UNION ALL SELECT 'decisions', 'Module', path, ROW_NUMBER() OVER (ORDER BY path), 300 FROM modules WHERE path IN (SELECT dst FROM edges WHERE type = 'AFFECTS')""",
    kinds="""SELECT * FROM (VALUES ('dependencies', 'IMPORTS', 'Module', 'Module'), ('history', 'AUTHORED', 'Developer', 'Commit'), ('history', 'MODIFIED', 'Commit', 'Module'),
 ('temporal', 'NEXT', 'Snapshot', 'Snapshot'), ('temporal', 'AT', 'Snapshot', 'Commit'), ('temporal', 'H_IMPORTS', 'HModule', 'HModule'),
 ('decisions', 'EVIDENCED_BY', 'Decision', 'Commit'), ('decisions', 'AFFECTS', 'Decision', 'Module')) k(view, type, source, target)""",
    shown="SELECT view, label, id FROM nodes WHERE r <= cap")


def graph_of(t) -> tuple[dict[str, DataFrame], list[views.Kind]]:
    """Labels keyed by integers where the tables have them, and relationships between those keys."""
    orders, lines = t.table("orders"), t.table("lineitem")
    dated = orders.select(F.col("o_orderkey").alias("key"), F.expr(hash_of("o_orderkey")).alias("id"), F.col("o_orderdate").cast("date").alias("timestamp"))
    decided = lines.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n >= 4").select("key")
    labels = {
        "Module": t.modules.select(F.col("p_partkey").alias("key"), F.col("path").alias("id"), "path"),
        "Developer": orders.select("o_custkey").distinct().select(F.col("o_custkey").alias("key"), F.expr(AUTHOR_ID).alias("id"), F.expr(author_of("o_custkey")).alias("name")),
        "Commit": dated,
        "Snapshot": t.months.select(F.col("idx").alias("key"), F.col("idx").cast("string").alias("id"), "idx"),
        "HModule": t.snap_imports.select(F.explode(F.array("from", "to")).alias("key")).distinct().select("key", F.col("key").alias("id"), F.col("key").alias("path")),
        "Decision": dated.join(decided, "key").select("key", F.concat(F.lit("d"), F.col("key").cast("string")).alias("id"), F.col("timestamp").alias("date")),
    }
    key, module = (lambda label: (label, "key")), ("Module", "key")
    in_month = lines.select("l_orderkey", F.expr(month_of("l_shipdate")).cast("bigint").alias("m")).groupBy("m").agg(F.max("l_orderkey").alias("dst"))
    touched = lines.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    held = temporal.intervals(t.snap_imports, ["from", "to"], t.last_idx)
    return labels, [
        views.Kind("IMPORTS", module, module, lines.where("l_partkey <> l_suppkey").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()),
        views.Kind("AUTHORED", key("Developer"), key("Commit"), orders.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))),
        views.Kind("MODIFIED", key("Commit"), module, touched),
        views.Kind("NEXT", key("Snapshot"), key("Snapshot"), graph.chain_edges(t.months).select(F.col("idx").alias("src"), F.col("next_idx").alias("dst"))),
        views.Kind("AT", key("Snapshot"), key("Commit"), in_month.join(F.broadcast(t.months), "m").select(F.col("idx").alias("src"), "dst")),
        views.Kind("H_IMPORTS", key("HModule"), key("HModule"), views.spans(held, F.col("from"), F.col("to"))),
        views.Kind("EVIDENCED_BY", key("Decision"), key("Commit"), decided.select(F.col("key").alias("src"), F.col("key").alias("dst"))),
        views.Kind("AFFECTS", key("Decision"), module, touched.join(decided.withColumnRenamed("key", "src"), "src")),
    ]


def _each(t, one) -> DataFrame:
    labels, kinds = graph_of(t)
    return reduce(DataFrame.unionByName, [one(view, labels, kinds).select(F.lit(view).alias("view"), "*") for view in SHOWN])


@query("graph_view_nodes", SQL + " SELECT view, label, id FROM shown")
def graph_view_nodes(t):
    """Nodes of the dependency, history, time-travel and decision views under their caps."""
    return _each(t, views.nodes)


@query("graph_view_relationships", SQL + """ SELECT view, type, src, dst, valid_from_idx, valid_to_idx FROM (SELECT view, e.*, ROW_NUMBER() OVER (PARTITION BY view ORDER BY type, src, dst, valid_from_idx NULLS FIRST, valid_to_idx NULLS FIRST) AS r
  FROM kinds k JOIN edges e USING (type) WHERE EXISTS (SELECT 1 FROM shown s WHERE s.view = k.view AND label = source AND id = src) AND EXISTS (SELECT 1 FROM shown s WHERE s.view = k.view AND label = target AND id = dst)) WHERE r <= 4000""")
def graph_view_relationships(t):
    """Relationships between the nodes of those views, past ones with the snapshots they hold in."""
    return _each(t, views.relationships)
