"""Revision-keyed facts and snapshot build, over the months of the line items.

A supplier is a source file and a month a revision; the file's version is its least line number of the month. A version's facts
are rows derived from those keys: three imports (by full name, by a unique suffix, and a module out of a package) for Python
files, a relative specifier for script files."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.operators import layers, revisions
from codestrata.plans.registry import query
from codestrata.plans.tables import MONTHS_SQL, RULES_SQL, layer_sql, month_of, with_
from codestrata.session import stored


def folder_of(key: str) -> str:
    return f"CONCAT('pkg_', CAST({key} % 25 AS STRING))"


def file_of(key: str) -> str:
    """Path of a source file; every fourth is a script."""
    return f"""CONCAT(CASE WHEN {key} % 4 = 0 THEN 'web/' WHEN {key} % 4 = 1 THEN 'src/controllers/' WHEN {key} % 4 = 2 THEN 'src/services/' ELSE 'src/db/' END,
 {folder_of(key)}, '/mod_', CAST({key} AS STRING), CASE WHEN {key} % 4 = 0 THEN '.ts' ELSE '.py' END)"""


def dotted_of(key: str) -> str:
    return f"""CONCAT(CASE WHEN {key} % 4 = 1 THEN 'src.controllers.' WHEN {key} % 4 = 2 THEN 'src.services.' ELSE 'src.db.' END, {folder_of(key)})"""


# The files a version (s, v) names; n is the number of suppliers.
TARGETS = {"t": "s * (v + 1) % n + 1", "u": "(s + v) % n + 1", "w": "(s * 7 + v) % n + 1"}

TREE_SQL = f"""SELECT m AS revision, idx, s, v, {file_of('s')} AS path FROM
 (SELECT {month_of('l_shipdate')} AS m, l_suppkey AS s, MIN(l_linenumber) AS v FROM lineitem GROUP BY 1, 2) JOIN months USING (m)"""
EDGES_SQL = f"""SELECT DISTINCT a.idx, a.s, b.s AS o, a.path AS src, b.path AS dst FROM
 (SELECT *, unnest(CASE WHEN s % 4 = 0 THEN [t] ELSE [t, u, w] END) AS o FROM
  (SELECT *, {', '.join(f'{e} AS {k}' for k, e in TARGETS.items())} FROM tree, (SELECT COUNT(*) AS n FROM supplier))) a
 JOIN tree b ON b.idx = a.idx AND b.s = a.o AND a.s <> b.s AND (a.s % 4 = 0) = (b.s % 4 = 0)"""
SQL = dict(months=MONTHS_SQL, tree=TREE_SQL, edges=EDGES_SQL)


def tree(t):
    """(revision, idx, path, digest, s, v) of all months."""
    keyed = t.table("lineitem").groupBy(F.expr(month_of("l_shipdate")).cast("bigint").alias("m"), F.col("l_suppkey").alias("s")).agg(
        F.min("l_linenumber").cast("bigint").alias("v"))
    return keyed.join(F.broadcast(t.months), "m").select(
        F.col("m").alias("revision"), "idx", "s", "v", F.expr(file_of("s")).alias("path"), F.sha1(F.concat_ws("|", "s", "v")).alias("digest"))


def version_facts(t, files):
    """Facts of every different version in ``files``."""
    n = t.table("supplier").agg(F.count(F.lit(1)).alias("n"))
    versions = files.select("digest", "path", "s", "v").distinct().join(F.broadcast(n))
    for name, rule in TARGETS.items():
        versions = versions.withColumn(name, F.expr(rule))

    def imported(language, place, owner, name=None, detail=None):
        text = [F.lit(None).cast("string") if e is None else F.expr(e) for e in (owner, name, detail)]
        return F.struct(F.lit(language).alias("language"), F.lit(place).alias("ord"), *[c.alias(n) for c, n in zip(text, ("owner", "name", "detail"), strict=True)])

    script = F.array(imported("script", 0, f"concat('../', {folder_of('t')}, '/mod_', t)"))
    python = F.array(imported("python", 0, f"concat({dotted_of('t')}, '.mod_', t)"), imported("python", 1, "concat('mod_', u)", None, "'alias'"),
                     imported("python", 2, dotted_of("w"), "concat('mod_', w)", "concat('mod_', w)"))
    imports = F.when(F.col("s") % 4 == 0, script).otherwise(python)
    rows = versions.select("digest", "path", F.explode(imports).alias("f")).select("digest", "path", "f.*").withColumn("fact", F.lit("import"))
    own = versions.select("digest", "path", F.when(F.col("s") % 4 == 0, "script").otherwise("python").alias("language"), F.lit(9).alias("ord"),
                          F.lit(None).cast("string").alias("owner"), F.concat(F.lit("run_"), "v").alias("name"), F.lit(None).cast("string").alias("detail"), F.lit("function").alias("fact"))
    return rows.unionByName(own)


@query("snapshot_facts", with_(**SQL) + """ SELECT revision, CASE WHEN s % 4 = 0 THEN 'script' ELSE 'python' END AS language, COUNT(*) AS n_files,
 CAST(SUM(CASE WHEN s % 4 = 0 THEN 1 ELSE 3 END) AS BIGINT) AS imports, COUNT(*) AS functions, COUNT(DISTINCT v) AS names FROM tree GROUP BY 1, 2""")
def snapshot_facts(t):
    """What each revision holds, by language, from facts of versions parsed once."""
    files = tree(t)
    facts = revisions.snapshot_facts(files, version_facts(t, files))
    function = F.col("fact") == "function"
    return facts.groupBy("revision", "language").agg(
        F.count_distinct("path").alias("n_files"), F.count_if(F.col("fact") == "import").alias("imports"), F.count_if(function).alias("functions"),
        F.count_distinct(F.when(function, F.col("name"))).alias("names"))


@query("snapshot_edges", with_(**SQL) + ' SELECT idx, src AS "from", dst AS "to" FROM edges')
def snapshot_edges(t):
    """Import edges of every revision, resolved against the files of that revision."""
    files = stored(tree(t))
    found = revisions.snapshot_edges(files, version_facts(t, files))
    return found.join(F.broadcast(t.months.select(F.col("m").alias("revision"), "idx")), "revision").select("idx", "from", "to")


@query("snapshot_build", with_(**SQL, layers=f"SELECT path, {layer_sql('path')} AS layer_type FROM (SELECT DISTINCT path FROM tree)", rules=RULES_SQL) + """,
 bad AS (SELECT DISTINCT e.idx, r.rule_name, r.severity, e.src, e.dst FROM edges e JOIN layers a ON a.path = e.src JOIN layers b ON b.path = e.dst
  JOIN rules r ON r.edge = 'imports' AND NOT r.allowed AND r.rule_from = a.layer_type AND r.rule_to = b.layer_type),
 fresh AS (SELECT idx, COUNT(*) AS n FROM (SELECT s, v, MIN(idx) AS idx FROM tree GROUP BY 1, 2) GROUP BY 1)
 SELECT m AS revision, idx, (SELECT COUNT(*) FROM tree t WHERE t.idx = x.idx) AS n_modules, COALESCE((SELECT n FROM fresh f WHERE f.idx = x.idx), 0) AS n_parsed,
  (SELECT COUNT(*) FROM edges e WHERE e.idx = x.idx) AS n_imports, (SELECT COUNT(*) FROM bad WHERE bad.idx = x.idx) AS n_violations,
  COALESCE((SELECT CAST(SUM(severity) AS BIGINT) FROM bad WHERE bad.idx = x.idx), 0) AS weighted_violations,
  CASE WHEN idx = 0 THEN 0 ELSE (SELECT COUNT(*) FROM edges e WHERE e.idx = x.idx AND NOT EXISTS (SELECT 1 FROM edges p WHERE p.idx = x.idx - 1 AND p.src = e.src AND p.dst = e.dst)) END AS new_imports,
  (SELECT COUNT(*) FROM edges p WHERE p.idx = x.idx - 1 AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.idx = x.idx AND p.src = e.src AND p.dst = e.dst)) AS gone_imports,
  CASE WHEN idx = 0 THEN 0 ELSE (SELECT COUNT(*) FROM bad e WHERE e.idx = x.idx AND NOT EXISTS (SELECT 1 FROM bad p WHERE p.idx = x.idx - 1 AND p.rule_name = e.rule_name AND p.src = e.src AND p.dst = e.dst)) END AS new_violations,
  (SELECT COUNT(*) FROM bad p WHERE p.idx = x.idx - 1 AND NOT EXISTS (SELECT 1 FROM bad e WHERE e.idx = x.idx AND p.rule_name = e.rule_name AND p.src = e.src AND p.dst = e.dst)) AS gone_violations
 FROM months x""")
def snapshot_build(t):
    """One row per revision: sizes, versions parsed for it, edges, violations and their changes."""
    files = stored(tree(t))
    order = t.months.select(F.col("m").alias("revision"), "idx")
    tagged = files.select("path").distinct().withColumn("layer_type", layers.classify(F.col("path"), t.rules_document))
    return revisions.build(files.drop("idx"), version_facts(t, files), tagged, t.rules, order)
