"""Layers, rules, health, priority."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.operators import rules
from codestrata.plans.registry import query
from codestrata.plans.tables import CALLS_SQL, IMPORTS_SQL, MODULES_SQL, MONTHS_SQL, RULES_SQL, SNAP_IMPORTS_SQL, layer_sql, with_

LAYERS = f"SELECT path, {layer_sql('path')} AS layer_type FROM modules"
EDGES = """SELECT 'imports' AS edge, src AS caller_module, NULL AS caller_class, NULL AS caller_name,
 dst AS callee_module, NULL AS callee_class, NULL AS callee_name FROM imports
 UNION ALL SELECT 'calls', caller_module, caller_class, caller_name, callee_module, callee_class, callee_name FROM calls"""
JUDGED = """SELECT r.rule_name, r.severity, e.*, b.layer_type = r.rule_to AS violates FROM rules r
 JOIN edges e ON e.edge = r.edge JOIN layers a ON a.path = e.caller_module AND a.layer_type = r.rule_from
 JOIN layers b ON b.path = e.callee_module AND b.layer_type IS NOT NULL WHERE NOT r.allowed"""
BASE = dict(modules=MODULES_SQL, layers=LAYERS, imports=IMPORTS_SQL, calls=CALLS_SQL, rules=RULES_SQL, edges=EDGES)
CTE = with_(**BASE, judged=JUDGED)


def judged(t):
    edges = rules.import_edges(t.imports).unionByName(rules.call_edges(t.calls))
    return rules.judged_edges(edges, t.modules, t.rules)


@query("classify_layers", with_(modules=MODULES_SQL) + f" SELECT path, {layer_sql('path')} AS layer_type FROM modules")
def classify_layers(t):
    """Layer per module: glob > file > innermost folder, ignored modules untagged."""
    return t.modules.select("path", "layer_type")


@query("layer_counts", with_(modules=MODULES_SQL, layers=LAYERS) +
       " SELECT COALESCE(layer_type, 'untagged') AS layer, COUNT(*) AS modules FROM layers GROUP BY 1")
def layer_counts(t):
    """Modules by layer, the untagged ones named."""
    return t.modules.groupBy(F.coalesce("layer_type", F.lit("untagged")).alias("layer")).agg(
        F.count(F.lit(1)).alias("modules"))


@query("import_edges", with_(imports=IMPORTS_SQL) + ' SELECT src AS "from", dst AS "to" FROM imports')
def import_edges(t):
    """Distinct module -> module edges."""
    return t.imports


@query("rule_violations", CTE + """ SELECT rule_name, CAST(severity AS BIGINT) AS severity, edge,
 CASE WHEN edge = 'imports' THEN caller_module ELSE caller_module || '::' || COALESCE(caller_class || '.', '') || caller_name END AS caller,
 CASE WHEN edge = 'imports' THEN callee_module ELSE callee_module || '::' || COALESCE(callee_class || '.', '') || callee_name END AS callee
 FROM judged WHERE violates""")
def rule_violations(t):
    """Every violating edge of every disallowed rule, in display form."""
    found = rules.format_violations(rules.violations(judged(t)))
    return found.select("rule_name", F.col("severity").cast("bigint").alias("severity"), "edge", "caller", "callee")


@query("rule_checks", CTE + """ SELECT r.rule_name, r.edge, CAST(r.severity AS BIGINT) AS severity,
 COUNT(j.rule_name) AS checks, COUNT(CASE WHEN j.violates THEN 1 END) AS violations
 FROM rules r LEFT JOIN judged j ON j.rule_name = r.rule_name WHERE NOT r.allowed GROUP BY 1, 2, 3""")
def rule_checks(t):
    """Edges each disallowed rule judged and how many broke it; unjudged rules keep zeros."""
    return rules.rule_checks(judged(t), t.rules).withColumn("severity", F.col("severity").cast("bigint"))


HEALTH = """SELECT {by} CAST(SUM(checks) AS BIGINT) AS checks, CAST(SUM(bad) AS BIGINT) AS n_violations,
 CAST(SUM(severity * bad) AS BIGINT) AS weighted_violations,
 ROUND(100.0::DOUBLE * (1 - SUM(severity * LEAST(1.0::DOUBLE, bad::DOUBLE / checks)) / SUM(severity)), 6) AS health,
 GREATEST(0.0::DOUBLE, LEAST(100.0::DOUBLE, 100.0::DOUBLE - 100.0::DOUBLE * SUM(severity * bad) / (SELECT COUNT(*) FROM rules WHERE NOT allowed))) AS health_legacy
 FROM (SELECT {by} rule_name, severity, COUNT(*) AS checks, COUNT(CASE WHEN violates THEN 1 END) AS bad FROM judged GROUP BY ALL)"""


@query("architecture_health", CTE + HEALTH.format(by=""))
def architecture_health(t):
    """Normalised and legacy health over all rules."""
    return rules.health(judged(t), t.rules).withColumn("health", F.round("health", 6))


SNAP_JUDGED = """SELECT r.rule_name, r.severity, e.idx, e.src, e.dst, b.layer_type = r.rule_to AS violates FROM rules r
 JOIN snap e ON r.edge = 'imports' JOIN layers a ON a.path = e.src AND a.layer_type = r.rule_from
 JOIN layers b ON b.path = e.dst AND b.layer_type IS NOT NULL WHERE NOT r.allowed"""
SNAP = dict(months=MONTHS_SQL, modules=MODULES_SQL, layers=LAYERS, rules=RULES_SQL, snap=SNAP_IMPORTS_SQL, judged=SNAP_JUDGED)


def snap_judged(t):
    return rules.judged_edges(rules.import_edges(t.snap_imports, ("idx",)), t.modules, t.rules, ("idx",))


@query("priority_groups", with_(**BASE, judged=JUDGED, months=MONTHS_SQL, snap=SNAP_IMPORTS_SQL) + """,
 v AS (SELECT * FROM judged WHERE violates),
 fan AS (SELECT dst, COUNT(*) AS n FROM imports GROUP BY 1),
 seen AS (SELECT r.rule_name, s.src, s.dst, MIN(s.idx) AS first_idx FROM rules r JOIN snap s ON r.edge = 'imports'
  JOIN layers a ON a.path = s.src AND a.layer_type = r.rule_from JOIN layers b ON b.path = s.dst AND b.layer_type = r.rule_to
  WHERE NOT r.allowed GROUP BY 1, 2, 3),
 g AS (SELECT v.rule_name, v.severity, v.edge,
  SUM(v.severity * (1 + ln(1 + COALESCE(fan.n, 0)::DOUBLE)) * COALESCE(1 + 0.5::DOUBLE * s.first_idx / (SELECT MAX(idx) FROM months), 1)) AS score,
  COUNT(*) AS occurrences, MAX(COALESCE(fan.n, 0)) AS max_fan_in, MIN(s.first_idx) AS introduced_idx
  FROM v LEFT JOIN fan ON fan.dst = v.callee_module
  LEFT JOIN seen s ON v.edge = 'imports' AND s.rule_name = v.rule_name AND s.src = v.caller_module AND s.dst = v.callee_module
  GROUP BY 1, 2, 3)
 SELECT rule_name, CAST(severity AS BIGINT) AS severity, edge, ROUND(score, 2) AS score, occurrences, max_fan_in, COALESCE(introduced_idx, -1) AS introduced_idx,
  ROW_NUMBER() OVER (ORDER BY score DESC, rule_name) AS rank,
  CASE WHEN ROUND(score, 2) >= 0.66 * MAX(score) OVER () THEN 'High' WHEN ROUND(score, 2) >= 0.33 * MAX(score) OVER () THEN 'Medium' ELSE 'Low' END AS priority
 FROM g""")
def priority_groups(t):
    """Violation groups ranked by severity, target fan-in and how recently they appeared."""
    seen = rules.first_seen(rules.violations(snap_judged(t)))
    ranked = rules.prioritize(rules.violations(judged(t)), t.imports, seen, t.last_idx.first()["last"])
    return ranked.select("rule_name", F.col("severity").cast("bigint").alias("severity"), "edge",
                         F.round("score", 2).alias("score"), "occurrences", "max_fan_in",
                         F.coalesce("introduced_idx", F.lit(-1)).alias("introduced_idx"), "rank", "priority")
