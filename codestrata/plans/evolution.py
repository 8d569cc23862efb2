"""Snapshots, intervals, drift; contributors, file history, commit lookup."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.operators import history, rules, temporal
from codestrata.plans.architecture import HEALTH, LAYERS, SNAP, snap_judged
from codestrata.plans.registry import query
from codestrata.plans.tables import COMMITS_SQL, FILES_SQL, MODULES_SQL, MONTHS_SQL, SNAP_IMPORTS_SQL, hash_of, path_of, with_
from codestrata.session import global_index

SNAPS = dict(months=MONTHS_SQL, snap=SNAP_IMPORTS_SQL)


@query("validity_intervals", with_(**SNAPS) + """, g AS (SELECT src, dst, idx, idx - ROW_NUMBER() OVER (PARTITION BY src, dst ORDER BY idx) AS grp FROM snap)
 SELECT src AS "from", dst AS "to", MIN(idx) AS valid_from_idx,
  CASE WHEN MAX(idx) < (SELECT MAX(idx) FROM months) THEN MAX(idx) + 1 ELSE -1 END AS valid_to_idx FROM g GROUP BY src, dst, grp""")
def validity_intervals(t):
    """Half-open validity per import edge over the snapshot sequence; -1 stands for still live."""
    spans = temporal.intervals(t.snap_imports, ["from", "to"], t.last_idx)
    return spans.withColumn("valid_to_idx", F.coalesce("valid_to_idx", F.lit(-1)))


@query("graph_at_snapshot", with_(**SNAPS) + " SELECT src AS \"from\", dst AS \"to\" FROM snap WHERE idx = 40")
def graph_at_snapshot(t):
    """Import edges as of snapshot 40, read through the intervals."""
    spans = temporal.intervals(t.snap_imports, ["from", "to"], t.last_idx)
    return spans.filter(temporal.valid_at(F.lit(40))).select("from", "to")


@query("live_edges", with_(**SNAPS) + " SELECT m.idx, COUNT(s.src) AS live FROM months m LEFT JOIN snap s ON s.idx = m.idx GROUP BY 1")
def live_edges(t):
    """Edges valid at every snapshot, from interval ends instead of a range join."""
    spans = temporal.intervals(t.snap_imports, ["from", "to"], t.last_idx)
    return temporal.live_counts(spans, t.months)


@query("snapshot_diffs", with_(**SNAPS) + """
 SELECT b.src AS "from", b.dst AS "to", b.idx, 'added' AS change FROM snap b WHERE b.idx > 0
  AND NOT EXISTS (SELECT 1 FROM snap a WHERE a.src = b.src AND a.dst = b.dst AND a.idx = b.idx - 1)
 UNION ALL SELECT a.src, a.dst, a.idx + 1, 'removed' FROM snap a WHERE a.idx < (SELECT MAX(idx) FROM months)
  AND NOT EXISTS (SELECT 1 FROM snap b WHERE a.src = b.src AND a.dst = b.dst AND b.idx = a.idx + 1)""")
def snapshot_diffs(t):
    """Edges added and removed against the previous snapshot."""
    return temporal.diffs(t.snap_imports, ["from", "to"], t.last_idx)


@query("violation_diffs", with_(**SNAP) + """, v AS (SELECT * FROM judged WHERE violates)
 SELECT b.rule_name, b.src AS caller_module, b.dst AS callee_module, b.idx, 'added' AS change FROM v b WHERE b.idx > 0
  AND NOT EXISTS (SELECT 1 FROM v a WHERE a.rule_name = b.rule_name AND a.src = b.src AND a.dst = b.dst AND a.idx = b.idx - 1)
 UNION ALL SELECT a.rule_name, a.src, a.dst, a.idx + 1, 'removed' FROM v a WHERE a.idx < (SELECT MAX(idx) FROM months)
  AND NOT EXISTS (SELECT 1 FROM v b WHERE a.rule_name = b.rule_name AND a.src = b.src AND a.dst = b.dst AND b.idx = a.idx + 1)""")
def violation_diffs(t):
    """Violations introduced and resolved at each snapshot."""
    found = rules.violations(snap_judged(t))
    return temporal.diffs(found, ["rule_name", "caller_module", "callee_module"], t.last_idx)


def _snapshot_modules(t):
    ends = t.snap_imports.select(F.explode(F.array("from", "to")).alias("path"), "idx").distinct()
    return ends.join(t.modules.select("path", "layer_type"), "path", "left")


@query("module_presence", with_(**SNAPS, modules=MODULES_SQL, layers=LAYERS) + """,
 p AS (SELECT src AS path, idx FROM snap UNION SELECT dst, idx FROM snap)
 SELECT p.path, MAX(l.layer_type) AS layer_type, string_agg(CAST(p.idx AS VARCHAR), ',' ORDER BY p.idx) AS snapshots
 FROM p LEFT JOIN layers l ON l.path = p.path GROUP BY 1""")
def module_presence(t):
    """Snapshots each module exists in, with its latest layer."""
    seen = temporal.module_presence(_snapshot_modules(t))
    return seen.select("path", "layer_type", F.concat_ws(",", F.transform("snapshots", lambda i: i.cast("string"))).alias("snapshots"))


SNAP_HEALTH = with_(**SNAP) + ", h AS (" + HEALTH.format(by="idx,") + """ GROUP BY idx),
 trend AS (SELECT m.idx, h.health, COALESCE(h.health_legacy, 100.0) AS health_legacy, COALESCE(h.n_violations, 0) AS n_violations,
  h.health - LAG(h.health) OVER (ORDER BY m.idx) AS delta FROM months m LEFT JOIN h ON h.idx = m.idx)"""


def snapshot_health(t):
    scored = rules.health(snap_judged(t), t.rules, ("idx",))
    return t.months.select("idx").join(scored, "idx", "left").select(
        "idx", F.round("health", 6).alias("health"), F.coalesce("health_legacy", F.lit(100.0)).alias("health_legacy"),
        F.coalesce("n_violations", F.lit(0)).cast("bigint").alias("n_violations"))


@query("drift_trend", SNAP_HEALTH + " SELECT idx, health, health_legacy, n_violations, ROUND(delta, 6) AS delta FROM trend")
def drift_trend(t):
    """Health per snapshot and its change; unscored snapshots stay null."""
    return temporal.trend(snapshot_health(t)).withColumn("delta", F.round("delta", 6))


@query("largest_moves", SNAP_HEALTH + """ SELECT 'largest_drop' AS move, ROUND(delta, 6) AS delta, idx FROM
 (SELECT delta, idx FROM trend WHERE delta IS NOT NULL ORDER BY delta, idx LIMIT 1) WHERE delta < 0
 UNION ALL SELECT 'largest_gain', ROUND(delta, 6), idx FROM
 (SELECT delta, idx FROM trend WHERE delta IS NOT NULL ORDER BY delta DESC, idx DESC LIMIT 1) WHERE delta > 0""")
def largest_moves(t):
    """Largest drop (earliest tie) and gain (latest tie) in health."""
    return temporal.largest_moves(temporal.trend(snapshot_health(t))).withColumn("delta", F.round("delta", 6))


@query("compare_snapshots", with_(**SNAPS) + """, a AS (SELECT src, dst FROM snap WHERE idx = 5), b AS (SELECT src, dst FROM snap WHERE idx = 60)
 SELECT src AS "from", dst AS "to", 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
 UNION ALL SELECT src, dst, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def compare_snapshots(t):
    """Dependencies gained and lost between snapshots 5 and 60 (given in either order)."""
    return temporal.compare(t.snap_imports, ["from", "to"], F.lit(60), F.lit(5))


@query("compare_violations", with_(**SNAP) + """, v AS (SELECT rule_name || ': ' || src || ' -> ' || dst AS violation, idx FROM judged WHERE violates),
 a AS (SELECT violation FROM v WHERE idx = 5), b AS (SELECT violation FROM v WHERE idx = 60)
 SELECT violation, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
 UNION ALL SELECT violation, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def compare_violations(t):
    """Violations introduced and resolved between two snapshots, in display form."""
    shown = rules.format_violations(rules.violations(snap_judged(t))).select(
        F.concat("rule_name", F.lit(": "), "caller", F.lit(" -> "), "callee").alias("violation"), "idx")
    return temporal.compare(shown, ["violation"], F.lit(5), F.lit(60))


@query("compare_modules", with_(**SNAPS) + """, p AS (SELECT src AS path, idx FROM snap UNION SELECT dst, idx FROM snap)
 SELECT path, 'added' AS change FROM (SELECT path FROM p WHERE idx = 60 EXCEPT SELECT path FROM p WHERE idx = 5)
 UNION ALL SELECT path, 'removed' FROM (SELECT path FROM p WHERE idx = 5 EXCEPT SELECT path FROM p WHERE idx = 60)""")
def compare_modules(t):
    """Modules that appeared and disappeared between two snapshots."""
    ends = t.snap_imports.select(F.explode(F.array("from", "to")).alias("path"), "idx")
    return temporal.compare(ends, ["path"], F.lit(5), F.lit(60))


# --- commits ------------------------------------------------------------------------------------------------

HIST = dict(commits=COMMITS_SQL, files=FILES_SQL)
ORDER = ["date", "k"]


@query("contributors_by_id", with_(**HIST) + """, l AS (SELECT hash, SUM(added + deleted) AS lines FROM files GROUP BY 1)
 SELECT author_id, arg_min(author, k + date_diff('day', DATE '1970-01-01', CAST(date AS DATE)) * 1000000000000) AS name, COUNT(*) AS commits,
 CAST(SUM(COALESCE(lines, 0)) AS BIGINT) AS lines FROM commits c LEFT JOIN l ON l.hash = c.hash
 GROUP BY 1 ORDER BY commits DESC, name, author_id LIMIT 10""")
def contributors_by_id(t):
    """Top authors by id with changed lines."""
    return history.contributors_by_id(t.commits, t.commit_files, ORDER)


@query("contributors_by_name", with_(commits=COMMITS_SQL) + """ SELECT author AS name, COUNT(*) AS commits, MIN(date) AS first, MAX(date) AS last
 FROM commits GROUP BY 1 ORDER BY commits DESC, name LIMIT 15""")
def contributors_by_name(t):
    """Top display names; people sharing a name merge."""
    return history.contributors_by_name(t.commits)


@query("module_contributors", with_(**HIST) + f""" SELECT author AS name, COUNT(*) AS commits, MIN(date) AS first, MAX(date) AS last
 FROM commits WHERE hash IN (SELECT hash FROM files WHERE path = {path_of('7')}) GROUP BY 1 ORDER BY commits DESC, name LIMIT 15""")
def module_contributors(t):
    """The same, limited to one module."""
    path = _path(t, 7)
    return history.contributors_by_name(history.commits_touching(t.commits, t.commit_files, path))


def _path(t, key: int) -> str:
    return t.spark.range(1).select(F.expr(path_of(str(key)))).first()[0]


@query("first_touch", with_(**HIST) + """ SELECT path, hash AS introduced_sha, date AS introduced_at FROM
 (SELECT f.path, c.hash, c.date, ROW_NUMBER() OVER (PARTITION BY f.path ORDER BY c.date, c.k) AS n FROM files f JOIN commits c USING (hash)) WHERE n = 1""")
def first_touch(t):
    """Oldest commit touching each path."""
    return history.introduced(t.commits, t.commit_files, ORDER)


@query("file_history", with_(**HIST) + f""" SELECT c.short AS commit, c.date, c.subject AS message, c.author, CAST(SUM(f.added) AS BIGINT) AS added,
 CAST(SUM(f.deleted) AS BIGINT) AS deleted FROM commits c JOIN files f USING (hash) WHERE f.path = {path_of('7')} GROUP BY ALL""")
def file_history(t):
    """Commits that modified one module."""
    found = history.commits_touching(t.commits, t.commit_files, _path(t, 7))
    return found.select(F.col("short").alias("commit"), "date", F.col("subject").alias("message"), "author", "added", "deleted")


@query("file_history_by_suffix", with_(**HIST) + """ SELECT short AS commit, date, author FROM commits WHERE hash IN
 (SELECT hash FROM files WHERE path = 'item_30_service.py' OR path LIKE '%/item\\_30\\_service.py' ESCAPE '\\')""")
def file_history_by_suffix(t):
    """Fallback when the name is only the tail of a touched path."""
    found = history.commits_naming(t.commits, t.commit_files, "item_30_service.py")
    return found.select(F.col("short").alias("commit"), "date", "author")


@query("file_authors", with_(**HIST) + f""" SELECT c.author AS name, COUNT(*) AS commits FROM commits c WHERE hash IN
 (SELECT hash FROM files WHERE path = {path_of('7')}) GROUP BY 1 ORDER BY commits DESC, name LIMIT 8""")
def file_authors(t):
    """Authors of one module."""
    return history.file_authors(history.commits_touching(t.commits, t.commit_files, _path(t, 7)))


@query("commit_lookup", with_(**HIST) + f""", c AS (SELECT * FROM commits WHERE starts_with(hash, '0003'))
 SELECT c.hash, c.short, c.date, c.author, c.subject AS message, (SELECT COUNT(*) FROM c) AS candidates, COUNT(f.path) AS files_changed,
 (SELECT string_agg(path, ', ' ORDER BY path) FROM (SELECT path FROM files f2 WHERE f2.hash = c.hash ORDER BY path LIMIT 30)) AS files
 FROM c LEFT JOIN files f USING (hash) GROUP BY ALL""")
def commit_lookup(t):
    """Commits a four-character prefix names, each with its own files; more than one candidate means it is ambiguous."""
    found = history.commit_by_prefix(t.commits, "0003")
    return found.join(history.commit_files(found, t.commit_files), "hash", "left").select(
        "hash", "short", "date", "author", F.col("subject").alias("message"), "candidates", F.coalesce("files_changed", F.lit(0)).alias("files_changed"), "files")


@query("bulk_commits", with_(**HIST) + """ SELECT c.hash, COUNT(f.path) AS n_files, COUNT(f.path) > 5 AS bulk FROM commits c LEFT JOIN files f USING (hash) GROUP BY 1""")
def bulk_commits(t):
    """File count and bulk flag per commit (commits without files included); bulk above 5 files here."""
    return history.with_bulk_flag(t.commits, t.commit_files, 5).select("hash", "n_files", "bulk")


@query("developer_nodes", with_(commits=COMMITS_SQL) + """ SELECT author_id AS id, author AS name FROM
 (SELECT *, ROW_NUMBER() OVER (PARTITION BY author_id ORDER BY date DESC, k DESC) AS n FROM commits) WHERE n = 1""")
def developer_nodes(t):
    """Developers under the name of their last commit."""
    return history.latest_names(t.commits, ORDER)


@query("modified_edges", with_(**HIST, modules=MODULES_SQL) + """ SELECT hash, path, added, deleted FROM files WHERE path IN (SELECT path FROM modules)""")
def modified_edges(t):
    """MODIFIED relations of the graph: every touched path that is a module now."""
    return history.modified_edges(t.commit_files.drop("k"), t.modules, t.commits, ORDER)


@query("commit_index", with_(commits=COMMITS_SQL) + " SELECT hash, date, ROW_NUMBER() OVER (ORDER BY date, k) - 1 AS idx FROM commits")
def commit_index(t):
    """Consecutive positions over the whole history, oldest first."""
    return global_index(t.commits.select("hash", "date", "k"), [F.col("date"), F.col("k")]).select("hash", "date", "idx")


@query("snapshot_sample", with_(commits=COMMITS_SQL) + """, c AS (SELECT hash, ROW_NUMBER() OVER (ORDER BY date, k) - 1 AS idx FROM commits),
 picks AS (SELECT DISTINCT CAST(round_even(i * ((SELECT COUNT(*) FROM c) - 1)::DOUBLE / 19.0, 0) AS BIGINT) AS idx FROM range(20) r(i))
 SELECT hash, idx FROM c WHERE idx IN (SELECT idx FROM picks)""")
def snapshot_sample(t):
    """Twenty evenly spaced commits, the last one included."""
    indexed = global_index(t.commits.select("hash", "date", "k"), [F.col("date"), F.col("k")])
    return temporal.evenly_spaced(indexed, 20).select("hash", "idx")


@query("snapshot_candidates", with_(**HIST) + """ SELECT c.hash FROM commits c WHERE c.k % 10 = 0 OR c.k % 7 = 0 OR EXISTS
 (SELECT 1 FROM files f WHERE f.hash = c.hash AND (regexp_matches(f.path, '[.](py|js|jsx|ts|tsx)$') OR regexp_matches(f.old_path, '[.](py|js|jsx|ts|tsx)$')))""")
def snapshot_candidates(t):
    """Merges, commits outside the mined window, and commits that changed source files."""
    all_commits = t.commits.withColumn("is_merge", F.col("k") % 10 == 0)
    mined = t.commits.filter("k % 7 <> 0")
    return temporal.snapshot_candidates(all_commits, t.commit_files, mined).select("hash")


@query("commit_metadata", with_(commits=COMMITS_SQL) + """ SELECT hash, CASE WHEN k % 5 = 0 THEN 'Merge ' || subject ELSE subject END AS subject, date FROM commits""")
def commit_metadata(t):
    """Metadata of commits that may be missing from the mined set, filled from a second source."""
    mined = t.commits.filter("k % 5 <> 0")
    merges = t.commits.filter("k % 5 = 0").withColumn("subject", F.concat(F.lit("Merge "), "subject"))
    return history.with_fallback_metadata(t.commits.select("hash"), mined, merges, ["subject", "date"])


@query("shallow_boundary", with_(commits=COMMITS_SQL) + f""" SELECT hash, author FROM commits WHERE hash NOT IN
 (SELECT {hash_of('o_orderkey')} FROM orders WHERE o_orderstatus = 'P')""")
def shallow_boundary(t):
    """Commits left once the cut-off points of a shallow clone are removed."""
    boundary = t.table("orders").filter("o_orderstatus = 'P'").select(F.expr(hash_of("o_orderkey")).alias("hash"))
    return history.without_boundary(t.commits, boundary).select("hash", "author")
