"""Log and diff text, findings, issues, batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.operators import batching, review, rules
from codestrata.plans.architecture import SNAP, snap_judged
from codestrata.plans.registry import query
from codestrata.plans.tables import path_of, with_
from codestrata.session import spread
from codestrata.sources import gitlog

# --- git log text: one record per event ----------------------------------------------------------------------

NUL = "\x00"


def log_records(t):
    e = t.table("events")
    sid, kid = F.col("event_id").cast("string"), F.col("event_id")
    parents = F.when(kid % 10 == 0, F.concat(F.sha1(F.concat(sid, F.lit("a"))), F.lit(" "), F.sha1(F.concat(sid, F.lit("b"))))).otherwise(
        F.when(kid % 10 == 1, "").otherwise(F.sha1(F.concat(sid, F.lit("a")))))
    name = F.when(F.col("user_id") % 17 == 0, " ").otherwise(F.format_string(" dev %d ", F.col("user_id") % 50))
    email = F.when(F.col("user_id") % 5 == 0, "").otherwise(F.format_string("U%d@Example.org", "user_id"))
    stamp = F.when(kid % 11 == 0, "n/a").otherwise((kid * 1000).cast("string"))
    one = F.concat(F.lit("3\t1\tsrc/a_"), sid, F.lit(".py" + NUL))
    rename = F.concat(F.lit("0\t2\t" + NUL + "old/"), sid, F.lit(".py" + NUL + "new/"), sid, F.lit(".py" + NUL))
    binary = F.concat(F.lit("-\t-\timg/"), sid, F.lit(".png" + NUL))
    stat = (F.when(F.col("event_type") == "click", one).when(F.col("event_type") == "signup", F.concat(rename, one))
            .when(F.col("event_type") == "error", F.concat(binary, one)).when(F.col("event_type") == "purchase", rename).otherwise(""))
    body = F.concat(F.lit("\n  "), F.col("props"), F.lit("\nmore\n"))
    fields = [F.sha1(sid), parents, name, email, stamp, F.concat(F.col("event_type"), F.lit(" change ")), body, F.concat(F.lit(NUL + "\n"), stat)]
    return e.select(F.concat_ws(gitlog.FIELD, *fields).alias("record"))


@query("git_log_commits", """SELECT sha1(CAST(event_id AS VARCHAR)) AS hash, CASE WHEN event_id % 10 = 0 THEN sha1(event_id || 'a') || ',' || sha1(event_id || 'b') WHEN event_id % 10 = 1 THEN '' ELSE sha1(event_id || 'a') END AS parents,
 CASE WHEN user_id % 17 = 0 THEN 'unknown' ELSE 'dev ' || (user_id % 50) END AS author,
 substr(sha1(CASE WHEN user_id % 5 <> 0 THEN 'u' || user_id || '@example.org' WHEN user_id % 17 = 0 THEN '' ELSE 'dev ' || (user_id % 50) END), 1, 12) AS author_id,
 CASE WHEN event_id % 11 = 0 THEN 0 ELSE event_id * 1000 END AS timestamp, event_type || ' change' AS subject, props || chr(10) || 'more' AS body,
 CASE event_type WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END::BIGINT AS n_files FROM events""")
def git_log_commits(t):
    """Commit headers parsed from log text."""
    return gitlog.parse_commits(log_records(t)).select(
        "hash", F.array_join("parents", ",").alias("parents"), "author", "author_id", "timestamp", "subject", "body", "n_files")


@query("git_log_files", """SELECT sha1(CAST(event_id AS VARCHAR)) AS hash, 'src/a_' || event_id || '.py' AS path, CAST(NULL AS VARCHAR) AS old_path, 3::BIGINT AS added, 1::BIGINT AS deleted FROM events WHERE event_type IN ('click', 'signup', 'error')
 UNION ALL SELECT sha1(CAST(event_id AS VARCHAR)), 'new/' || event_id || '.py', 'old/' || event_id || '.py', 0, 2 FROM events WHERE event_type IN ('signup', 'purchase')
 UNION ALL SELECT sha1(CAST(event_id AS VARCHAR)), 'img/' || event_id || '.png', NULL, 0, 0 FROM events WHERE event_type = 'error'""")
def git_log_files(t):
    """Touched files parsed from numstat text, renames and binaries included."""
    return gitlog.commit_files(gitlog.parse_commits(log_records(t))).drop("file_ord")


# --- diff text: one diff per order ----------------------------------------------------------------------------

START = "(o_orderkey % 90 + 1)"
ORDER_FILE = "CONCAT('src/o', CAST(o_orderkey AS STRING), CASE WHEN o_orderkey % 6 = 0 THEN '.md' ELSE '.py' END)"


def diffs(t):
    # spread before the texts are built, which are far longer
    o = spread(t.table("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"))
    k, start = F.col("o_orderkey").cast("string"), F.expr(START)
    p = F.expr(ORDER_FILE)
    head = F.concat(F.lit("diff --git a/"), p, F.lit(" b/"), p, F.lit("\n"))
    mode = (F.when(F.col("o_orderkey") % 13 == 0, F.concat(F.lit("deleted file mode 100644\n--- a/"), p, F.lit("\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-gone\n-gone too\n")))
            .when(F.col("o_orderkey") % 17 == 0, F.concat(F.lit("Binary files a/"), p, F.lit(" and b/"), p, F.lit(" differ\n"))))
    intro = (F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("new file mode 100644\n--- /dev/null\n+++ b/"), p, F.lit("\n")))
             .when(F.col("o_orderstatus") == "P", F.concat(F.lit("similarity index 90%\nrename from old/"), k, F.lit(".py\nrename to "), p, F.lit("\n--- a/old/"), k, F.lit(".py\n+++ b/"), p, F.lit("\n")))
             .otherwise(F.concat(F.lit("index 1..2\n--- a/"), p, F.lit("\n+++ b/"), p, F.lit("\n"))))
    hunks = F.concat(F.lit("@@ -1,3 +"), start.cast("string"), F.lit(",4 @@ def f():\n keep "), k, F.lit("\n-old line\n+added first "), k, F.lit("\n+++ counter\n\n@@ -40,2 +"),
                     (start + 100).cast("string"), F.lit(" @@\n-drop\n-drop\n+tail "), F.col("o_orderpriority"), F.lit("\n\\ No newline at end of file\n"))
    return o.select("o_orderkey", F.concat(head, F.coalesce(mode, F.concat(intro, hunks))).alias("diff"))


LIVE = "o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0"


@query("diff_files", f"""SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 17 <> 0 THEN {ORDER_FILE} END AS path, CASE WHEN o_orderkey % 13 = 0 THEN {ORDER_FILE} WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN NULL
 WHEN o_orderstatus = 'P' THEN CONCAT('old/', CAST(o_orderkey AS STRING), '.py') ELSE {ORDER_FILE} END AS old_path,
 CASE WHEN o_orderkey % 13 = 0 THEN 'deleted' WHEN o_orderkey % 17 = 0 THEN 'modified' WHEN o_orderstatus = 'F' THEN 'added' WHEN o_orderstatus = 'P' THEN 'renamed' ELSE 'modified' END AS status,
 o_orderkey % 13 <> 0 AND o_orderkey % 17 = 0 AS "binary", CASE WHEN o_orderkey % 13 = 0 THEN 1 WHEN o_orderkey % 17 = 0 THEN 0 ELSE 2 END::BIGINT AS n_hunks
 FROM orders""")
def diff_files(t):
    """Files of every diff with status and hunk count (binary files have no path lines, so no path)."""
    found = gitlog.diff_files(diffs(t), ["o_orderkey"])
    return found.select("o_orderkey", "path", "old_path", "status", "binary", F.size("hunks").cast("bigint").alias("n_hunks"))


@query("quoted_diff_files", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'plain name ' || o_orderkey || '.py' ELSE 'café_' || o_orderkey || '/tab' || chr(9) || 'here "q"' || chr(92) || 'new.py' END AS path,
 CASE WHEN o_orderkey % 3 = 0 THEN 'plain name ' || o_orderkey || '.py' ELSE 'café_' || o_orderkey || '/tab' || chr(9) || 'here "q"' || chr(92) || CASE WHEN o_orderkey % 3 = 1 THEN 'old.py' ELSE 'new.py' END END AS old_path,
 CASE WHEN o_orderkey % 3 = 1 THEN 'renamed' ELSE 'modified' END AS status FROM orders""")
def quoted_diff_files(t):
    """Paths of diffs that quote them: octal bytes, tabs, quotes and backslashes; and names with spaces, which end at a tab."""
    k = F.col("o_orderkey").cast("string")

    def quoted(side: str, name: str):
        return F.concat(F.lit(f'"{side}caf\\303\\251_'), k, F.lit(f'/tab\\there \\"q\\"\\\\{name}.py"'))

    body = F.lit("\n@@ -1 +1 @@\n-a\n+b\n")
    renamed = F.concat(F.lit("similarity index 90%\nrename from "), quoted("", "old"), F.lit("\nrename to "), quoted("", "new"),
                       F.lit("\n--- "), quoted("a/", "old"), F.lit("\n+++ "), quoted("b/", "new"), body)
    changed = F.concat(F.lit("index 1..2\n--- "), quoted("a/", "new"), F.lit("\n+++ "), quoted("b/", "new"), body)
    spaced = F.concat(F.lit("index 1..2\n--- a/plain name "), k, F.lit(".py\t\n+++ b/plain name "), k, F.lit(".py\t"), body)
    text = F.when(F.col("o_orderkey") % 3 == 0, spaced).when(F.col("o_orderkey") % 3 == 1, renamed).otherwise(changed)
    texts = t.table("orders").select("o_orderkey", F.concat(F.lit("diff --git x y\n"), text).alias("diff"))
    return gitlog.diff_files(texts, ["o_orderkey"]).select("o_orderkey", "path", "old_path", "status")


@query("diff_lines", f"""SELECT o_orderkey, kind, COALESCE(new_no, -1)::BIGINT AS new_no, txt AS text FROM (
 SELECT o_orderkey, ' ' AS kind, {START} AS new_no, 'keep ' || o_orderkey AS txt FROM orders WHERE {LIVE}
 UNION ALL SELECT o_orderkey, '-', NULL, 'old line' FROM orders WHERE {LIVE}
 UNION ALL SELECT o_orderkey, '+', {START} + 1, 'added first ' || o_orderkey FROM orders WHERE {LIVE}
 UNION ALL SELECT o_orderkey, '+', {START} + 2, '++ counter' FROM orders WHERE {LIVE}
 UNION ALL SELECT o_orderkey, '-', NULL, 'drop' FROM orders WHERE {LIVE} UNION ALL SELECT o_orderkey, '-', NULL, 'drop' FROM orders WHERE {LIVE}
 UNION ALL SELECT o_orderkey, ' ', {START} + 3, '' FROM orders WHERE {LIVE}
 UNION ALL SELECT o_orderkey, '+', {START} + 100, 'tail ' || o_orderpriority FROM orders WHERE {LIVE}
 UNION ALL SELECT o_orderkey, '-', NULL, 'gone' FROM orders WHERE o_orderkey % 13 = 0 UNION ALL SELECT o_orderkey, '-', NULL, 'gone too' FROM orders WHERE o_orderkey % 13 = 0)""")
def diff_lines(t):
    """Every hunk line with its number in the new file (-1 for removed lines)."""
    lines = gitlog.diff_lines(gitlog.diff_files(diffs(t), ["o_orderkey"]), ["o_orderkey"])
    return lines.select("o_orderkey", "kind", F.coalesce("new_no", F.lit(-1)).alias("new_no"), "text")


@query("diff_rendering", f"""WITH l AS (SELECT o_orderkey, {START} AS s, o_orderpriority AS p FROM orders WHERE {LIVE})
 SELECT o_orderkey, UNNEST([lpad(s::VARCHAR, 5, ' ') || '   keep ' || o_orderkey, '      - old line', lpad((s + 1)::VARCHAR, 5, ' ') || ' + added first ' || o_orderkey,
  lpad((s + 2)::VARCHAR, 5, ' ') || ' + ++ counter', lpad((s + 3)::VARCHAR, 5, ' ') || '   ', '      - drop', '      - drop', lpad((s + 100)::VARCHAR, 5, ' ') || ' + tail ' || p]) AS line FROM l
 UNION ALL SELECT o_orderkey, UNNEST(['      - gone', '      - gone too']) FROM orders WHERE o_orderkey % 13 = 0""")
def diff_rendering(t):
    """Display form of every line of every diff."""
    lines = gitlog.diff_lines(gitlog.diff_files(diffs(t), ["o_orderkey"]), ["o_orderkey"])
    return lines.select("o_orderkey", gitlog.render_lines(lines).alias("line"))


def _changed(t):
    return gitlog.with_sizes(gitlog.diff_files(diffs(t), ["o_orderkey"])).filter("path IS NOT NULL")


@query("review_skips", f"""SELECT {ORDER_FILE} AS path, CASE WHEN o_orderkey % 13 = 0 THEN 'deleted' WHEN o_orderkey % 6 = 0 THEN 'not source code' ELSE '' END AS reason
 FROM orders WHERE o_orderkey % 13 = 0 OR o_orderkey % 17 <> 0""")
def review_skips(t):
    """Why each changed file is left out of a review."""
    changed = _changed(t)
    return changed.select("path", review.skip_reasons(changed).alias("reason"))


@query("review_order", f"""SELECT {ORDER_FILE} AS path, 3::BIGINT AS n_added, o_orderkey % 3 = 0 AS is_test FROM orders WHERE {LIVE} AND o_orderkey % 6 <> 0 ORDER BY is_test, n_added DESC, path LIMIT 12""")
def review_order(t):
    """The dozen files a review looks at: tests last, most added lines first."""
    changed = _changed(t)
    kept = changed.filter(review.skip_reasons(changed) == "").withColumn("is_test", F.col("o_orderkey") % 3 == 0)
    return review.review_order(kept).select("path", "n_added", "is_test")


# --- findings -------------------------------------------------------------------------------------------------

FINDING = """CASE WHEN o_orderkey % 19 = 0 THEN 'src/missing.py' ELSE CONCAT('src/o', CAST(o_orderkey AS STRING), '.py') END"""
F_LINE = f"CASE WHEN o_orderkey % 29 = 0 THEN 'x' ELSE CAST({START} + o_orderkey % 9 AS STRING) END"
F_SEV = "CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN ' Medium ' WHEN '4-NOT SPECIFIED' THEN 'severe' ELSE 'low' END"
F_CAT = "CASE WHEN o_orderkey % 7 = 0 THEN 'style' ELSE 'Bug' END"
F_CONF = "CASE WHEN o_orderkey % 11 = 0 THEN '0.3' WHEN o_orderkey % 31 = 0 THEN 'high' ELSE '0.9' END"
F_QUOTE = "CASE WHEN o_orderkey % 5 = 0 THEN 'no such text' ELSE CONCAT('added  first ', CAST(o_orderkey AS STRING)) END"
F_TITLE = "CASE WHEN o_orderkey % 23 = 0 THEN '  ' ELSE 'title' END"
ADDED = f"({START} + 1, {START} + 2, {START} + 100)"


@query("validate_findings", f"""WITH f AS (SELECT o_orderkey AS id, {FINDING} AS file, TRY_CAST({F_LINE} AS BIGINT) AS line, lower(trim({F_SEV})) AS sev, lower({F_CAT}) AS cat, {F_CONF} AS conf,
  regexp_replace({F_QUOTE}, '\\s+', ' ', 'g') AS quote, trim({F_TITLE}) AS title, {START} AS s , {LIVE} AND {ORDER_FILE} = {FINDING} AS live FROM orders)
 SELECT id, COALESCE(CASE WHEN NOT live THEN 'file ''' || file || ''' is not in the reviewed diff' WHEN line IS NULL THEN 'line is not a number'
 WHEN NOT (line BETWEEN s - 1 AND s + 4 OR line BETWEEN s + 98 AND s + 102) THEN 'line ' || line || ' of ' || file || ' is not an added line'
 WHEN sev NOT IN ('critical', 'high', 'medium', 'low') THEN 'severity ''' || sev || ''' is not one of critical, high, medium, low'
 WHEN cat <> 'bug' THEN 'category ''' || cat || ''' is not one of bug, security, error-handling, concurrency, resource, performance, architecture'
 WHEN conf = 'high' THEN 'confidence is not a number' WHEN conf = '0.3' THEN 'confidence 0.3 is below 0.5'
 WHEN quote = 'no such text' OR NOT (s + 1 BETWEEN line - 1 AND line + 2) THEN 'quote does not match line ' || line || ' of ' || file
 WHEN title = '' THEN 'title is empty' END, '') AS reason FROM f""")
def validate_findings(t):
    """First failing grounding check per finding, '' when it is grounded in the diff."""
    o = t.table("orders")
    findings = o.select(F.col("o_orderkey").alias("id"), F.expr(FINDING).alias("file"), F.expr(F_LINE).alias("line"), F.expr(F_SEV).alias("severity"), F.expr(F_CAT).alias("category"),
                        F.expr(F_CONF).alias("confidence"), F.expr(F_QUOTE).alias("quote"), F.expr(F_TITLE).alias("title"))
    lines = gitlog.diff_lines(gitlog.diff_files(diffs(t), ["o_orderkey"]), ["o_orderkey"]).filter("kind <> '-'").select(
        F.col("path").alias("file"), F.col("new_no").alias("line_no"), F.col("text").alias("line"), "kind")
    wanted = findings.select("file", F.col("line").try_cast("bigint").alias("line_no")).filter("line_no IS NOT NULL")
    windows = review.line_windows(lines, wanted, ["file"])
    judged = review.validate(findings, lines.filter("kind = '+'"), windows)
    return judged.select("id", F.coalesce("reason", F.lit("")).alias("reason"))


FOUND = dict(**SNAP, head="SELECT * FROM judged WHERE violates AND idx = 60", base="SELECT * FROM judged WHERE violates AND idx = 5",
             fresh="SELECT * FROM head h WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rule_name = h.rule_name AND b.src = h.src AND b.dst = h.dst)")


def _head_base(t):
    found = rules.violations(snap_judged(t))
    return found.filter("idx = 60").drop("idx"), found.filter("idx = 5").drop("idx")


@query("introduced_findings", with_(**FOUND) + """ SELECT f.rule_name, src AS file, COUNT(*) AS n_edges, CASE WHEN MAX(severity) >= 3 THEN 'high' WHEN MAX(severity) = 2 THEN 'medium' ELSE 'low' END AS severity,
 MIN(dst) AS first_callee, 'New ' || r.rule_from || ' → ' || r.rule_to || ' dependency breaks rule ''' || f.rule_name || '''' AS title, substr(sha1('arch|' || f.rule_name || '|' || src), 1, 16) AS fingerprint
 FROM fresh f JOIN (SELECT rule_name, rule_from, rule_to FROM rules) r USING (rule_name) GROUP BY ALL""")
def introduced_findings(t):
    """Architecture findings: violations at head that were not at base, per rule and module."""
    head, base = _head_base(t)
    found = review.architecture_findings(review.introduced_violations(head, base), t.rules)
    return found.select("rule_name", "file", "n_edges", "severity", "first_callee", "title", "fingerprint")


@query("resolved_violations", with_(**FOUND) + """ SELECT DISTINCT rule_name, src AS module FROM base b
 WHERE NOT EXISTS (SELECT 1 FROM head h WHERE b.rule_name = h.rule_name AND b.src = h.src AND b.dst = h.dst)""")
def resolved_violations(t):
    """(rule, module) pairs violated at base and no longer at head."""
    return review.resolved_pairs(*_head_base(t))


L_FINDINGS = f"""SELECT {path_of('l_partkey')} AS file, l_orderkey % 50 AS line, CASE l_returnflag WHEN 'R' THEN 'architecture' WHEN 'A' THEN 'bug' ELSE 'security' END AS category,
 l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS n FROM lineitem WHERE l_linestatus = 'F'"""
L_ARCH = f"SELECT DISTINCT {path_of('l_partkey')} AS file, l_orderkey % 50 AS line FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'R'"


@query("near_rule_findings", f"""WITH f AS ({L_FINDINGS}), a AS ({L_ARCH}) SELECT f.* FROM f WHERE NOT (category = 'architecture' AND EXISTS
 (SELECT 1 FROM a WHERE a.file = f.file AND abs(a.line - f.line) <= 2))""")
def near_rule_findings(t):
    """Findings kept after dropping architecture ones within two lines of a rule finding."""
    li = t.table("lineitem")
    f = li.filter("l_linestatus = 'F'").select(
        F.expr(path_of("l_partkey")).alias("file"), (F.col("l_orderkey") % 50).alias("line"),
        F.expr("CASE l_returnflag WHEN 'R' THEN 'architecture' WHEN 'A' THEN 'bug' ELSE 'security' END").alias("category"),
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("bigint").alias("n"))
    a = li.filter("l_linestatus = 'O' AND l_returnflag = 'R'").select(F.expr(path_of("l_partkey")).alias("file"), (F.col("l_orderkey") % 50).alias("line"))
    return review.drop_near_rule_findings(f, a).select("file", "line", "category", "k", "n")


RANK_SQL = f"""WITH f AS (SELECT o_orderkey AS ord, substr(sha1(CAST(o_custkey % 700 AS STRING)), 1, 16) AS fingerprint, CASE WHEN o_orderstatus = 'P' THEN 'architecture' ELSE 'code' END AS kind,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS severity, 0.5 + (o_orderkey % 5) / 10.0::DOUBLE AS confidence,
  {path_of('o_custkey')} AS file, o_orderkey % 40 AS line FROM orders),
 u AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY fingerprint ORDER BY kind <> 'architecture', ord) AS n FROM f) WHERE n = 1),
 s AS (SELECT *, ROUND(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END * confidence, 2) AS score FROM u),
 ranked AS (SELECT *, ROW_NUMBER() OVER (ORDER BY score DESC, kind <> 'architecture', file, line, ord) AS rank FROM s)"""


def _findings(t):
    return t.table("orders").select(
        F.col("o_orderkey").alias("ord"), F.substring(F.sha1((F.col("o_custkey") % 700).cast("string")), 1, 16).alias("fingerprint"),
        F.when(F.col("o_orderstatus") == "P", "architecture").otherwise("code").alias("kind"),
        F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END").alias("severity"),
        (F.lit(0.5) + (F.col("o_orderkey") % 5) / F.lit(10.0)).alias("confidence"), F.expr(path_of("o_custkey")).alias("file"), (F.col("o_orderkey") % 40).alias("line"))


@query("rank_findings", RANK_SQL + " SELECT fingerprint, kind, severity, score, rank FROM ranked")
def rank_findings(t):
    """One finding per fingerprint, ranked by severity weight times confidence."""
    return review.rank_findings(_findings(t)).select("fingerprint", "kind", "severity", "score", "rank")


ISSUE_SQL = """, issues AS (SELECT fingerprint, arg_min(state, number) AS state, MIN(number) AS number FROM (SELECT substr(sha1(CAST(c_custkey % 900 AS STRING)), 1, 16) AS fingerprint,
  CASE WHEN c_custkey % 2 = 0 THEN 'open' ELSE 'closed' END AS state, c_custkey AS number FROM customer WHERE c_mktsegment <> 'FURNITURE') GROUP BY 1),
 j AS (SELECT r.fingerprint, r.rank, CASE WHEN i.state = 'open' THEN 'already open as #' || i.number WHEN i.state = 'closed' THEN 'closed as #' || i.number || '; not re-raised'
  WHEN r.severity = 'low' THEN 'below the medium threshold' END AS blocked FROM ranked r LEFT JOIN issues i USING (fingerprint)),
 c AS (SELECT fingerprint FROM j WHERE blocked IS NULL ORDER BY rank LIMIT 10)
 SELECT fingerprint, CASE WHEN fingerprint IN (SELECT fingerprint FROM c) THEN 'create' ELSE 'skip' END AS action,
 CASE WHEN fingerprint IN (SELECT fingerprint FROM c) THEN '' ELSE COALESCE(blocked, 'over the 10-issue limit for one run') END AS reason FROM j"""


def raw_issues(t):
    """Issues as fetched: the finding's identity sits in a base64 marker inside the body."""
    c = t.table("customer")
    meta = F.struct(F.substring(F.sha1((F.col("c_custkey") % 900).cast("string")), 1, 16).alias("fp"), F.lit("code").alias("kind"),
                    F.format_string("f%d.py", F.col("c_custkey") % 40).alias("file"), F.format_string("let q = %d", F.col("c_custkey") % 30).alias("quote"))
    body = F.concat(F.lit("Some text\n"), F.when(F.col("c_mktsegment") == "FURNITURE", "no marker").otherwise(review.encode_meta(meta)))
    return c.select(F.col("c_custkey").alias("number"), F.when(F.col("c_custkey") % 2 == 0, "open").otherwise("closed").alias("state"), F.col("c_name").alias("title"), body.alias("body"),
                    F.lit(False).alias("is_pull_request"))


@query("existing_issues", """SELECT c_custkey AS number, CASE WHEN c_custkey % 2 = 0 THEN 'open' ELSE 'closed' END AS state, substr(sha1(CAST(c_custkey % 900 AS STRING)), 1, 16) AS fingerprint, 'f' || (c_custkey % 40) || '.py' AS file
 FROM customer WHERE c_mktsegment <> 'FURNITURE'""")
def existing_issues(t):
    """Issues whose body carries a decodable marker."""
    return review.decode_issues(raw_issues(t)).select("number", "state", "fingerprint", "file")


@query("issue_plan", RANK_SQL + ISSUE_SQL)
def issue_plan(t):
    """What a run would create or skip, and why."""
    return review.plan_issues(review.rank_findings(_findings(t)), review.decode_issues(raw_issues(t)))


@query("resolvable_issues", """WITH i AS (SELECT c_custkey AS number, substr(sha1(CAST(c_custkey % 900 AS STRING)), 1, 16) AS fp, c_custkey % 40 AS f, c_custkey % 30 AS q FROM customer
  WHERE c_mktsegment <> 'FURNITURE' AND c_custkey % 2 = 0),
 cur AS (SELECT DISTINCT substr(sha1(CAST(o_custkey % 700 AS STRING)), 1, 16) AS fp FROM orders)
 SELECT number, 'the flagged code is no longer in the file' AS reason FROM i WHERE fp NOT IN (SELECT fp FROM cur)
 AND NOT EXISTS (SELECT 1 FROM nation n WHERE n.n_nationkey = i.f AND contains('let q = ' || (n.n_nationkey + n.n_regionkey) || ';', 'let q = ' || i.q))""")
def resolvable_issues(t):
    """Open issues missing from this review whose code is verifiably gone."""
    n = t.table("nation")
    files = n.select(F.format_string("f%d.py", "n_nationkey").alias("file"), F.format_string("let   q =\n %d;", F.col("n_nationkey") + F.col("n_regionkey")).alias("content"))
    none = t.modules.select(F.lit("").alias("rule_name"), F.col("path").alias("module")).filter("false")
    return review.resolvable_issues(review.decode_issues(raw_issues(t)), _findings(t), none, files)


@query("line_batches", """WITH RECURSIVE l AS (SELECT doc_id, generate_subscripts(a, 1) AS n, length(UNNEST(a)) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
 w AS (SELECT doc_id, n, s, 0 AS b, s AS used FROM l WHERE n = 1 UNION ALL
  SELECT l.doc_id, l.n, l.s, CASE WHEN w.used > 0 AND w.used + l.s > 1000 THEN w.b + 1 ELSE w.b END, CASE WHEN w.used > 0 AND w.used + l.s > 1000 THEN l.s ELSE w.used + l.s END
  FROM w JOIN l ON l.doc_id = w.doc_id AND l.n = w.n + 1)
 SELECT doc_id, CAST(b AS BIGINT) AS batch, COUNT(*) AS lines, CAST(SUM(s) AS BIGINT) AS chars FROM w GROUP BY 1, 2""")
def line_batches(t):
    """Next-fit batches of each document's lines under a budget of 1,000 characters."""
    sized = t.table("documents").select("doc_id", F.transform(F.split("text", "\n"), lambda x: F.length(x)).alias("sizes"))
    zipped = sized.select("doc_id", F.explode(F.arrays_zip(review.next_fit(F.col("sizes"), 1000).alias("b"), F.col("sizes").alias("s"))).alias("z"))
    return zipped.groupBy("doc_id", F.col("z.b").cast("bigint").alias("batch")).agg(F.count(F.lit(1)).alias("lines"), F.sum("z.s").alias("chars"))


PARTS = """WITH RECURSIVE f AS (SELECT l_orderkey AS o, l_linenumber AS l, SUM(l_suppkey) AS a, SUM(l_partkey) AS n FROM lineitem GROUP BY 1, 2),
 h AS (SELECT o, l, i, LENGTH('@@ -' || i || ' +' || 10 * i || ',1 @@') + 9 + CAST((a * i) % 200 AS BIGINT) AS s FROM (SELECT o, l, a, UNNEST(GENERATE_SERIES(1, CAST(1 + n % 7 AS BIGINT))) AS i FROM f)),
 w(o, l, i, p, used, s) AS (SELECT o, l, i, 0, s, s FROM h WHERE i = 1 UNION ALL
  SELECT h.o, h.l, h.i, CASE WHEN w.used + h.s > 150 THEN w.p + 1 ELSE w.p END, CASE WHEN w.used + h.s > 150 THEN h.s ELSE w.used + h.s END, h.s
  FROM w JOIN h ON h.o = w.o AND h.l = w.l AND h.i = w.i + 1),
 parts AS (SELECT o, l, p, COUNT(*) AS hunks, CAST(SUM(LEAST(s, 150)) + COUNT(*) - 1 AS BIGINT) AS chars FROM w GROUP BY 1, 2, 3),
 r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY o ORDER BY l, p) AS k FROM parts),
 b(o, k, batch, used) AS (SELECT o, k, 0, chars FROM r WHERE k = 1 UNION ALL
  SELECT r.o, r.k, CASE WHEN b.used + r.chars > 150 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.used + r.chars > 150 THEN r.chars ELSE b.used + r.chars END
  FROM b JOIN r ON r.o = b.o AND r.k = b.k + 1)"""


def line_item_diffs(t):
    """One diff per order: a file per line number, one-line hunks of many lengths."""
    files = t.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_suppkey").alias("a"), F.sum("l_partkey").alias("n"))
    name = F.format_string("src/f%d.py", "l_linenumber")
    hunks = F.array_join(F.transform(F.sequence(F.lit(1).cast("bigint"), 1 + F.col("n") % 7), lambda i: F.concat(
        F.format_string("@@ -%d +%d,1 @@\n+", i, 10 * i), F.repeat(F.lit("x"), (F.col("a") * i % 200).cast("int")))), "\n")
    one = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\nindex 1..2\n--- a/"), name, F.lit("\n+++ b/"), name, F.lit("\n"), hunks)
    texts = files.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", one.alias("s")))).alias("parts"))
    return texts.select("o_orderkey", F.array_join(F.transform("parts", lambda x: x["s"]), "\n").alias("diff"))


@query("hunk_batches", f"""{PARTS} SELECT r.o AS o_orderkey, 'src/f' || l || '.py' AS path, CAST(p AS BIGINT) AS part, hunks, chars, CAST(batch AS BIGINT) AS batch
 FROM r JOIN b ON b.o = r.o AND b.k = r.k""")
def hunk_batches(t):
    """Every diff's files in parts by hunks, and parts in requests, under a budget of 150 characters."""
    files = gitlog.diff_files(line_item_diffs(t), ["o_orderkey"])
    return batching.diff_batches(files, ["o_orderkey"], ["section"], 150).select("o_orderkey", "path", "part", "hunks", "chars", "batch")


@query("finding_fingerprints", """SELECT doc_id, substr(sha1('code|bug|' || source || '|' || trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))), 1, 16) AS fingerprint FROM documents""")
def finding_fingerprints(t):
    """Stable identity of a finding from its category, file and whitespace-collapsed quote."""
    return t.table("documents").select("doc_id", review.code_fingerprint(F.lit("bug"), F.col("source"), F.col("text")).alias("fingerprint"))
