"""Text operators, source reading, documents and diagrams, evaluation, streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.functions import paths, text
from codestrata.operators import documents, evaluation, graph, pull_requests, rules, source_text
from codestrata.plans.architecture import CTE, SNAP, judged, snap_judged
from codestrata.plans.decisions import EVIDENCE_SQL, _evidence, shown, tokens_sql
from codestrata.plans.evolution import SNAP_HEALTH, snapshot_health
from codestrata.plans.registry import query
from codestrata.plans.structure import CALLEE, CALLER, FUN, GROUP, LAYERED, MOD
from codestrata.plans.tables import CALLS_SQL, COMMITS_SQL, FILES_SQL, IMPORTS_SQL, with_
from codestrata.streaming import micro_review

# --- questions ------------------------------------------------------------------------------------------------

PLAIN = "regexp_replace(text, '[À-ÖØ-öø-ÿĀ-ſ]', 'x', 'g')"  # accented letters are word characters


def intent_sql(name: str) -> str:
    return f"regexp_matches({PLAIN}, '{text.INTENTS[name].replace('(?iU)', '(?i)')}')"


ROUTE = f"""WITH f AS (SELECT conv_id, turn, {intent_sql('architectural')} AS a, {intent_sql('historical')} AS h, {intent_sql('rationale')} AS r,
  regexp_matches({PLAIN}, '{text.NAMES_CODE.replace('(?U)', '').replace("'", "''")}') AS code FROM conversations WHERE role = 'user'),
 i AS (SELECT conv_id, turn, (CASE WHEN NOT (a OR h OR r) OR code THEN ['structural'] ELSE [] END) || (CASE WHEN a THEN ['architectural'] ELSE [] END)
  || (CASE WHEN h THEN ['historical'] ELSE [] END) || (CASE WHEN r THEN ['rationale'] ELSE [] END) AS intents FROM f)"""


@query("route_intents", ROUTE + " SELECT conv_id, turn, array_to_string(intents, ',') AS intents FROM i")
def route_intents(t):
    """Intents of every user turn."""
    asked = t.table("conversations").filter("role = 'user'")
    return asked.select("conv_id", "turn", F.array_join(text.route_intents(F.col("text")), ",").alias("intents"))


TOOLS_SQL = " ".join(f"|| (CASE WHEN list_contains(intents, '{k}') THEN {list(v)!r} ELSE [] END)" for k, v in text.INTENT_TOOLS.items())


@query("offered_tools", ROUTE + f" SELECT conv_id, turn, array_to_string(list_sort(list_distinct({list(text.BASE_TOOLS)!r} {TOOLS_SQL})), ',') AS tools FROM i")
def offered_tools(t):
    """Catalogue tools offered for every user turn."""
    asked = t.table("conversations").filter("role = 'user'")
    return asked.select("conv_id", "turn", F.array_join(text.tools_for(text.route_intents(F.col("text"))), ",").alias("tools"))


@query("routing_accuracy", ROUTE + """, e AS (SELECT intents, CASE WHEN conv_id % 3 = 0 THEN 'historical' ELSE 'structural' END AS expected FROM i)
 SELECT COUNT(*) AS questions, COUNT(CASE WHEN list_contains(intents, expected) THEN 1 END) AS hits, AVG(CASE WHEN list_contains(intents, expected) AND len(intents) = 1 THEN 1.0 ELSE 0.0 END) AS exact FROM e""")
def routing_accuracy(t):
    """How often the expected intent is routed, and routed alone."""
    asked = t.table("conversations").filter("role = 'user'").select(
        text.route_intents(F.col("text")).alias("intents"), F.when(F.col("conv_id") % 3 == 0, "historical").otherwise("structural").alias("expected"))
    return evaluation.routing_accuracy(asked)


PLAN = "CASE conv_id % 4 WHEN 0 THEN CONCAT('We need to call read_source for x. ', text) WHEN 1 THEN CONCAT('Let us look. Now write the final answer: ', text) WHEN 2 THEN CONCAT('I will check. ', text) ELSE text END"
TOOL_NAMES = tuple(sorted({n for names in text.INTENT_TOOLS.values() for n in names} | set(text.BASE_TOOLS)))


@query("planning_replies", f"""WITH a AS (SELECT conv_id, turn, trim(regexp_replace({PLAN}, '[À-ÖØ-öø-ÿĀ-ſ]', 'x', 'g'), chr(10) || ' ') AS x FROM conversations)
 SELECT conv_id, turn, x <> '' AND ((length(x) < 800 AND regexp_matches(x, '(?i)^\\s*(we need to|we should|we must|let''s|let us|i need to|i will|i''ll)\\b|\\b(we|i) (need to|should|must|will|''ll) (call|use|invoke|run|query|check)\\b'))
  OR (regexp_matches(x, '(?i)^\\s*(we need to|we should|we must|let''s|let us|i need to|i will|i''ll)\\b') AND regexp_matches(substr(x, 1, 400), '(?i)\\b(call|calls|tool|tools|invoke|{'|'.join(TOOL_NAMES)})\\b'))) AS planning FROM a""")
def planning_replies(t):
    """Replies that announce steps instead of answering."""
    return t.table("conversations").select("conv_id", "turn", text.looks_like_plan(F.expr(PLAN), TOOL_NAMES).alias("planning"))


@query("leaked_reasoning", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND length(t) >= 40 THEN t WHEN doc_id % 2 = 0 THEN 'We must see. Provide the answer. ' || text ELSE text END AS answer
 FROM (SELECT doc_id, text, trim(text, chr(10) || ' ') AS t FROM documents)""")
def leaked_reasoning(t):
    """The answer behind a reply that opens with its own planning."""
    reply = F.concat(F.when(F.col("doc_id") % 2 == 0, "We must see. Provide the answer. ").otherwise(""), "text")
    return t.table("documents").select("doc_id", text.strip_leaked_reasoning(reply, TOOL_NAMES).alias("answer"))


@query("clean_citations", """SELECT conv_id, turn, text || CASE conv_id % 3 WHEN 0 THEN ' (`src/a.py:L' || turn || '`)' ELSE '' END || ' end' AS answer FROM conversations""")
def clean_citations(t):
    """Citation marks naming a file become inline code, tool references go."""
    mark = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit(" 【† src/a.py:L"), F.col("turn").cast("string"), F.lit("】"))) \
        .when(F.col("conv_id") % 3 == 1, "【/commentary::get_x】").otherwise(" (`repo_browser.get_x†L1-L9`)")
    return t.table("conversations").select("conv_id", "turn", text.clean_citations(F.concat("text", mark, F.lit(" end"))).alias("answer"))


# --- bodies, secrets, messages ---------------------------------------------------------------------------------


@query("clean_bodies", """WITH b AS (SELECT doc_id, '<!-- hidden' || chr(10) || 'x -->' || text || ' ![img](http://x/y.png) ' || chr(10) || ' ' || chr(10) || chr(10) || 'end' AS body FROM documents),
 c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(body, '<!--(?s:.*?)-->', '', 'g'), '!\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'), '\\n\\s*\\n+', chr(10), 'g'), chr(10) || ' ') AS x FROM b)
 SELECT doc_id, x AS body FROM c""")
def clean_bodies(t):
    """Pull-request bodies without comments, images and blank lines."""
    raw = F.concat(F.lit("<!-- hidden\nx -->"), "text", F.lit(" ![img](http://x/y.png) \n \n\nend"))
    return t.table("documents").select("doc_id", text.clean_body(raw).alias("body"))


@query("mask_secrets", """SELECT c_custkey, 'let k = "Cust****"; p = "' || c_mktsegment || '/path/of/' || c_custkey || '"; t = ghp_**** ' || CASE WHEN c_custkey % 2 = 0 THEN '''plainwordswithoutdigits''' ELSE 'AKIA****' END AS masked FROM customer""")
def mask_secrets(t):
    """Credential-like values masked; paths and plain words kept."""
    c = t.table("customer")
    raw = F.concat(F.lit('let k = "'), "c_name", F.lit('"; p = "'), "c_mktsegment", F.lit("/path/of/"), F.col("c_custkey").cast("string"), F.lit('"; t = ghp_'),
                   F.format_string("%08d", "c_custkey"), F.lit(" "), F.when(F.col("c_custkey") % 2 == 0, "'plainwordswithoutdigits'").otherwise("AKIA0123ABCD"))
    return c.select("c_custkey", text.mask_secrets(raw).alias("masked"))


@query("retry_after", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN (event_id % 50 + 0.5)::DOUBLE WHEN 1 THEN (event_id % 900) / 1000.0::DOUBLE WHEN 2 THEN 60.0 * (event_id % 5) + 3 ELSE 15.0 END::DOUBLE AS seconds FROM events""")
def retry_after(t):
    """Seconds named by rate-limit messages."""
    e = F.col("event_id")
    message = (F.when(e % 4 == 0, F.format_string("limit; please try again in %d.5s.", e % 50)).when(e % 4 == 1, F.format_string("Try again in %dms", e % 900))
               .when(e % 4 == 2, F.format_string("try again in %dm3s", e % 5)).otherwise("overloaded"))
    return t.table("events").select("event_id", text.retry_after_seconds(message).alias("seconds"))


@query("strip_jsonc", """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'http://x//' || event_type || '/*y*/' AS u FROM events""")
def strip_jsonc(t):
    """Configuration JSON with comments and trailing commas, read back."""
    k = F.get_json_object("props", "$.k")
    raw = F.concat(F.lit('{ // "k": 0,\n "k": '), k, F.lit(', /* "u": "no", */ "u": "http://x//'), "event_type", F.lit('/*y*/",\n}'))
    parsed = F.from_json(text.strip_jsonc(raw), "k bigint, u string")
    return t.table("events").select("event_id", parsed["k"].alias("k"), parsed["u"].alias("u"))


@query("repair_json", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"a":[' || p || ']}' WHEN 1 THEN '{"a":[' || p || '],"b":"}]"}' WHEN 2 THEN p WHEN 3 THEN p END AS fixed
 FROM (SELECT event_id, replace(props, ' ', '') AS p FROM events)""")
def repair_json(t):
    """Replies with missing or mismatched closers repaired; hopeless ones stay null."""
    e = F.col("event_id")
    raw = (F.when(e % 5 == 0, F.concat(F.lit('{"a": ['), "props", F.lit("}"))).when(e % 5 == 1, F.concat(F.lit('{"a": ['), "props", F.lit('], "b": "}]"')))
           .when(e % 5 == 2, F.concat(F.lit("{ "), "props", F.lit("}"))).when(e % 5 == 3, F.concat(F.lit("{" + " " * 250), "props", F.lit("}")))
           .otherwise("{broken"))
    return t.table("events").select("event_id", text.repair_json_brackets(raw).alias("fixed"))


@query("message_refs", """SELECT o_orderkey, array_to_string(list_filter(r, lambda x, i: list_position(r, x) = i), ',') AS refs FROM (SELECT o_orderkey,
 CASE o_orderkey % 4 WHEN 0 THEN [o_orderkey % 60] WHEN 1 THEN [o_custkey % 70, o_orderkey % 60] WHEN 2 THEN [o_orderkey % 60, o_custkey % 70, 7, 8] ELSE [] END AS r FROM orders)""")
def message_refs(t):
    """Pull-request and issue numbers named by commit messages, most specific first."""
    o = t.table("orders")
    k, c, form = F.col("o_orderkey") % 60, F.col("o_custkey") % 70, F.col("o_orderkey") % 4
    subject = (F.when(form == 0, F.format_string("Fix things (#%d)", k)).when(form == 1, F.format_string("Merge pull request #%d from a/b", c))
               .when(form == 2, F.format_string("See #%d and #%d", k, c)).otherwise("No refs a#1 &#2 /#3"))
    body = F.when(form == 1, F.format_string("closes #%d", k)).when(form == 2, "also #7, #8").otherwise("")
    return o.select("o_orderkey", F.array_join(pull_requests.message_refs(subject, body), ",").alias("refs"))


@query("branch_of_url", """WITH b AS (SELECT DISTINCT lower(c_mktsegment) AS branch FROM customer UNION SELECT DISTINCT lower(c_mktsegment) || '/v' || (c_custkey % 9) FROM customer)
 SELECT rest, CASE WHEN branch LIKE '%/v_' THEN branch ELSE branch END AS branch, ltrim(substr(rest, length(branch) + 2), '/') AS folder FROM
 (SELECT DISTINCT u.rest, (SELECT max_by(branch, length(branch)) FROM b WHERE u.rest = branch OR starts_with(u.rest, branch || '/')) AS branch FROM
 (SELECT lower(c_mktsegment) || '/v' || (c_custkey % 20) || '/src/m' || (c_custkey % 100) AS rest FROM customer) u)""")
def branch_of_url(t):
    """Longest branch a folder URL starts with, and the folder after it."""
    c = t.table("customer")
    seg = F.lower("c_mktsegment")
    branches = c.select(seg.alias("branch")).union(c.select(F.concat(seg, F.format_string("/v%d", F.col("c_custkey") % 9)))).distinct()
    urls = c.select(F.concat(seg, F.format_string("/v%d/src/m%d", F.col("c_custkey") % 20, F.col("c_custkey") % 100)).alias("rest")).distinct()
    return pull_requests.split_branch(urls, branches)


@query("language_share", """SELECT c_nationkey, COUNT(*) FILTER (c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE')) / COUNT(*)::DOUBLE AS share FROM customer GROUP BY 1""")
def language_share(t):
    """Share of supported languages per repository (segments stand for languages)."""
    return t.table("customer").groupBy("c_nationkey").agg(
        evaluation.ratio(F.count_if(F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "FURNITURE")), F.count(F.lit(1)), 1.0).alias("share"))


# --- files ----------------------------------------------------------------------------------------------------

DOC_PATH = """CASE doc_id % 9 WHEN 0 THEN CONCAT('/abs/d', CAST(doc_id AS STRING), '.py') WHEN 1 THEN CONCAT('src/', source, '/d', CAST(doc_id AS STRING), '.py')
 WHEN 2 THEN CONCAT('node_modules/x/d', CAST(doc_id AS STRING), '.js') WHEN 3 THEN CONCAT('src/.hidden/d', CAST(doc_id AS STRING), '.ts') WHEN 4 THEN CONCAT('src/../d', CAST(doc_id AS STRING), '.ts')
 WHEN 5 THEN CONCAT('web/', source, '/d', CAST(doc_id AS STRING), '.d.ts') WHEN 6 THEN CONCAT('web/d', CAST(doc_id AS STRING), '/tsconfig.base.json') WHEN 7 THEN CONCAT('docs/d', CAST(doc_id AS STRING), '.md') ELSE CONCAT('C:/d', CAST(doc_id AS STRING), '.py') END"""


@query("tree_scan", f"""SELECT {DOC_PATH} AS path, doc_id % 9 = 6 AS is_config, strlen(text)::BIGINT AS bytes FROM documents WHERE doc_id % 9 IN (1, 5, 6) AND strlen(text) <= 1000000 AND doc_id % 10 <> 3""")
def tree_scan(t):
    """Files of a commit tree worth reading: safe path, source or configuration, no link, at most a megabyte."""
    p = F.col("path")
    files = t.table("documents").select(F.expr(DOC_PATH).alias("path"), F.octet_length("text").cast("bigint").alias("bytes"),
                                        F.when(F.col("doc_id") % 10 == 3, "120000").otherwise("100644").alias("mode"))
    kept = files.filter((paths.has_source_extension(p) | paths.is_config_file(p)) & paths.is_safe_relative(p) & ~F.col("mode").isin(*paths.NOT_A_BLOB_MODES)
                        & (F.col("bytes") <= paths.MAX_BLOB_BYTES))
    return kept.select("path", paths.is_config_file(p).alias("is_config"), "bytes")


@query("top_languages", """WITH f AS (SELECT CASE o_orderkey % 7 WHEN 0 THEN '.cpp' WHEN 1 THEN '.h' WHEN 2 THEN '.go' WHEN 3 THEN '.java' WHEN 4 THEN '.cpp' WHEN 5 THEN '.txt' ELSE '.rs' END AS ext FROM orders)
 SELECT ext, CASE ext WHEN '.cpp' THEN 'C++' WHEN '.h' THEN 'C/C++' WHEN '.go' THEN 'Go' WHEN '.java' THEN 'Java' ELSE 'Rust' END AS language, COUNT(*) AS files FROM f WHERE ext <> '.txt' GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 3""")
def top_languages(t):
    """The three most frequent known extensions."""
    from codestrata.session import literal_table

    files = t.table("orders").select(paths.extension(F.concat(F.lit("src/x.y"), F.get(F.array(*[F.lit(e) for e in (".CPP", ".h", ".go", ".java", ".cpp", ".txt", ".rs")]),
                                                                                      (F.col("o_orderkey") % 7).cast("int")))).alias("ext"))
    languages = literal_table(t.spark, sorted(paths.LANGUAGE_BY_EXTENSION.items()), "ext string, language string")
    return graph.top_languages(files, languages)


def _sources(t):
    return t.table("documents").select(F.format_string("src/%s/d%05d.txt", "source", "doc_id").alias("path"), F.col("text").alias("content"))


SRC = "WITH s AS (SELECT printf('src/%s/d%05d.txt', source, doc_id) AS path, text AS content FROM documents), l AS (SELECT path, generate_subscripts(a, 1) AS line_no, UNNEST(a) AS line FROM (SELECT path, string_split(CASE WHEN ends_with(content, chr(10)) THEN content[:-2] ELSE content END, chr(10)) AS a FROM s WHERE content <> ''))"


@query("search_summary", SRC + " SELECT COUNT(*) AS total_matches, COUNT(DISTINCT path) AS files_with_matches FROM l WHERE contains(lower(line), 'license')")
def search_summary(t):
    """How many lines and files contain a text."""
    return source_text.search_summary(source_text.search_lines(_sources(t), "License"))


@query("search_hits", SRC + " SELECT path || ':L' || line_no AS location, trim(line) AS line FROM l WHERE contains(lower(line), 'license') ORDER BY path, line_no LIMIT 20")
def search_hits(t):
    """The first twenty matching lines in path and line order."""
    return source_text.first_hits(source_text.search_lines(_sources(t), "License"))


@query("line_counts", SRC + " SELECT path, COUNT(*) AS lines FROM l GROUP BY 1")
def line_counts(t):
    """Lines per file."""
    return source_text.numbered_lines(_sources(t), ["path"]).groupBy("path").agg(F.count(F.lit(1)).alias("lines"))


@query("read_source", SRC + """, p AS (SELECT path FROM l GROUP BY 1 ORDER BY COUNT(*) DESC, path LIMIT 1), w AS (SELECT l.*, (SELECT COUNT(*) FROM l x WHERE x.path = p.path) AS total FROM l JOIN p USING (path)),
 r AS (SELECT path, line_no, lpad(line_no::VARCHAR, length(CAST(LEAST(2 + 119, total) AS VARCHAR))::INTEGER, ' ') || ' | ' || line AS text FROM w WHERE line_no BETWEEN 2 AND LEAST(121, total)),
 u AS (SELECT *, COALESCE(SUM(length(text) + 1) OVER (ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(text) <= 3000 AS fits FROM r)
 SELECT path, line_no::BIGINT AS line_no, text FROM u WHERE line_no < (SELECT COALESCE(MIN(line_no), 1000000) FROM u WHERE NOT fits)""")
def read_source(t):
    """A numbered window of the longest file, within the line and character limits."""
    files = _sources(t)
    counts = source_text.numbered_lines(files, ["path"]).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    longest = counts.orderBy(F.desc("n"), "path").first()["path"]
    return source_text.read_lines(files, longest, 2).withColumn("line_no", F.col("line_no").cast("bigint"))


@query("cached_sources", """WITH s AS (SELECT printf('src/%s/d%05d.txt', source, doc_id) AS path, length(text) AS chars FROM documents)
 SELECT path, chars::BIGINT AS chars, COALESCE(SUM(chars) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM s""")
def cached_sources(t):
    """Size of every file and of all files before it in path order."""
    return source_text.sizes(_sources(t)).select("path", "chars", "before")


@query("fit_context", """WITH RECURSIVE a AS (SELECT conv_id, list(length(text) ORDER BY turn) AS s FROM conversations GROUP BY 1),
 d AS (SELECT conv_id, s, list_sum(s) AS left_, 0 AS n FROM a UNION ALL SELECT conv_id, s, left_ - s[n + 1], n + 1 FROM d WHERE left_ > 600 AND n < len(s) - 1)
 SELECT conv_id, MAX(n)::BIGINT AS dropped FROM d GROUP BY 1""")
def fit_context(t):
    """Oldest turns dropped so that a conversation fits a budget of 600 characters."""
    sized = t.table("conversations").select("conv_id", "turn", F.length("text").cast("bigint").alias("chars"))
    return source_text.fit_context(sized, "conv_id", "turn", "chars", 600)


# --- documents and diagrams ------------------------------------------------------------------------------------


@query("documentation_batches", with_(**MOD, layers=LAYERED) + f""", g AS (SELECT path, {GROUP} AS group_key FROM layers),
 b AS (SELECT *, CAST(floor((ROW_NUMBER() OVER (PARTITION BY group_key ORDER BY path) - 1) / 10) AS BIGINT) AS batch FROM g),
 k AS (SELECT DISTINCT group_key, batch FROM b ORDER BY CASE WHEN starts_with(group_key, 'layer:') THEN 0 WHEN starts_with(group_key, 'folder:') THEN 1 ELSE 2 END, group_key, batch LIMIT 40)
 SELECT b.path, b.group_key, b.batch, k.batch IS NOT NULL AS described FROM b LEFT JOIN k ON k.group_key = b.group_key AND k.batch = b.batch""")
def documentation_batches(t):
    """Modules in batches of ten per group; the first forty batches are described, the rest only listed."""
    return documents.described(documents.batches(t.modules.select("path", "layer_type")))


ID = "regexp_replace(CASE WHEN {p} LIKE '%.py' THEN {p}[:-4] ELSE {p} END, '[^0-9a-zA-Z_]', '_', 'g')"


@query("module_diagram", with_(**MOD, layers=LAYERED, imports=IMPORTS_SQL) + f""" SELECT 1 AS part, {GROUP} AS section, {ID.format(p='path')} || '["' || regexp_extract(path, '[^/]*$') || '"]' AS line FROM layers
 UNION ALL SELECT 2, 'edges', {ID.format(p='src')} || ' --> ' || {ID.format(p='dst')} FROM imports""")
def module_diagram(t):
    """Node and edge lines of the module diagram."""
    return documents.module_diagram(t.modules, t.imports).select("part", "section", "line")


FOLDERS = """, f AS (SELECT regexp_replace(path, '/[^/]*$', '') AS folder, layer_type FROM layers),
 n AS (SELECT folder, COUNT(*) AS files FROM f GROUP BY 1),
 e AS (SELECT regexp_replace(src, '/[^/]*$', '') AS a, regexp_replace(dst, '/[^/]*$', '') AS b, COUNT(*) AS c FROM imports GROUP BY 1, 2)"""


@query("folder_diagram", with_(**MOD, layers=LAYERED, imports=IMPORTS_SQL) + FOLDERS + """ SELECT 1 AS part, 'folder_' || regexp_replace(folder, '[^0-9a-zA-Z_]', '_', 'g') || '["' || folder || ' (' || files || ' file' || CASE WHEN files <> 1 THEN 's' ELSE '' END || ')"]' AS line FROM n
 UNION ALL SELECT 2, 'folder_' || regexp_replace(a, '[^0-9a-zA-Z_]', '_', 'g') || ' -->|' || c || '| folder_' || regexp_replace(b, '[^0-9a-zA-Z_]', '_', 'g') FROM e WHERE a <> b AND a IN (SELECT folder FROM n) AND b IN (SELECT folder FROM n)""")
def folder_diagram(t):
    """Folder nodes with file counts and import counts between folders."""
    return documents.folder_lines(*documents.folder_diagram(t.modules, t.imports))


@query("folder_layers", with_(**MOD, layers=LAYERED) + """ SELECT folder, layer_type AS layer FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY folder ORDER BY n DESC, layer_type) AS r FROM
 (SELECT regexp_replace(path, '/[^/]*$', '') AS folder, layer_type, COUNT(*) AS n FROM layers WHERE layer_type IS NOT NULL GROUP BY 1, 2)) WHERE r = 1""")
def folder_layers(t):
    """Majority layer per folder."""
    folders, _edges = documents.folder_diagram(t.modules, t.imports)
    return folders.filter("layer IS NOT NULL").select("folder", "layer")


@query("relationship_lines", with_(imports=IMPORTS_SQL, calls=CALLS_SQL) + f""" SELECT 'imports' AS section, '- ' || src || ' -> ' || dst AS line FROM imports UNION ALL SELECT 'calls', '- ' || {CALLER} || ' -> ' || {CALLEE} FROM calls""")
def relationship_lines(t):
    """Dependency lines of the documentation."""
    return documents.relationship_lines(t.imports, t.calls)


@query("known_issues", CTE + """ SELECT '- [' || rule_name || '] severity=' || severity || ': ' || CASE WHEN edge = 'imports' THEN caller_module ELSE caller_module || '::' || COALESCE(caller_class || '.', '') || caller_name END
 || ' -> ' || CASE WHEN edge = 'imports' THEN callee_module ELSE callee_module || '::' || COALESCE(callee_class || '.', '') || callee_name END AS line FROM judged WHERE violates""")
def known_issues(t):
    """Violation lines of the documentation."""
    return documents.known_issues(rules.format_violations(rules.violations(judged(t))))


@query("module_listing", with_(**MOD, **FUN) + """ SELECT m.path, c.classes, f.functions FROM modules m LEFT JOIN (SELECT module_path, string_agg(name, ', ' ORDER BY name) AS classes FROM classes GROUP BY 1) c ON c.module_path = m.path
 LEFT JOIN (SELECT module_path, string_agg(n, ', ' ORDER BY n) AS functions FROM (SELECT module_path, COALESCE(class_name || '.', '') || name AS n FROM functions) GROUP BY 1) f ON f.module_path = m.path""")
def module_listing(t):
    """Classes and functions of each module, for modules without prose."""
    return documents.module_listing(t.modules, t.classes, t.functions)


@query("drift_summaries", CTE + """ SELECT r.rule_name, COUNT(*) || ' place(s) where a ' || r.rule_from || ' module ' || CASE WHEN r.edge = 'imports' THEN 'imports' ELSE 'calls into' END || ' the ' || r.rule_to || ' layer, which rule ''' || r.rule_name || ''' forbids.' AS summary
 FROM judged j JOIN (SELECT * FROM rules) r ON r.rule_name = j.rule_name WHERE j.violates GROUP BY r.rule_name, r.rule_from, r.rule_to, r.edge""")
def drift_summaries(t):
    """Facts-only explanation per violated rule."""
    groups = rules.violations(judged(t)).groupBy("rule_name", "edge").agg(F.count(F.lit(1)).alias("occurrences"))
    return documents.fallback_explanation(groups, t.rules)


# --- evaluation --------------------------------------------------------------------------------------------------


@query("drift_scores", with_(**SNAP) + """, v AS (SELECT rule_name, src, dst, idx FROM judged WHERE violates), p AS (SELECT rule_name, src, dst, idx - 1 AS idx FROM v),
 c AS (SELECT rule_name, idx, COUNT(CASE WHEN e AND p THEN 1 END) AS tp, COUNT(CASE WHEN p AND NOT e THEN 1 END) AS fp, COUNT(CASE WHEN e AND NOT p THEN 1 END) AS fn FROM
  (SELECT COALESCE(v.rule_name, p.rule_name) AS rule_name, COALESCE(v.idx, p.idx) AS idx, v.src IS NOT NULL AS e, p.src IS NOT NULL AS p FROM v FULL OUTER JOIN p
   ON v.rule_name = p.rule_name AND v.src = p.src AND v.dst = p.dst AND v.idx = p.idx) GROUP BY 1, 2),
 m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 1.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 1.0 END AS recall FROM c)
 SELECT rule_name, idx, tp, fp, fn, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall, ROUND(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, 6) AS f1 FROM m""")
def drift_scores(t):
    """Precision, recall and F1 of every snapshot's violations against the next one's, per rule."""
    found = rules.violations(snap_judged(t)).select("rule_name", "caller_module", "callee_module", "idx")
    following = found.withColumn("idx", F.col("idx") - 1)
    scored = evaluation.precision_recall(found, following, ["rule_name", "caller_module", "callee_module", "idx"], ["rule_name", "idx"])
    return scored.select("rule_name", "idx", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("rule_rates", CTE + """ SELECT r.rule_name, COUNT(j.rule_name) AS checks, ROUND(COUNT(CASE WHEN j.violates THEN 1 END)::DOUBLE / NULLIF(COUNT(j.rule_name), 0), 6) AS rate
 FROM rules r LEFT JOIN judged j ON j.rule_name = r.rule_name WHERE NOT r.allowed GROUP BY 1""")
def rule_rates(t):
    """Violation rate per rule."""
    return evaluation.rule_rates(rules.rule_checks(judged(t), t.rules)).select("rule_name", "checks", F.round("rate", 6).alias("rate"))


@query("lowest_health", SNAP_HEALTH + " SELECT ROUND(health, 6) AS health, idx FROM trend WHERE health IS NOT NULL ORDER BY ROUND(health, 6), idx LIMIT 1")
def lowest_health(t):
    """Lowest scored snapshot."""
    return evaluation.lowest_health(snapshot_health(t))


@query("usage_by_purpose", """SELECT event_type AS purpose, COUNT(*) AS requests, CAST(SUM(event_id % 3) AS BIGINT) AS calls, CAST(SUM(CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS failures,
 CAST(SUM(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens, ROUND(SUM(value), 1) AS seconds, COUNT(CASE WHEN event_id % 3 = 0 AND event_id % 7 <> 0 THEN 1 END) AS from_cache FROM events GROUP BY 1""")
def usage_by_purpose(t):
    """Requests, calls, failures, tokens and cached answers per feature."""
    e = F.col("event_id")
    calls = t.table("events").select(F.col("event_type").alias("purpose"), (e % 3).alias("calls"), F.when(e % 7 == 0, 1).otherwise(0).alias("failures"),
                                     F.get_json_object("props", "$.k").cast("bigint").alias("tokens"), F.col("value").alias("seconds"))
    return evaluation.usage_by_purpose(calls)


@query("evidence_sensitivity", with_(**EVIDENCE_SQL) + """, w(i, a, b, c) AS (VALUES (0, 0.3, 0.45, 0.25), (1, 1.0, 0.0, 0.0), (2, 0.2, 0.4, 0.4)),
 r AS (SELECT decision, hash, i, a::DOUBLE * ROUND(t, 6) + b::DOUBLE * ROUND(g, 6) + c::DOUBLE * ROUND(x, 6) AS r FROM scored, w),
 k AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY decision, i ORDER BY ROUND(r, 9) DESC, hash) AS n FROM r WHERE ROUND(r, 9) >= 0.35) WHERE n <= 11),
 s AS (SELECT decision, i, list(hash) AS s FROM k GROUP BY 1, 2)
 SELECT x.decision, x.i::BIGINT AS weighting, ROUND(len(list_intersect(x.s, b.s))::DOUBLE / len(list_distinct(x.s || b.s)), 6) AS jaccard FROM s x JOIN s b ON b.decision = x.decision AND b.i = 0 WHERE x.i > 0""")
def evidence_sensitivity(t):
    """Overlap of each decision's evidence under other weightings."""
    scored = shown(_evidence(t)[0])
    rounded = scored.select("decision", "hash", *[F.round(c, 6).alias(c) for c in ("time", "graph", "text")])
    found = evaluation.sensitivity(rounded, [(0.3, 0.45, 0.25), (1.0, 0.0, 0.0), (0.2, 0.4, 0.4)], 0.35, 11)
    return found.select("decision", F.col("weighting").cast("bigint").alias("weighting"), F.round("jaccard", 6).alias("jaccard"))


@query("ground_truth", with_(imports=IMPORTS_SQL, commits=COMMITS_SQL, files=FILES_SQL) + """ SELECT * FROM (SELECT 'most imported' AS question, dst AS answer, COUNT(*) AS n FROM imports GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 1)
 UNION ALL SELECT * FROM (SELECT 'imports most', src, COUNT(*) FROM imports GROUP BY 2 HAVING COUNT(*) >= 2 ORDER BY 3 DESC, 2 LIMIT 1)
 UNION ALL SELECT * FROM (SELECT 'most commits', author, COUNT(*) FROM commits GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 1)
 UNION ALL SELECT * FROM (SELECT 'busiest file', path, COUNT(DISTINCT hash) FROM files GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 1)""")
def ground_truth(t):
    """Reference answers computed from the graph: top importer targets, fan-out, author and file."""
    top = lambda df, label, key, n: df.orderBy(F.desc("n"), key).limit(1).select(F.lit(label).alias("question"), F.col(key).alias("answer"), "n")
    count = F.count(F.lit(1)).alias("n")
    touched = t.commit_files.select("path", "hash").distinct()
    return (top(t.imports.groupBy("to").agg(count), "most imported", "to", 1)
            .union(top(t.imports.groupBy("from").agg(count).filter("n >= 2"), "imports most", "from", 1))
            .union(top(t.commits.groupBy("author").agg(count), "most commits", "author", 1))
            .union(top(touched.groupBy("path").agg(count), "busiest file", "path", 1)))


@query("answer_scores", """SELECT conv_id, turn, len(list_filter(regexp_extract_all(text || ' value ' || (conv_id % 10) || '.05', '-?\\d+(?:\\.\\d+)?'),
 lambda v: abs(TRY_CAST(v AS DOUBLE) - conv_id % 7) < 0.051)) > 0 AS correct FROM conversations""")
def answer_scores(t):
    """Whether an answer states the expected number, within the tolerance."""
    c = t.table("conversations")
    answer = F.concat("text", F.lit(" value "), F.format_string("%d.05", F.col("conv_id") % 10))
    return c.select("conv_id", "turn", evaluation.number_answered(answer, (F.col("conv_id") % 7).cast("double")).alias("correct"))


@query("parse_records", """SELECT 'docs/adr/' || CASE WHEN doc_id % 3 = 0 THEN '20240105-x.md' WHEN doc_id % 3 = 1 THEN '0001-x.md' ELSE 'notes.md' END AS path, 'Use ' || source AS title,
 CASE doc_id % 3 WHEN 0 THEN '2024-01-05' WHEN 1 THEN '2023-02-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') ELSE NULL END AS date, doc_id FROM documents""")
def parse_records(t):
    """Titles and dates of decision-record documents."""
    d = t.table("documents")
    kind = F.col("doc_id") % 3
    name = F.when(kind == 0, "20240105-x.md").when(kind == 1, "0001-x.md").otherwise("notes.md")
    body = F.concat(F.lit("intro\n# ADR-12: Use "), "source", F.lit("  \n\n* **Date**: "), F.when(kind == 1, F.format_string("2023-02-%02d", F.col("doc_id") % 28 + 1)).otherwise("soon"), F.lit("\n"), "text")
    files = d.select("doc_id", F.concat(F.lit("docs/adr/"), name).alias("path"), body.alias("content"))
    parsed = evaluation.parse_records(files.withColumn("path", F.concat_ws("|", F.col("doc_id").cast("string"), "path")))
    return parsed.select(F.substring_index("path", "|", -1).alias("path"), "title", "date", F.substring_index("path", "|", 1).cast("bigint").alias("doc_id"))


@query("match_records", f"""WITH r AS (SELECT conv_id * 100 + turn AS record, DATE '2024-01-01' + CAST(conv_id % 300 AS INTEGER) AS d, text FROM conversations WHERE role = 'assistant'),
 k AS (SELECT conv_id * 100 + turn AS decision, DATE '2024-01-01' + CAST(conv_id * 7 % 300 AS INTEGER) AS d, text FROM conversations WHERE role = 'user'),
 rw AS (SELECT DISTINCT record, d, UNNEST(tok) AS w FROM (SELECT record, d, {tokens_sql('text')} AS tok FROM r)), kw AS (SELECT DISTINCT decision, d, UNNEST(tok) AS w FROM (SELECT decision, d, {tokens_sql('text')} AS tok FROM k)),
 s AS (SELECT record, decision, COUNT(*) AS shared, MIN(abs(date_diff('day', rw.d, kw.d))) AS gap FROM rw JOIN kw USING (w) WHERE abs(date_diff('day', rw.d, kw.d)) <= 30 GROUP BY 1, 2),
 b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY record ORDER BY shared DESC, gap, decision) AS n FROM s)
 SELECT r.record, EXISTS (SELECT 1 FROM k WHERE abs(date_diff('day', r.d, k.d)) <= 30) AS temporal, COALESCE(b.decision, -1) AS decision, COALESCE(b.shared, 0) AS shared FROM r LEFT JOIN b ON b.record = r.record AND b.n = 1""")
def match_records(t):
    """Best detected decision for each written record: within thirty days, most shared words, then nearest."""
    c = t.table("conversations")
    key = F.col("conv_id") * 100 + F.col("turn")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int")).cast("string")
    records = c.filter("role = 'assistant'").select(key.alias("record"), day(F.col("conv_id") % 300).alias("date"), F.col("text").alias("title"))
    found = c.filter("role = 'user'").select(key.alias("decision"), day(F.col("conv_id") * 7 % 300).alias("date"), F.col("text").alias("topic"))
    return evaluation.match_records(records, found).withColumn("decision", F.coalesce("decision", F.lit(-1)))


# --- cache, decisions by question, streaming ----------------------------------------------------------------------


@query("cache_misses", """SELECT sha1(o_orderkey || '|' || o_orderpriority || '|v1') AS digest, o_orderkey FROM orders WHERE o_orderkey % 4 <> 0 OR o_orderstatus = 'P'""")
def cache_misses(t):
    """Artifacts whose content digest is not stored yet; degraded results are never stored."""
    o = t.table("orders").withColumn("digest", F.sha1(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderpriority", F.lit("v1"))))
    stored = o.filter("o_orderkey % 4 = 0").withColumn("degraded", F.col("o_orderstatus") == "P").filter("NOT degraded").select("digest")
    return o.join(stored, "digest", "left_anti").select("digest", "o_orderkey")


@query("micro_batch_dedupe", """SELECT DISTINCT substr(sha1(user_id || '|' || event_type), 1, 16) AS fingerprint FROM events""")
def micro_batch_dedupe(t):
    """Findings of a push stream, each fingerprint raised once."""
    pushes = micro_review.stream_table(t.spark, t.folder, "events")
    once = micro_review.deduplicated(pushes.select("user_id", "event_type"), text.fingerprint(F.col("user_id"), F.col("event_type")))
    return micro_review.run_available(once.select("fingerprint"), "micro-review")


@query("new_micro_batch_findings", """SELECT DISTINCT substr(sha1(user_id || '|' || event_type), 1, 16) AS fingerprint FROM events
 WHERE substr(sha1(user_id || '|' || event_type), 1, 16) NOT IN (SELECT substr(sha1(user_id || '|' || event_type), 1, 16) FROM events WHERE event_type = 'error' AND user_id % 2 = 0)""")
def new_micro_batch_findings(t):
    """Findings of a push stream that no issue raised before names, with state bounded by event time."""
    mark = text.fingerprint(F.col("user_id"), F.col("event_type"))
    raised = t.table("events").where("event_type = 'error' AND user_id % 2 = 0").select(mark.alias("fingerprint"))
    pushes = micro_review.stream_table(t.spark, t.folder, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    return micro_review.run_available(micro_review.deduplicated(pushes, mark, "ts", raised=raised).select("fingerprint"), "micro-review")
