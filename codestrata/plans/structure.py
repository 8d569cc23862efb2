"""Graph writes and reads: nodes, edges, counts, views, the structural part of the query catalogue."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions import paths
from codestrata.operators import graph, scope
from codestrata.plans.registry import query
from codestrata.plans.tables import (CALLS_SQL, CLASSES_SQL, COMMITS_SQL, FILES_SQL, FUNCTION_ROWS_SQL, FUNCTIONS_SQL, IMPORTS_SQL,
                                     MODULES_SQL, MONTHS_SQL, layer_sql, path_of, with_)
from codestrata.session import stored

FUN = dict(function_rows=FUNCTION_ROWS_SQL, functions=FUNCTIONS_SQL, classes=CLASSES_SQL)
MOD = dict(modules=MODULES_SQL)
EDG = dict(imports=IMPORTS_SQL, calls=CALLS_SQL)
LAYERED = f"SELECT path, {layer_sql('path')} AS layer_type FROM modules"
QUAL = "{m} || '::' || COALESCE({c} || '.', '') || {n}"
CALLER = QUAL.format(m="caller_module", c="caller_class", n="caller_name")
CALLEE = QUAL.format(m="callee_module", c="callee_class", n="callee_name")


def module_path(t, key: int) -> str:
    return t.spark.range(1).select(F.expr(path_of(str(key)))).first()[0]


@query("function_nodes", with_(**FUN) + " SELECT * FROM functions")
def function_nodes(t):
    """Function nodes: repeated definitions collapse, the last signature wins."""
    return t.functions


@query("class_nodes", with_(**FUN) + " SELECT * FROM classes")
def class_nodes(t):
    """Class nodes by (module, name)."""
    return t.classes


@query("module_nodes", """SELECT path, language FROM (SELECT path, language, ROW_NUMBER() OVER (PARTITION BY path ORDER BY o DESC) AS n FROM
 (SELECT {p} AS path, CASE WHEN l_linestatus = 'O' THEN 'python' ELSE 'typescript' END AS language, l_orderkey * 100 + l_suppkey % 100 AS o FROM lineitem)) WHERE n = 1""".replace(
    "{p}", path_of("l_partkey")) .replace("ORDER BY o DESC", "ORDER BY o DESC, language DESC"))
def module_nodes(t):
    """Module nodes: the last write of a path wins, whatever came before."""
    rows = t.table("lineitem").select(
        F.expr(path_of("l_partkey")).alias("path"),
        F.when(F.col("l_linestatus") == "O", "python").otherwise("typescript").alias("language"),
        (F.col("l_orderkey") * 100 + F.col("l_suppkey") % 100).alias("o"))
    return graph.upsert(rows, ["path"], ["o", "language"], ["language"])


@query("contains_edges", with_(**MOD, **FUN) + """ SELECT DISTINCT 'Module' AS src_kind, c.module_path AS src, 'Class' AS dst_kind, c.module_path || '::' || c.name AS dst
 FROM classes c WHERE c.module_path IN (SELECT path FROM modules)
 UNION SELECT 'Module', module_path, 'Function', module_path || '::' || name FROM functions WHERE class_name IS NULL AND module_path IN (SELECT path FROM modules)
 UNION SELECT 'Class', f.module_path || '::' || f.class_name, 'Function', f.module_path || '::' || f.class_name || '.' || f.name FROM functions f
 JOIN classes c ON c.module_path = f.module_path AND c.name = f.class_name""")
def contains_edges(t):
    """module -> class, module -> function, class -> method."""
    return graph.contains_edges(t.modules, t.classes, t.functions)


@query("import_relations", with_(**MOD, **EDG) + """ SELECT DISTINCT src AS "from", dst AS "to" FROM imports
 WHERE src IN (SELECT path FROM modules) AND dst IN (SELECT path FROM modules)""")
def import_relations(t):
    """IMPORTS edges whose two ends exist."""
    return graph.import_relations(t.imports, t.modules)


@query("call_relations", with_(**FUN, **EDG) + """ SELECT c.* FROM calls c
 WHERE EXISTS (SELECT 1 FROM functions f WHERE f.module_path = c.caller_module AND f.name = c.caller_name AND f.class_name IS NOT DISTINCT FROM c.caller_class)
 AND EXISTS (SELECT 1 FROM functions f WHERE f.module_path = c.callee_module AND f.name = c.callee_name AND f.class_name IS NOT DISTINCT FROM c.callee_class)""")
def call_relations(t):
    """CALLS edges matched null-safely on the class."""
    return graph.call_relations(t.calls, t.functions)


# --- the whole graph in one shape: (label, id, name) nodes and (type, src_kind, src, dst_kind, dst) edges -----


def nodes(t) -> DataFrame:
    lit = F.lit
    parts = [
        t.modules.select(lit("Module").alias("label"), F.col("path").alias("id"), F.substring_index("path", "/", -1).alias("name")),
        t.classes.select(lit("Class"), F.concat("module_path", lit("::"), "name"), F.col("name")),
        t.functions.select(lit("Function"), graph.qualified(F.col("module_path"), F.col("class_name"), F.col("name")), F.col("name")),
        t.commits.select(lit("Commit"), F.col("hash"), F.col("short")),
        t.commits.select(lit("Developer"), F.col("author_id"), F.col("author_id")).distinct(),
        t.months.select(lit("Snapshot"), F.col("idx").cast("string"), F.col("idx").cast("string")),
    ]
    return reduce(lambda a, b: a.union(b), parts)


class Relations(NamedTuple):
    """What the code of a graph is made of, or a part of it."""

    modules: DataFrame
    classes: DataFrame
    functions: DataFrame
    imports: DataFrame
    calls: DataFrame


def code_edges(t) -> DataFrame:
    """IMPORTS, CALLS and CONTAINS of the tables or of ``Relations``."""
    lit = F.lit
    imports = t.imports.select(lit("IMPORTS").alias("type"), lit("Module").alias("src_kind"), F.col("from").alias("src"),
                               lit("Module").alias("dst_kind"), F.col("to").alias("dst"))
    calls = graph.call_relations(t.calls, t.functions).select(
        lit("CALLS"), lit("Function"), graph.qualified(F.col("caller_module"), F.col("caller_class"), F.col("caller_name")),
        lit("Function"), graph.qualified(F.col("callee_module"), F.col("callee_class"), F.col("callee_name")))
    contains = graph.contains_edges(t.modules, t.classes, t.functions).select(
        lit("CONTAINS"), "src_kind", "src", "dst_kind", "dst")
    return imports.union(calls).union(contains)


def edges(t) -> DataFrame:
    lit = F.lit
    authored = t.commits.select(lit("AUTHORED"), lit("Developer"), F.col("author_id"), lit("Commit"), F.col("hash"))
    modified = t.commit_files.select(lit("MODIFIED"), lit("Commit"), F.col("hash"), lit("Module"), F.col("path")).distinct()
    chain = graph.chain_edges(t.months).select(
        lit("NEXT"), lit("Snapshot"), F.col("idx").cast("string"), lit("Snapshot"), F.col("next_idx").cast("string"))
    return reduce(lambda a, b: a.union(b), [code_edges(t), authored, modified, chain])


NODES = f"""SELECT 'Module' AS label, path AS id, regexp_extract(path, '[^/]*$') AS name FROM modules
 UNION ALL SELECT 'Class', module_path || '::' || name, name FROM classes
 UNION ALL SELECT 'Function', {QUAL.format(m='module_path', c='class_name', n='name')}, name FROM functions
 UNION ALL SELECT 'Commit', hash, short FROM commits
 UNION ALL SELECT DISTINCT 'Developer', author_id, author_id FROM commits
 UNION ALL SELECT 'Snapshot', CAST(idx AS VARCHAR), CAST(idx AS VARCHAR) FROM months"""
EDGES = f"""SELECT 'IMPORTS' AS type, 'Module' AS src_kind, src, 'Module' AS dst_kind, dst FROM imports
 UNION ALL SELECT 'CALLS', 'Function', {CALLER}, 'Function', {CALLEE} FROM calls c
 WHERE EXISTS (SELECT 1 FROM functions f WHERE f.module_path = c.caller_module AND f.name = c.caller_name AND f.class_name IS NOT DISTINCT FROM c.caller_class)
 AND EXISTS (SELECT 1 FROM functions f WHERE f.module_path = c.callee_module AND f.name = c.callee_name AND f.class_name IS NOT DISTINCT FROM c.callee_class)
 UNION ALL (SELECT 'CONTAINS', 'Module', c.module_path, 'Class', c.module_path || '::' || c.name FROM classes c WHERE c.module_path IN (SELECT path FROM modules)
  UNION SELECT 'CONTAINS', 'Module', module_path, 'Function', module_path || '::' || name FROM functions WHERE class_name IS NULL AND module_path IN (SELECT path FROM modules)
  UNION SELECT 'CONTAINS', 'Class', f.module_path || '::' || f.class_name, 'Function', f.module_path || '::' || f.class_name || '.' || f.name FROM functions f
  JOIN classes c ON c.module_path = f.module_path AND c.name = f.class_name)
 UNION ALL SELECT 'AUTHORED', 'Developer', author_id, 'Commit', hash FROM commits
 UNION ALL SELECT DISTINCT 'MODIFIED', 'Commit', hash, 'Module', path FROM files
 UNION ALL SELECT 'NEXT', 'Snapshot', CAST(idx AS VARCHAR), 'Snapshot', CAST(idx + 1 AS VARCHAR) FROM months WHERE idx < (SELECT MAX(idx) FROM months)"""
GRAPH = with_(**MOD, **FUN, **EDG, commits=COMMITS_SQL, files=FILES_SQL, months=MONTHS_SQL, nodes=NODES, edges=EDGES)


@query("label_counts", GRAPH + " SELECT label, COUNT(*) AS count FROM nodes GROUP BY 1")
def label_counts(t):
    """Nodes per label."""
    return graph.label_counts(nodes(t))


@query("type_counts", GRAPH + " SELECT type, COUNT(*) AS count FROM edges GROUP BY 1")
def type_counts(t):
    """Relationships per type."""
    return graph.type_counts(edges(t))


@query("schema_triples", GRAPH + " SELECT src_kind AS source, type, dst_kind AS target, COUNT(*) AS count FROM edges GROUP BY ALL")
def schema_triples(t):
    """Counts per (source label, type, target label)."""
    return graph.schema_triples(edges(t))


CODE_CAPS = "CASE label WHEN 'Module' THEN 400 WHEN 'Class' THEN 400 WHEN 'Function' THEN 600 END"
SHOWN = f"SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY label ORDER BY id) AS n FROM nodes WHERE label IN ('Module','Class','Function')) WHERE n <= {CODE_CAPS}"


def _code_view(t):
    caps = {label: cap for label, _order, cap in graph.VIEWS["code"][0]}
    return graph.capped_nodes(nodes(t), caps, [F.col("id")])


@query("view_nodes", GRAPH + f", shown AS ({SHOWN}) SELECT label, id, name FROM shown")
def view_nodes(t):
    """Nodes of the code view under its per-label caps."""
    return _code_view(t)


@query("view_edges", GRAPH + f""", shown AS ({SHOWN}) SELECT type, src, dst FROM edges WHERE type IN ('CONTAINS','IMPORTS','CALLS')
 AND src IN (SELECT id FROM shown) AND dst IN (SELECT id FROM shown) ORDER BY type, src, dst LIMIT 4000""")
def view_edges(t):
    """Relationships between the nodes the code view shows."""
    shown = stored(_code_view(t))
    ids = F.broadcast(shown.select(F.col("id").alias("_id")).distinct())  # bounded by the view's caps

    def among(rows, *ends):
        for end in ends:
            rows = rows.join(ids, end == F.col("_id"), "left_semi")
        return rows

    path, called = F.col("path"), lambda side: graph.qualified(*[F.col(f"{side}_{c}") for c in ("module", "class", "name")])
    held = Relations(
        among(t.modules, path), among(t.classes, F.concat("module_path", F.lit("::"), "name")),
        among(t.functions, graph.qualified(F.col("module_path"), F.col("class_name"), F.col("name"))),
        among(t.imports, F.col("from"), F.col("to")), among(t.calls, called("caller"), called("callee")))
    return graph.view_edges(code_edges(held), shown, graph.VIEWS["code"][1]).select("type", "src", "dst")


@query("view_truncation", GRAPH + f""", shown AS ({SHOWN}) SELECT a.label, a.total, b.shown FROM (SELECT label, COUNT(*) AS total FROM nodes GROUP BY 1) a
 JOIN (SELECT label, COUNT(*) AS shown FROM shown GROUP BY 1) b USING (label) WHERE a.total > b.shown""")
def view_truncation(t):
    """Which labels the view shows only in part."""
    return graph.truncation(nodes(t), _code_view(t))


@query("neighbours", GRAPH + f""" SELECT * FROM (SELECT type, dst AS neighbour, 'out' AS direction FROM edges WHERE src = {path_of('3')}
 UNION ALL SELECT type, src, 'in' FROM edges WHERE dst = {path_of('3')} AND src <> dst) ORDER BY type, neighbour, direction LIMIT 61""")
def neighbours(t):
    """Incident edges of one node, one past the display limit."""
    return graph.neighbours(edges(t), module_path(t, 3))


@query("node_captions", GRAPH + """ SELECT label, id, CASE WHEN label = 'Snapshot' THEN '#' || id || ' ' || substr(sha1(id), 1, 7)
 WHEN label = 'Function' THEN regexp_replace(id, '^.*::', '') ELSE name END AS caption,
 CASE WHEN length(repeat(id, 9)) > 300 THEN substr(repeat(id, 9), 1, 300) || '…' ELSE repeat(id, 9) END AS shown FROM nodes""")
def node_captions(t):
    """Display name per node and a clipped long property."""
    n = nodes(t)
    is_method = F.regexp_extract("id", r"::([^.]*)\.[^.]*$", 1)
    row = {"path": F.col("id"), "name": F.col("name"), "short": F.when(F.col("label") == "Snapshot", F.substring(F.sha1("id"), 1, 7)).otherwise(F.col("name")),
           "idx": F.col("id"), "title": F.col("name"), "class_name": F.when(is_method != "", is_method)}
    return n.select("label", "id", graph.caption(F.col("label"), row).alias("caption"), graph.clip(F.repeat("id", F.lit(9))).alias("shown"))


# --- catalogue: overview, search, details --------------------------------------------------------------------


@query("module_overview", with_(**MOD, **FUN, layers=LAYERED) + """ SELECT l.path, l.layer_type, COALESCE(c.n, 0) AS classes, COALESCE(f.n, 0) AS functions FROM layers l
 LEFT JOIN (SELECT module_path, COUNT(*) AS n FROM classes GROUP BY 1) c ON c.module_path = l.path
 LEFT JOIN (SELECT module_path, COUNT(*) AS n FROM functions GROUP BY 1) f ON f.module_path = l.path""")
def module_overview(t):
    """Every module with its class and function counts."""
    return graph.module_overview(t.modules.select("path", "layer_type"), t.classes, t.functions)


@query("repository_totals", with_(**MOD, **FUN, **EDG) + """ SELECT (SELECT COUNT(*) FROM modules) AS modules, (SELECT COUNT(*) FROM classes) AS classes,
 (SELECT COUNT(*) FROM functions) AS functions, (SELECT COUNT(*) FROM imports) AS import_edges, (SELECT COUNT(*) FROM calls) AS call_edges""")
def repository_totals(t):
    """Headline counts."""
    one = [df.agg(F.count(F.lit(1)).alias(name)) for name, df in
           (("modules", t.modules), ("classes", t.classes), ("functions", t.functions), ("import_edges", t.imports), ("call_edges", t.calls))]
    return reduce(lambda a, b: a.join(b), one)


@query("most_imported", with_(**EDG) + " SELECT dst AS module, COUNT(*) AS imported_by FROM imports GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def most_imported(t):
    """Top modules by importers."""
    return graph.most_imported(t.imports)


@query("most_called", with_(**EDG) + f" SELECT {CALLEE} AS function, COUNT(*) AS callers FROM calls GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def most_called(t):
    """Top functions by callers."""
    return graph.most_called(t.calls)


GROUP = """CASE WHEN layer_type IS NOT NULL THEN 'layer:' || layer_type WHEN regexp_matches(path, '/') THEN 'folder:' || regexp_replace(path, '/[^/]*$', '') ELSE 'root' END"""


@query("module_groups", with_(**MOD, layers=LAYERED) + f""", g AS (SELECT {GROUP} AS group_key, path FROM layers)
 SELECT group_key, CASE WHEN starts_with(group_key, 'layer:') THEN upper(substr(group_key, 7, 1)) || substr(group_key, 8) || ' Layer'
 WHEN starts_with(group_key, 'folder:') THEN substr(group_key, 8) ELSE 'Other / Root-Level Files' END AS display, COUNT(*) AS modules FROM g GROUP BY 1, 2""")
def module_groups(t):
    """Layer groups, then folders, then root files."""
    keyed = t.modules.select(graph.group_key(F.col("path"), F.col("layer_type")).alias("group_key"))
    return keyed.groupBy("group_key").agg(F.count(F.lit(1)).alias("modules")).withColumn("display", graph.group_display(F.col("group_key")))


@query("language_counts", with_(**MOD) + """ SELECT CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.ts' OR path LIKE '%.tsx' THEN 'typescript' ELSE 'javascript' END AS language,
 COUNT(*) AS modules FROM modules GROUP BY 1""")
def language_counts(t):
    """Modules per language."""
    return t.modules.groupBy(scope.language_of(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("modules"))


@query("search_entities", with_(**MOD, **FUN) + f""" SELECT * FROM (SELECT 'module' AS kind, path AS entity FROM modules WHERE contains(lower(path), 'pkg_1') ORDER BY length(path), path LIMIT 15)
 UNION ALL SELECT * FROM (SELECT 'class', module_path || '::' || name FROM classes WHERE contains(lower(name), 'classr') ORDER BY module_path, name LIMIT 15)
 UNION ALL SELECT * FROM (SELECT 'function', {QUAL.format(m='module_path', c='class_name', n='name')} FROM functions WHERE contains(lower(name), 'fn_2') ORDER BY module_path, name, class_name NULLS FIRST LIMIT 20)""")
def search_entities(t):
    """Modules, classes and functions whose name contains a text, each under its own limit."""
    m = graph.search(t.modules, "path", "PKG_1", [F.length("path"), "path"], 15).select(F.lit("module").alias("kind"), F.col("path").alias("entity"))
    c = graph.search(t.classes, "name", "classR", ["module_path", "name"], 15).select(F.lit("class"), F.concat("module_path", F.lit("::"), "name"))
    f = graph.search(t.functions, "name", "fn_2", ["module_path", "name", F.asc_nulls_first("class_name")], 20).select(
        F.lit("function"), graph.qualified(F.col("module_path"), F.col("class_name"), F.col("name")))
    return m.union(c).union(f)


@query("resolve_module", with_(**MOD) + """, h AS (SELECT path, CASE WHEN path = 'ITEM_30_Service.py' THEN 0 WHEN ends_with(lower(path), 'item_30_service.py') THEN 1
 WHEN contains(lower(path), 'item_30_service.py') THEN 2 END AS stage FROM modules)
 SELECT path, CAST(stage AS BIGINT) AS stage FROM h WHERE stage = (SELECT MIN(stage) FROM h) ORDER BY length(path), path LIMIT 10""")
def resolve_module(t):
    """Exact, then suffix, then contained match of a module name."""
    return graph.resolve_module(t.modules, "./ITEM_30_Service.py").select("path", F.col("stage").cast("bigint").alias("stage"))


@query("module_imports", with_(**EDG) + f""" SELECT 'imports' AS direction, dst AS module FROM imports WHERE src = {path_of('3')}
 UNION ALL SELECT 'imported_by', src FROM imports WHERE dst = {path_of('3')}""")
def module_imports(t):
    """Imports of one module in both directions."""
    path = module_path(t, 3)
    out = t.imports.filter(F.col("from") == path).select(F.lit("imports").alias("direction"), F.col("to").alias("module"))
    return out.union(t.imports.filter(F.col("to") == path).select(F.lit("imported_by"), F.col("from")))


@query("module_members", with_(**FUN) + f""" SELECT class_name, COUNT(*) AS members, string_agg(signature, '; ' ORDER BY name, signature) AS signatures FROM functions
 WHERE module_path = {path_of('3')} GROUP BY 1""")
def module_members(t):
    """Methods per class and top-level functions of one module."""
    own = t.functions.filter(F.col("module_path") == module_path(t, 3))
    listed = own.groupBy("class_name").agg(F.count(F.lit(1)).alias("members"), F.sort_array(F.collect_set(F.struct("name", "signature"))).alias("s"))
    return listed.select("class_name", "members", F.array_join(F.transform("s", lambda x: x["signature"]), "; ").alias("signatures"))


@query("module_calls", with_(**EDG) + f""" SELECT * FROM (SELECT 'calls_into' AS direction, callee_module AS module, COUNT(*) AS calls FROM calls WHERE caller_module = {path_of('3')} AND callee_module <> {path_of('3')}
 GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 15) UNION ALL SELECT * FROM (SELECT 'called_from', caller_module, COUNT(*) FROM calls WHERE callee_module = {path_of('3')} AND caller_module <> {path_of('3')}
 GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 15)""")
def module_calls(t):
    """Cross-module call counts of one module, 15 each way."""
    path = module_path(t, 3)
    into = graph.module_calls(t.calls, path, "caller").select(F.lit("calls_into").alias("direction"), "module", "calls")
    return into.union(graph.module_calls(t.calls, path, "callee").select(F.lit("called_from"), "module", "calls"))


MATCHED = "SELECT * FROM functions WHERE name = 'fn_2' AND ends_with(module_path, '.py') ORDER BY module_path, class_name NULLS FIRST LIMIT 5"


@query("function_details", with_(**FUN, **EDG) + f""", m AS ({MATCHED}) SELECT DISTINCT {QUAL.format(m='m.module_path', c='m.class_name', n='m.name')} AS function, 'called_by' AS direction, {CALLER} AS other
 FROM m JOIN calls c ON c.callee_module = m.module_path AND c.callee_name = m.name AND c.callee_class IS NOT DISTINCT FROM m.class_name
 UNION ALL SELECT DISTINCT {QUAL.format(m='m.module_path', c='m.class_name', n='m.name')}, 'calls', {CALLEE}
 FROM m JOIN calls c ON c.caller_module = m.module_path AND c.caller_name = m.name AND c.caller_class IS NOT DISTINCT FROM m.class_name""")
def function_details(t):
    """Callers and callees of the first five functions with a name."""
    found = graph.function_matches(t.functions, "fn_2", module=".py")
    return graph.call_partners(found, t.calls)


@query("change_impact", "WITH RECURSIVE imports AS (" + IMPORTS_SQL + f"""),
 reach AS (SELECT src AS module, 1 AS distance FROM imports WHERE dst = {path_of('3')} UNION
  SELECT i.src, r.distance + 1 FROM reach r JOIN imports i ON i.dst = r.module WHERE r.distance < 4)
 SELECT module, CAST(MIN(distance) AS BIGINT) AS distance FROM reach WHERE module <> {path_of('3')} GROUP BY 1""")
def change_impact(t):
    """Modules depending on one module over at most four imports, with the shortest distance."""
    return graph.reverse_reach(t.imports, module_path(t, 3))


@query("external_call_sites", with_(**EDG) + f""" SELECT {CALLER} AS caller, COALESCE(callee_class || '.', '') || callee_name AS calls FROM calls
 WHERE callee_module = {path_of('3')} AND caller_module <> {path_of('3')} ORDER BY 1, 2 LIMIT 40""")
def external_call_sites(t):
    """Calls into one module from others."""
    return graph.external_call_sites(t.calls, module_path(t, 3))


@query("capped_lists", with_(**EDG) + """, l AS (SELECT dst, list(src ORDER BY src) AS items FROM imports GROUP BY 1)
 SELECT dst AS module, CASE WHEN len(items) <= 25 THEN array_to_string(items, ', ') ELSE array_to_string(items[:25], ', ') || ', ... and ' || (len(items) - 25) || ' more' END AS shown FROM l""")
def capped_lists(t):
    """Importers of every module as display lists: 25 names, then a count of the rest."""
    from pyspark.sql import Window

    own = t.imports
    # 26 names decide the text: the first 25 and whether there are more; the count is an aggregate.
    first = own.withColumn("n", F.row_number().over(Window.partitionBy("to").orderBy("from"))).filter("n <= 25") \
        .groupBy("to").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "from"))), lambda x: x["from"]).alias("items"))
    total = own.groupBy("to").agg(F.count(F.lit(1)).alias("total"))
    more = F.when(F.col("total") > 25, F.concat(F.lit(", ... and "), F.col("total") - 25, F.lit(" more"))).otherwise("")
    return first.join(total, "to").select(F.col("to").alias("module"), F.concat(F.array_join("items", ", "), more).alias("shown"))


@query("snapshot_chain", with_(months=MONTHS_SQL) + " SELECT idx, idx + 1 AS next_idx FROM months WHERE idx < (SELECT MAX(idx) FROM months)")
def snapshot_chain(t):
    """NEXT edges between neighbouring snapshots."""
    return graph.chain_edges(t.months)


# --- scope ---------------------------------------------------------------------------------------------------


@query("path_filters", with_(**MOD) + """ SELECT path, regexp_matches(path, '[.](py|js|jsx|ts|tsx)$') AND NOT ends_with(path, '.d.ts') AS is_source,
 regexp_matches(lower(path), '(^|/)(tests)/|_test[.]py$') AS is_noise, contains(path, '/db/') AS in_group,
 CASE WHEN ends_with(path, '.min.js') THEN 'generated or vendored' ELSE '' END AS skip_reason FROM modules""")
def path_filters(t):
    """Source, noise, group and reviewability predicates on every module path."""
    p = F.col("path")
    return t.modules.select("path", paths.is_source(p).alias("is_source"), paths.is_noise(p).alias("is_noise"),
                            paths.in_group(p, F.concat(F.regexp_extract(p, r"^(.*?/pkg_\d+)/", 1), F.lit("/db"))).alias("in_group"),
                            paths.review_skip_reason(p).alias("skip_reason"))


GROUP_SIZES = "SELECT regexp_replace(path, '^([^/]*/[^/]*/[^/]*)/.*$', '\\1') AS grp, COUNT(*) AS n FROM modules GROUP BY 1"


@query("pick_groups", with_(**MOD, sizes=GROUP_SIZES).replace("WITH ", "WITH RECURSIVE ") + """, o AS (SELECT grp, n, ROW_NUMBER() OVER (ORDER BY n DESC, grp) AS r FROM sizes),
 cap AS (SELECT SUM(n) / 3 AS c FROM sizes),
 w AS (SELECT 0::BIGINT AS r, 0::HUGEINT AS total, false AS chosen UNION ALL SELECT o.r, CASE WHEN w.total + o.n <= cap.c THEN w.total + o.n ELSE w.total END, w.total + o.n <= cap.c FROM w JOIN o ON o.r = w.r + 1, cap)
 SELECT o.grp AS "group", o.n AS files, w.chosen FROM o JOIN w USING (r)""")
def pick_groups(t):
    """Folders that fit a budget of a third of all files, largest first, skipping what does not fit."""
    third = t.modules.count() // 3
    sizes = t.modules.groupBy(F.regexp_replace("path", "^([^/]*/[^/]*/[^/]*)/.*$", "$1").alias("group")).agg(F.count(F.lit(1)).alias("files"))
    return scope.pick_groups(sizes, third)
