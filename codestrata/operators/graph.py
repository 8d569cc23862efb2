"""The property graph as tables: upserts, edges, counts, views, detail reads and bounded reachability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.operators.rules import qualified

MAX_RELATIONSHIPS = 4000
MAX_NEIGHBOURS = 60
LONG_TEXT = 300

# The capped views, as (label, order columns, cap) per node type and the edge types shown.
VIEWS = {
    "code": ([("Module", ["path"], 400), ("Class", ["module_path", "name"], 400),
              ("Function", ["module_path", "name"], 600)], ["CONTAINS", "IMPORTS", "CALLS"]),
    "dependencies": ([("Module", ["path"], 800)], ["IMPORTS"]),
    "history": ([("Developer", ["name"], 100), ("Commit", ["-timestamp"], 250), ("Module", ["path"], 400)],
                ["AUTHORED", "MODIFIED"]),
    "temporal": ([("Snapshot", ["idx"], 100), ("Commit", ["timestamp"], 100), ("HModule", ["path"], 400)],
                 ["NEXT", "AT", "H_IMPORTS"]),
    "decisions": ([("Decision", ["date"], 50), ("Commit", ["timestamp"], 200), ("Module", ["path"], 300)],
                  ["EVIDENCED_BY", "AFFECTS"]),
    "everything": ([(label, ["id"], 120) for label in ("Module", "Class", "Function", "Commit", "Developer", "Snapshot",
                                                       "HModule", "Decision")], None),
}


# --- upserts ------------------------------------------------------------------------------------------------


def upsert(rows: DataFrame, keys: list[str], order: list[str], properties: list[str]) -> DataFrame:
    """One node per key, properties of the last row in ``order``. max_by combines map-side, so a key repeated
    in a third of the rows never lands whole in one task."""
    latest = F.max_by(F.struct(*properties), F.struct(*order)).alias("_last")
    return rows.groupBy(*keys).agg(latest).select(*keys, *[F.col(f"_last.{p}").alias(p) for p in properties])


def contains_edges(modules: DataFrame, classes: DataFrame, functions: DataFrame) -> DataFrame:
    """module -> class, module -> top-level function, class -> method; both ends must exist."""
    m = modules.select(F.col("path").alias("module_path"))
    c = classes.select("module_path", F.col("name").alias("class_name"))
    in_module = classes.join(m, "module_path", "left_semi").select(
        F.lit("Module").alias("src_kind"), F.col("module_path").alias("src"), F.lit("Class").alias("dst_kind"),
        F.concat("module_path", F.lit("::"), "name").alias("dst"))
    name = qualified(F.col("module_path"), F.col("class_name"), F.col("name"))
    top = functions.filter("class_name IS NULL").join(m, "module_path", "left_semi").select(
        F.lit("Module").alias("src_kind"), F.col("module_path").alias("src"), F.lit("Function").alias("dst_kind"), name.alias("dst"))
    methods = functions.filter("class_name IS NOT NULL").join(c, ["module_path", "class_name"], "left_semi").select(
        F.lit("Class").alias("src_kind"), F.concat("module_path", F.lit("::"), "class_name").alias("src"),
        F.lit("Function").alias("dst_kind"), name.alias("dst"))
    return in_module.unionByName(top).unionByName(methods).distinct()


def import_relations(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Distinct module edges whose two ends are modules."""
    known = modules.select("path")
    return imports.join(known.withColumnRenamed("path", "from"), "from", "left_semi").join(
        known.withColumnRenamed("path", "to"), "to", "left_semi").select("from", "to").distinct()


def function_key(module: str, class_name: str, name: str) -> Column:
    """Single-column function identity, with the missing class kept apart from every class name. An equality
    on it is a hash join, where three null-safe comparisons would also have to carry three columns."""
    return F.concat_ws("\x1f", F.col(module), F.coalesce(F.col(class_name), F.lit("\x1e")), F.col(name))


def call_relations(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Distinct calls whose caller and callee are functions (null-safe on the class)."""
    known = functions.select(function_key("module_path", "class_name", "name").alias("_key")).distinct()
    keyed = calls.distinct().withColumn("_from", function_key("caller_module", "caller_class", "caller_name")).withColumn(
        "_to", function_key("callee_module", "callee_class", "callee_name"))
    return keyed.join(known.withColumnRenamed("_key", "_from"), "_from", "left_semi").join(
        known.withColumnRenamed("_key", "_to"), "_to", "left_semi").drop("_from", "_to")


# --- counts and views ---------------------------------------------------------------------------------------


def label_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("label").agg(F.count(F.lit(1)).alias("count"))


def type_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("count"))


def schema_triples(edges: DataFrame) -> DataFrame:
    """(source label, type, target label) with counts. Edges carry their end labels."""
    return edges.groupBy(F.col("src_kind").alias("source"), "type", F.col("dst_kind").alias("target")).agg(
        F.count(F.lit(1)).alias("count"))


def caption(label: Column, row: dict[str, Column]) -> Column:
    """Short display name per label; ``row`` maps property names to columns."""
    base = F.substring_index(row["path"], "/", -1)
    title = row["title"]
    return (
        F.when(label.isin("Module", "HModule"), F.when(base == "", "?").otherwise(base))
        .when(label == "Function", F.concat(F.coalesce(F.concat(row["class_name"], F.lit(".")), F.lit("")), row["name"]))
        .when(label == "Commit", row["short"])
        .when(label == "Snapshot", F.concat(F.lit("#"), row["idx"].cast("string"), F.lit(" "), row["short"]))
        .when(label == "Decision", F.when(F.length(title) <= 40, title).otherwise(
            F.concat(F.substring(title, 1, 39), F.lit("…"))))
        .otherwise(F.coalesce(row["name"], label))
    )


def clip(text: Column, limit: int = LONG_TEXT) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def capped_nodes(nodes: DataFrame, caps: dict[str, int], order: list[Column]) -> DataFrame:
    """The first nodes of each label. row_number <= cap is trimmed inside each task before the shuffle."""
    limit = F.coalesce(*[F.when(F.col("label") == label, F.lit(cap)) for label, cap in caps.items()])
    ranked = nodes.filter(F.col("label").isin(*caps)).withColumn(
        "_n", F.row_number().over(Window.partitionBy("label").orderBy(*order)))
    return ranked.filter(F.col("_n") <= max(caps.values())).filter(F.col("_n") <= limit).drop("_n")


def view_edges(edges: DataFrame, shown: DataFrame, types: list[str] | None, limit: int = MAX_RELATIONSHIPS) -> DataFrame:
    """Relationships between shown nodes, ordered so that the limit is deterministic. ``shown`` is bounded by
    the view's caps, so it may be broadcast."""
    kept = edges if types is None else edges.filter(F.col("type").isin(*types))
    ids = F.broadcast(shown.select("id"))
    inside = kept.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return inside.orderBy("type", "src", "dst").limit(limit)


def truncation(nodes: DataFrame, shown: DataFrame) -> DataFrame:
    """Labels of which the view shows only part."""
    total = label_counts(nodes).withColumnRenamed("count", "total")
    part = label_counts(shown).withColumnRenamed("count", "shown")
    return total.join(part, "label").filter("total > shown")


def neighbours(edges: DataFrame, node: str, limit: int = MAX_NEIGHBOURS) -> DataFrame:
    """Undirected incident edges, one more than shown so that a reader sees there are more."""
    out = edges.filter(F.col("src") == node).select("type", F.col("dst").alias("neighbour"), F.lit("out").alias("direction"))
    into = edges.filter((F.col("dst") == node) & (F.col("src") != node)).select(
        "type", F.col("src").alias("neighbour"), F.lit("in").alias("direction"))
    return out.unionByName(into).orderBy("type", "neighbour", "direction").limit(limit + 1)


# --- detail reads -------------------------------------------------------------------------------------------


def module_overview(modules: DataFrame, classes: DataFrame, functions: DataFrame) -> DataFrame:
    """Modules with class and function counts, zeros included; both sides are aggregated before the join."""
    c = classes.groupBy(F.col("module_path").alias("path")).agg(F.count(F.lit(1)).alias("classes"))
    f = functions.groupBy(F.col("module_path").alias("path")).agg(F.count(F.lit(1)).alias("functions"))
    return modules.join(c, "path", "left").join(f, "path", "left").select(
        *modules.columns, F.coalesce("classes", F.lit(0)).cast("bigint").alias("classes"),
        F.coalesce("functions", F.lit(0)).cast("bigint").alias("functions"))


def most_imported(imports: DataFrame, top: int = 8) -> DataFrame:
    return imports.groupBy(F.col("to").alias("module")).agg(F.count(F.lit(1)).alias("imported_by")).orderBy(
        F.desc("imported_by"), "module").limit(top)


def most_called(calls: DataFrame, top: int = 8) -> DataFrame:
    return (
        calls.groupBy(qualified(F.col("callee_module"), F.col("callee_class"), F.col("callee_name")).alias("function"))
        .agg(F.count(F.lit(1)).alias("callers")).orderBy(F.desc("callers"), "function").limit(top)
    )


def group_key(path: Column, layer: Column) -> Column:
    """layer:<name>, else folder:<path>, else root."""
    folder = F.regexp_replace(path, r"/?[^/]*$", "")
    return F.when(layer.isNotNull(), F.concat(F.lit("layer:"), layer)).when(
        folder != "", F.concat(F.lit("folder:"), folder)).otherwise("root")


def group_display(key: Column) -> Column:
    name = F.regexp_replace(key, "^(layer|folder):", "")
    capital = F.concat(F.upper(F.left(name, F.lit(1))), F.lower(F.substr(name, F.lit(2))))
    return F.when(key.startswith("layer:"), F.concat(capital, F.lit(" Layer"))).when(
        key.startswith("folder:"), name).otherwise("Other / Root-Level Files")


def group_order(key: Column) -> Column:
    return F.when(key.startswith("layer:"), 0).when(key.startswith("folder:"), 1).otherwise(2)


def resolve_module(modules: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Candidates for a module name in the first stage that has any: exact, case-insensitive suffix, then
    contained text; shortest path first."""
    wanted = text.strip().replace("\\", "/")
    while wanted.startswith("./"):
        wanted = wanted[2:]
    lowered = F.lower("path")
    stage = F.when(F.col("path") == wanted, 0).when(lowered.endswith(wanted.lower()), 1).when(
        lowered.contains(wanted.lower()), 2)
    hits = modules.select("path", stage.alias("stage")).filter("stage IS NOT NULL")
    best = hits.agg(F.min("stage").alias("stage"))
    return hits.join(F.broadcast(best), "stage").orderBy(F.length("path"), "path").limit(limit)


def search(rows: DataFrame, column: str, text: str, order: list, limit: int) -> DataFrame:
    """Case-insensitive contained match, first ``limit`` in order."""
    return rows.filter(F.lower(column).contains(text.lower())).orderBy(*order).limit(limit)


def module_calls(calls: DataFrame, path: str, side: str, top: int = 15) -> DataFrame:
    """Cross-module call counts of one module, outward (side='caller') or inward (side='callee')."""
    other = "callee" if side == "caller" else "caller"
    return (
        calls.filter((F.col(f"{side}_module") == path) & (F.col(f"{other}_module") != path))
        .groupBy(F.col(f"{other}_module").alias("module")).agg(F.count(F.lit(1)).alias("calls"))
        .orderBy(F.desc("calls"), "module").limit(top)
    )


def function_matches(functions: DataFrame, name: str, class_name: str | None = None, module: str | None = None,
                     limit: int = 5) -> DataFrame:
    kept = functions.filter(F.col("name") == name)
    if class_name is not None:
        kept = kept.filter(F.col("class_name") == class_name)
    if module is not None:
        kept = kept.filter((F.col("module_path") == module) | F.col("module_path").endswith(module))
    return kept.orderBy("module_path", F.asc_nulls_first("class_name")).limit(limit)


def call_partners(found: DataFrame, calls: DataFrame) -> DataFrame:
    """(function, direction, other): callers and callees of a few matched functions. ``found`` is a top-5
    list, so it is broadcast against the calls."""
    keys = F.broadcast(found.select(
        function_key("module_path", "class_name", "name").alias("_key"),
        qualified(F.col("module_path"), F.col("class_name"), F.col("name")).alias("function")))
    caller = qualified(F.col("caller_module"), F.col("caller_class"), F.col("caller_name"))
    callee = qualified(F.col("callee_module"), F.col("callee_class"), F.col("callee_name"))
    into = calls.withColumn("_key", function_key("callee_module", "callee_class", "callee_name")).join(keys, "_key").select(
        "function", F.lit("called_by").alias("direction"), caller.alias("other"))
    out = calls.withColumn("_key", function_key("caller_module", "caller_class", "caller_name")).join(keys, "_key").select(
        "function", F.lit("calls").alias("direction"), callee.alias("other"))
    return into.unionByName(out).distinct()


def reverse_reach(edges: DataFrame, target: str, depth: int = 4) -> DataFrame:
    """Modules that reach ``target`` over at most ``depth`` import edges, with the shortest distance.

    Level by level: each level is the distinct sources of edges into the previous one, so it never exceeds
    the number of modules, however many paths there are. A level's exchange is reused by the next level and
    by the final minimum."""
    level = edges.filter((F.col("to") == target) & (F.col("from") != target)).select(F.col("from").alias("module")).distinct()
    levels = [level.withColumn("distance", F.lit(1))]
    for d in range(2, depth + 1):
        level = edges.join(level.withColumnRenamed("module", "to"), "to", "left_semi").filter(
            F.col("from") != target).select(F.col("from").alias("module")).distinct()
        levels.append(level.withColumn("distance", F.lit(d)))
    reached = levels[0]
    for more in levels[1:]:
        reached = reached.unionByName(more)
    return reached.groupBy("module").agg(F.min("distance").cast("bigint").alias("distance"))


def external_call_sites(calls: DataFrame, path: str, limit: int = 40) -> DataFrame:
    return calls.filter((F.col("callee_module") == path) & (F.col("caller_module") != path)).select(
        qualified(F.col("caller_module"), F.col("caller_class"), F.col("caller_name")).alias("caller"),
        F.concat(F.coalesce(F.concat("callee_class", F.lit(".")), F.lit("")), "callee_name").alias("calls"),
    ).orderBy("caller", "calls").limit(limit)


def chain_edges(snapshots: DataFrame) -> DataFrame:
    """NEXT edges of the snapshot chain as an equi-join on idx + 1."""
    later = snapshots.select((F.col("idx") - 1).alias("idx"), F.col("idx").alias("next_idx"))
    return snapshots.select("idx").join(later, "idx")


def capped_list(items: Column, limit: int = 25) -> Column:
    """The first items, then how many more there are."""
    return F.when(F.size(items) <= limit, items).otherwise(F.concat(
        F.slice(items, 1, limit), F.array(F.format_string("... and %d more", F.size(items) - limit))))


def top_languages(files: DataFrame, languages: DataFrame, top: int = 3) -> DataFrame:
    """The most frequent known extensions with their language names."""
    counts = files.groupBy("ext").agg(F.count(F.lit(1)).alias("files"))
    return counts.join(F.broadcast(languages), "ext").orderBy(F.desc("files"), "ext").limit(top)
