"""Documentation and diagrams as ordered lines. Text is never assembled in one value: every line is a row with
its sort keys, and a writer sorts and saves them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.operators.graph import group_key, group_order
from codestrata.operators.rules import qualified
from codestrata.session import global_index

MODULES_PER_BATCH = 10
MAX_BATCHES = 40
# Diagram styles per layer.
LAYER_STYLE = {
    "controller": "fill:#2b2b2b,stroke:#f2f2f2,color:#f2f2f2",
    "service": "fill:#404040,stroke:#f2f2f2,color:#f2f2f2",
    "database": "fill:#181818,stroke:#f2f2f2,color:#f2f2f2",
}
DEFAULT_STYLE = "fill:#2b2b2b,stroke:#f2f2f2,color:#f2f2f2"


def node_id(path: Column) -> Column:
    """Diagram-safe identifier from the whole path."""
    return F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), "[^0-9a-zA-Z_]", "_")


def folder_of(path: Column) -> Column:
    folder = F.regexp_replace(path, r"/?[^/]*$", "")
    return F.when(folder == "", "(root)").otherwise(folder)


def style(layer: Column) -> Column:
    return F.coalesce(*[F.when(layer == k, v) for k, v in LAYER_STYLE.items()], F.lit(DEFAULT_STYLE))


def module_diagram(modules: DataFrame, imports: DataFrame) -> DataFrame:
    """(part, section, sort, line) of a flowchart: nodes grouped by layer, folder or root, then edges."""
    label = F.substring_index("path", "/", -1)
    nodes = modules.select(
        F.lit(1).alias("part"), group_key(F.col("path"), F.col("layer_type")).alias("section"), F.col("path").alias("sort"),
        F.concat(node_id(F.col("path")), F.lit('["'), label, F.lit('"]')).alias("line"))
    edges = imports.select(F.lit(2).alias("part"), F.lit("edges").alias("section"), F.concat_ws(" ", "from", "to").alias("sort"),
                           F.concat(node_id(F.col("from")), F.lit(" --> "), node_id(F.col("to"))).alias("line"))
    return nodes.unionByName(edges)


def layer_styles(modules: DataFrame) -> DataFrame:
    return modules.filter("layer_type IS NOT NULL").select("layer_type").distinct().select(
        F.concat(F.lit("classDef "), "layer_type", F.lit("Style "), style(F.col("layer_type")), F.lit(";")).alias("line"))


def folder_diagram(modules: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(folders, edges): folders with file counts and their majority layer (the first name on ties), and import
    counts between different folders."""
    placed = modules.withColumn("folder", folder_of(F.col("path")))
    by_layer = placed.groupBy("folder", "layer_type").agg(F.count(F.lit(1)).alias("n"))
    folders = by_layer.groupBy("folder").agg(
        F.sum("n").alias("files"), F.min_by("layer_type", F.when(F.col("layer_type").isNotNull(), F.struct(-F.col("n"), F.col("layer_type")))).alias("layer"))
    pairs = imports.select(folder_of(F.col("from")).alias("src"), folder_of(F.col("to")).alias("dst")).filter("src <> dst").groupBy(
        "src", "dst").agg(F.count(F.lit(1)).alias("imports"))
    known = folders.select("folder")
    inside = pairs.join(known.withColumnRenamed("folder", "src"), "src", "left_semi").join(known.withColumnRenamed("folder", "dst"), "dst", "left_semi")
    return folders, inside


def folder_lines(folders: DataFrame, edges: DataFrame) -> DataFrame:
    safe = lambda c: F.concat(F.lit("folder_"), F.regexp_replace(c, "[^0-9a-zA-Z_]", "_"))
    plural = F.when(F.col("files") != 1, "s").otherwise("")
    nodes = folders.select(F.lit(1).alias("part"), F.concat(safe("folder"), F.lit('["'), "folder", F.lit(" ("), F.col("files").cast("string"), F.lit(" file"), plural, F.lit(')"]')).alias("line"))
    links = edges.select(F.lit(2).alias("part"), F.concat(safe("src"), F.lit(" -->|"), F.col("imports").cast("string"), F.lit("| "), safe("dst")).alias("line"))
    return nodes.unionByName(links)


def batches(modules: DataFrame, per_batch: int = MODULES_PER_BATCH) -> DataFrame:
    """Modules with their group and batch inside the group, in path order. Positions come from one distributed
    numbering minus the group's first position, so a group with a third of all modules is never one window."""
    keyed = modules.select("path", group_key(F.col("path"), F.col("layer_type")).alias("group_key"))
    numbered = global_index(keyed, [group_order(F.col("group_key")), F.col("group_key"), F.col("path")], "pos")
    first = numbered.groupBy("group_key").agg(F.min("pos").alias("_first"))
    return numbered.join(first, "group_key").select(
        "path", "group_key", F.floor((F.col("pos") - F.col("_first")) / per_batch).cast("bigint").alias("batch"))


def described(batched: DataFrame, limit: int = MAX_BATCHES) -> DataFrame:
    """Adds ``described``: whether a batch is among the first ones that get prose; the rest is only listed."""
    first = batched.select("group_key", "batch").distinct().orderBy(group_order(F.col("group_key")), "group_key", "batch").limit(limit)
    return batched.join(F.broadcast(first.withColumn("_in", F.lit(True))), ["group_key", "batch"], "left").select(
        *batched.columns, F.col("_in").isNotNull().alias("described"))


def known_issues(formatted: DataFrame) -> DataFrame:
    return formatted.select(F.concat(F.lit("- ["), "rule_name", F.lit("] severity="), F.col("severity").cast("string"), F.lit(": "), "caller", F.lit(" -> "), "callee").alias("line"))


def health_text(health: Column) -> Column:
    return F.when(health.isNull(), "not scored (no layer-tagged dependencies for the rules to judge)").otherwise(
        F.concat(F.format_number(health, 1), F.lit(" / 100")))


def relationship_lines(imports: DataFrame, calls: DataFrame) -> DataFrame:
    a = imports.select(F.lit("imports").alias("section"), F.concat(F.lit("- "), "from", F.lit(" -> "), "to").alias("line"))
    b = calls.select(F.lit("calls").alias("section"), F.concat(
        F.lit("- "), qualified(F.col("caller_module"), F.col("caller_class"), F.col("caller_name")), F.lit(" -> "),
        qualified(F.col("callee_module"), F.col("callee_class"), F.col("callee_name"))).alias("line"))
    return a.unionByName(b)


def module_listing(modules: DataFrame, classes: DataFrame, functions: DataFrame) -> DataFrame:
    """(path, classes, functions): the structural listing of each module, names sorted."""
    c = classes.groupBy(F.col("module_path").alias("path")).agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("classes"))
    name = F.concat(F.coalesce(F.concat("class_name", F.lit(".")), F.lit("")), "name")
    f = functions.groupBy(F.col("module_path").alias("path")).agg(F.array_join(F.sort_array(F.collect_list(name)), ", ").alias("functions"))
    return modules.select("path").join(c, "path", "left").join(f, "path", "left")


def fallback_explanation(groups: DataFrame, rules: DataFrame) -> DataFrame:
    """The facts-only explanation of a violation group."""
    what = F.when(F.col("edge") == "imports", "imports").otherwise("calls into")
    return groups.join(F.broadcast(rules.select("rule_name", "rule_from", "rule_to")), "rule_name").select("rule_name", F.concat(
        F.col("occurrences").cast("string"), F.lit(" place(s) where a "), "rule_from", F.lit(" module "), what, F.lit(" the "), "rule_to",
        F.lit(" layer, which rule '"), "rule_name", F.lit("' forbids.")).alias("summary"))
