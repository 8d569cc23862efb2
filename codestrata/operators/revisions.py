"""Many revisions of a source tree in one job.

A tree is (revision, path, digest): which content stands at a path in a revision. Contents are parsed once for each
(path, digest), however many revisions hold it; facts then meet the trees by that key, and every name lookup carries the
revision, so a file is resolved against the files of its own revision. Python and script facts have one shape and one
relation. Rows grow with the trees; nothing is walked revision by revision, and edges are pairs of numbers until they leave."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.operators import resolve_python, resolve_script, rules, temporal
from codestrata.session import global_index, stored
from codestrata.sources import python_source, script_source

BY = ("revision",)
_FACT = ["fact", "ord", "owner", "name", "detail", "obj", "target"]


def blob_facts(tree: DataFrame, contents: DataFrame) -> DataFrame:
    """(digest, path, language, fact, ...) of every different file version of a tree, in all languages. ``contents`` is
    (digest, content), one row per digest; a digest is hexadecimal.

    The digest leads the path through the parsers as a folder of its own, and is taken off afterwards (from the stems of
    relative imports too, which are named after their folder)."""
    versions = tree.select("digest", "path").distinct().join(contents, "digest").select(
        F.concat("digest", F.lit("/"), "path").alias("path"), "content")
    both = python_source.facts(versions).withColumn("language", F.lit("python")).unionByName(
        script_source.facts(versions).withColumn("language", F.lit("script")))
    digest = F.substring_index("path", "/", 1)
    own = F.col("owner").startswith(F.concat(digest, F.lit("."))) & (F.col("fact") == "import") & (F.col("language") == "python")
    owner = F.when(own, F.expr("substr(owner, length(substring_index(path, '/', 1)) + 2)")).otherwise(F.col("owner"))
    return both.withColumn("owner", owner).select(
        digest.alias("digest"), F.expr("substr(path, instr(path, '/') + 1)").alias("path"), "language", *_FACT)


def snapshot_facts(tree: DataFrame, facts: DataFrame) -> DataFrame:
    """(revision, path, language, fact, ...): the facts of every file of every revision."""
    return tree.select("revision", "path", "digest").join(facts, ["path", "digest"]).drop("digest")


def snapshot_edges(tree: DataFrame, facts: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """Distinct (revision, from, to) import edges. ``facts`` is keyed by (path, digest); ``configs`` are path aliases of
    scripts, the same for all revisions."""
    _, edges, ids = _linked(tree, facts, configs)
    for end in ("from", "to"):
        edges = edges.join(ids.select(F.col("id").alias(end), F.col("path").alias(f"_{end}")), end)
    return edges.select("revision", F.col("_from").alias("from"), F.col("_to").alias("to"))


def _linked(tree: DataFrame, facts: DataFrame, configs: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, edges, ids): (revision, id) of each file, distinct (revision, from, to) edges between ids, and (path, id).

    What an import may mean is looked up once per file version. If one file alone can be meant, a revision only has to hold
    it, which is a join of numbers; the rest is resolved against the files of each revision, those that can be meant."""
    ids = stored(global_index(tree.select("path").distinct(), [F.col("path")], "id"))
    script = F.col("path").rlike(r"\.(js|jsx|ts|tsx)$")
    python = facts.filter("language = 'python' AND fact IN ('import', 'function', 'class')")
    claimed = resolve_python.claims(ids.filter(F.col("path").endswith(".py")).select("path"))
    imports = python.filter("fact = 'import'").select("path", "digest", "language", *_FACT[:5])
    meant = stored(resolve_python.settled(imports, python, claimed))
    specs = facts.filter("language = 'script' AND fact = 'import'").select("path", "digest", F.col("owner").alias("spec")).distinct()
    named = stored(resolve_script.candidates(specs.select("path", "spec").distinct(), ids.filter(script).select("path"), configs))
    ends = meant.filter("NOT _open").select("path", "digest", F.explode(F.array("_stem", "_sub")).alias("to")).unionByName(
        specs.join(named.filter("size(targets) = 1"), ["path", "spec"]).select("path", "digest", F.col("targets")[0].alias("to")))
    ends = ends.filter("to <> path").distinct().join(ids.withColumnsRenamed({"path": "to", "id": "_to"}), "to")
    held = tree.select("revision", "path", "digest").join(ids, "path").join(
        ends.groupBy("path", "digest").agg(F.collect_list("_to").alias("ends")), ["path", "digest"], "left")
    files = stored(held.select("revision", "id", "ends"))
    here = files.select("revision", F.col("id").alias("to")).distinct()
    edges = files.select("revision", F.col("id").alias("from"), F.explode("ends").alias("to")).join(here, ["revision", "to"]).select("revision", "from", "to")

    left = []
    unclear = meant.filter("_open")
    if not unclear.isEmpty():
        wanted = unclear.select(F.explode(F.array("owner", "_full")).alias("name")).filter("name IS NOT NULL").distinct()
        among = tree.join(claimed.join(wanted, "name", "left_semi").select("path").distinct(), "path", "left_semi")
        defined = python.filter("fact <> 'import'").join(unclear.select("name").distinct(), "name", "left_semi")
        asked = unclear.select(*imports.columns).unionByName(defined.select(*imports.columns))
        index = resolve_python.module_index(among.select("revision", "path").distinct(), BY).join(wanted, "name", "left_semi")
        left.append(resolve_python.import_edges(snapshot_facts(tree, asked), index, BY))
    several = named.filter("size(targets) > 1")
    if not several.isEmpty():
        among = tree.join(several.select(F.explode("targets").alias("path")).distinct(), "path", "left_semi")
        asked = tree.join(specs.join(several, ["path", "spec"], "left_semi"), ["path", "digest"]).select("revision", "path", "spec").distinct()
        found = resolve_script.resolve_specifiers(asked, among.select("revision", "path").distinct(), configs, BY).filter("target <> path")
        left.append(found.select("revision", F.col("path").alias("from"), F.col("target").alias("to")))
    for rows in left:
        for end in ("from", "to"):
            rows = rows.join(ids.withColumnsRenamed({"path": end, "id": f"_{end}"}), end)
        edges = edges.unionByName(rows.select("revision", F.col("_from").alias("from"), F.col("_to").alias("to")))
    return files.select("revision", "id"), edges.distinct(), ids


def violations(edges: DataFrame, layers: DataFrame, rule_table: DataFrame) -> DataFrame:
    """(revision, rule_name, severity, from, to) of the import rules each revision breaks."""
    judged = rules.judged_edges(rules.import_edges(edges, BY), layers, rule_table, BY)
    return rules.violations(judged).select("revision", "rule_name", "severity", F.col("caller_module").alias("from"), F.col("callee_module").alias("to"))


def build(tree: DataFrame, facts: DataFrame, layers: DataFrame, rule_table: DataFrame, order: DataFrame) -> DataFrame:
    """One row per revision: its size, how many of its files were parsed for it, its edges and violations, and what changed
    against the revision before. ``layers`` is (path, layer_type); ``order`` is (revision, idx), consecutive, a sample of
    the history and so small beside the trees."""
    files, edges, ids = _linked(tree, facts)
    edges = stored(edges)
    broken = stored(violations(edges, layers.join(ids, "path").select(F.col("id").alias("path"), "layer_type"), rule_table))
    last = order.agg(F.max("idx").alias("last"))
    # a version is new in the first revision that holds it
    first = tree.join(F.broadcast(order), "revision").groupBy("path", "digest").agg(F.min("idx").alias("idx"))
    counts = [
        files.groupBy("revision").agg(F.count_distinct("id").alias("n_modules")),
        first.join(F.broadcast(order), "idx").groupBy("revision").agg(F.count(F.lit(1)).alias("n_parsed")),
        edges.groupBy("revision").agg(F.count(F.lit(1)).alias("n_imports")),
        broken.groupBy("revision").agg(F.count(F.lit(1)).alias("n_violations"), F.sum("severity").cast("bigint").alias("weighted_violations")),
    ]
    for rows, keys, name in ((edges, ["from", "to"], "imports"), (broken, ["rule_name", "from", "to"], "violations")):
        changed = temporal.diffs(rows.join(F.broadcast(order), "revision"), keys, last)
        counts.append(changed.join(F.broadcast(order), "idx").groupBy("revision").agg(
            F.count_if(F.col("change") == "added").alias(f"new_{name}"), F.count_if(F.col("change") == "removed").alias(f"gone_{name}")))
    out = order
    for counted in counts:
        out = out.join(counted, "revision", "left")
    return out.na.fill(0)
