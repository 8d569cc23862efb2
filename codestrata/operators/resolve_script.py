"""JavaScript / TypeScript specifiers, barrels and calls across files. All joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.paths import basename, dirname
from codestrata.functions.text import strip_jsonc
from codestrata.session import stored

# Extensions of each family, extends and re-export hops followed.
TS_FAMILY, JS_FAMILY = (".ts", ".tsx"), (".js", ".jsx")
MAX_EXTENDS, MAX_HOPS = 5, 5
# Fixed value: what a specifier may leave out at the end of a path, or say in its place.
ENDING = r"(?:/index|\.(?:jsx?|mjs|cjs|tsx?)|/)*\z"


def normalize(path: Column) -> Column:
    """``a/./b/../c`` -> ``a/c``; null when it climbs above the repository. The root is an empty text."""
    folded = F.aggregate(
        F.filter(F.split(path, "/"), lambda p: ~p.isin("", ".")), F.array(F.lit("/")),
        lambda acc, p: F.when(p != "..", F.concat(acc, F.array(p))).otherwise(F.slice(acc, F.lit(1), F.size(acc) - 1)))
    # bound once through a one-element transform, so the fold is not repeated per use
    shown = F.transform(F.array(folded), lambda f: F.when(F.get(f, F.lit(0)) == "/", F.array_join(F.slice(f, F.lit(2), F.size(f)), "/")))
    return F.get(shown, F.lit(0))


def _join(base: Column, rel: Column) -> Column:
    return normalize(F.when(base == "", rel).otherwise(F.concat(base, F.lit("/"), rel)))


def _once(value: Column) -> Column:
    """A value as a row of its own: a filter on it does not work it out again, nor earlier, on rows not yet made distinct."""
    return F.explode_outer(F.array(value))


# --- tsconfig / jsconfig --------------------------------------------------------------------------------------


def path_configs(files: DataFrame) -> DataFrame:
    """(dir, base_url, patterns) of every tsconfig.json / jsconfig.json that declares baseUrl or paths, with
    ``extends`` applied over at most five in-repository hops and all paths repository-relative. ``files`` is
    (path, content) of the configuration files."""
    schema = "extends string, compilerOptions struct<baseUrl string, paths map<string, array<string>>>"
    own = files.select("path", F.from_json(strip_jsonc(F.regexp_replace("content", "^﻿", "")), schema).alias("j"))
    parent = _join(dirname(F.col("path")), F.col("j.extends"))
    facts = stored(own.select(
        "path", F.when(F.col("j.extends").startswith("."), F.when(parent.endswith(".json"), parent).otherwise(F.concat(parent, F.lit(".json")))).alias("parent"),
        F.when(F.col("j.compilerOptions.baseUrl").isNotNull(), _join(dirname(F.col("path")), F.col("j.compilerOptions.baseUrl"))).alias("base_url"),
        F.col("j.compilerOptions.paths").alias("paths"), dirname(F.col("path")).alias("paths_dir")))
    roots = facts.filter(basename(F.col("path")).isin("tsconfig.json", "jsconfig.json"))
    chain = roots.select(F.col("path").alias("root"), F.lit(0).alias("hop"), *[c for c in facts.columns if c != "path"])
    step = facts.select(F.col("path").alias("parent"), F.col("parent").alias("_next"), F.col("base_url").alias("_b"), F.col("paths").alias("_p"), F.col("paths_dir").alias("_d"))
    level = chain
    for hop in range(1, MAX_EXTENDS + 1):
        level = level.join(step, "parent").select("root", F.lit(hop).alias("hop"), F.col("_next").alias("parent"), F.col("_b").alias("base_url"), F.col("_p").alias("paths"), F.col("_d").alias("paths_dir"))
        chain = chain.unionByName(level)
    nearest = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("hop")))
    merged = chain.groupBy("root").agg(
        nearest(F.col("base_url")).alias("base_url"),
        F.min_by(F.struct("paths", "paths_dir"), F.when(F.col("paths").isNotNull(), F.col("hop"))).alias("p"))
    rows = merged.filter("base_url IS NOT NULL OR p.paths IS NOT NULL").withColumn("dir", dirname(F.col("root")))
    # tsconfig.json wins over jsconfig.json in one folder
    best = rows.groupBy("dir").agg(F.max_by(F.struct("base_url", "p"), F.struct(F.col("root").endswith("tsconfig.json"), F.col("root"))).alias("c"))
    base = F.coalesce("c.base_url", "c.p.paths_dir", F.lit(""))
    return best.select("dir", F.col("c.base_url").alias("base_url"), F.map_entries(F.coalesce("c.p.paths", F.create_map().cast("map<string,array<string>>"))).alias("patterns"), base.alias("paths_base"))


# --- specifiers -----------------------------------------------------------------------------------------------


def resolve_specifiers(wanted: DataFrame, known: DataFrame, configs: DataFrame | None = None, by: tuple = ()) -> DataFrame:
    """(path, spec) -> target for specifiers that name a parsed file. ``wanted`` is distinct (path, spec),
    ``known`` distinct (path). ``by`` adds leading keys to both, such as a revision, within which files are looked up.

    A specifier means the same to every file of one folder and language family, so it is resolved once per
    (folder, spec, family) and joined back. It meets the known files that differ from it in their ending only, so
    its candidates are no rows of their own; the first of them that exists wins."""
    keyed, found, key = _met(wanted, known, configs, by)
    best = found.groupBy(*key).agg(F.min_by("target", F.struct("rank", "ord")).alias("target"))
    return keyed.join(best, key).select(*by, "path", "spec", "target")


def candidates(wanted: DataFrame, known: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """(path, spec, targets): all files a specifier may name, whichever of them exist; a few that differ in their ending."""
    keyed, found, key = _met(wanted, known, configs)
    return keyed.join(found.groupBy(*key).agg(F.collect_set("target").alias("targets")), key).select("path", "spec", "targets")


def _met(wanted: DataFrame, known: DataFrame, configs: DataFrame | None, by: tuple = ()) -> tuple[DataFrame, DataFrame, list[str]]:
    """(specifiers with their key, the known files each key may mean in order of ``rank`` and ``ord``, the key's columns)."""
    key = [*by, "folder", "spec", "own_ts"]
    keyed = wanted.filter("spec <> ''").select(*by, "path", "spec", dirname(F.col("path")).alias("folder"), F.col("path").rlike(r"\.tsx?$").alias("own_ts"))
    specs = keyed.select(*key).distinct()
    specs = stored(specs)  # read for relative and aliased ones
    relative = specs.filter(F.col("spec").startswith(".")).select(*key, _once(_join(F.col("folder"), F.col("spec"))).alias("base"), F.lit(0).alias("rank"))
    bases = relative.filter("base IS NOT NULL")
    if configs is not None:
        bases = bases.unionByName(_alias_bases(specs.filter(~F.col("spec").startswith(".")), configs, key))
    families = lambda a, b: F.array(*[F.lit(e) for e in a + b])
    exts = F.when(F.col("own_ts"), families(TS_FAMILY, JS_FAMILY)).otherwise(families(JS_FAMILY, TS_FAMILY))
    stem = F.regexp_replace("base", r"\.(js|jsx|mjs|cjs)$", "")
    node_next = F.when(F.col("base").rlike(r"\.(js|jsx|mjs|cjs)$"), F.array(*[F.concat(stem, F.lit(e)) for e in TS_FAMILY])).otherwise(F.array().cast("array<string>"))
    probes = F.concat(F.array("base"), F.transform(exts, lambda e: F.concat(F.col("base"), e)),
                      F.transform(exts, lambda e: F.concat(F.when(F.col("base") == "", "index").otherwise(F.concat("base", F.lit("/index"))), e)), node_next)
    core = lambda c: F.regexp_replace(F.concat(F.lit("/"), c), ENDING, "")
    asked = bases.select(*key, "rank", "base", core(F.col("base")).alias("_core"))
    met = asked.join(known.select(*by, F.col("path").alias("target"), core(F.col("path")).alias("_core")), [*by, "_core"])
    return keyed, met.select(*met.columns, _once(F.array_position(probes, F.col("target"))).alias("ord")).filter("ord > 0"), key


def _alias_bases(specs: DataFrame, configs: DataFrame, key: list[str]) -> DataFrame:
    """Candidates under the nearest configuration above each importing folder: matching patterns by prefix
    length (an exact pattern outranks), then baseUrl. Folders meet configurations through their own ancestors."""
    pieces = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(pieces)), lambda i: F.array_join(F.slice(pieces, F.lit(1), i), "/"))
    # which configuration applies depends on the folder alone
    folders = specs.select("folder").distinct().select("folder", F.explode(F.array_distinct(above)).alias("dir"))
    owner = folders.join(configs.select("dir"), "dir").groupBy("folder").agg(F.max_by("dir", F.length("dir")).alias("dir"))
    nearest = specs.join(owner, "folder").join(configs, "dir").select(*key, F.struct("base_url", "patterns", "paths_base").alias("c"))
    each = nearest.select(*key, F.col("c.paths_base").alias("at"), F.explode("c.patterns").alias("e")).select(*key, "at", F.col("e.key").alias("pattern"), F.col("e.value").alias("targets"))
    star = F.size(F.split("pattern", r"\*")) == 2
    prefix, suffix = F.substring_index("pattern", "*", 1), F.substring_index("pattern", "*", -1)
    fits = F.when(star, F.col("spec").startswith(prefix) & F.col("spec").endswith(suffix) & (F.length("spec") >= F.length(prefix) + F.length(suffix))).otherwise(F.col("spec") == F.col("pattern"))
    middle = F.when(star, F.substr("spec", F.length(prefix) + 1, F.length("spec") - F.length(prefix) - F.length(suffix))).otherwise("")
    weight = F.when(star, F.length(prefix)).otherwise(F.length("pattern") + 1)
    hit = each.filter(fits & (F.size(F.split("pattern", r"\*")) <= 2)).select(
        *key, (F.lit(100_000) - weight * 100).alias("rank"), middle.alias("middle"), "at", F.posexplode("targets").alias("n", "t"))
    by_pattern = hit.select(*key, _once(_join(F.col("at"), F.replace("t", F.lit("*"), "middle"))).alias("base"), (F.col("rank") + F.col("n")).alias("rank"))
    by_base = nearest.filter("c.base_url IS NOT NULL").select(*key, _once(_join(F.col("c.base_url"), F.col("spec"))).alias("base"), F.lit(1_000_000).alias("rank"))
    return by_pattern.unionByName(by_base).filter("base IS NOT NULL")


def import_edges(facts: DataFrame, targets: DataFrame) -> DataFrame:
    """Distinct (from, to) edges without self edges. ``targets`` is (path, spec, target)."""
    specs = facts.filter("fact = 'import'").select("path", F.col("owner").alias("spec")).distinct()
    return specs.join(targets, ["path", "spec"]).filter("path <> target").select(F.col("path").alias("from"), F.col("target").alias("to")).distinct()


# --- names ----------------------------------------------------------------------------------------------------


def name_tables(facts: DataFrame, targets: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bindings, stars). bindings: (path, name) -> (kind, tpath, tname, next_outside, inner), one row each:
    functions, classes, imports, and re-exports, which only bind from outside (``inner`` is false); kind 'follow' continues at
    (tpath, tname). stars: (path, ord, target) of ``export *``."""
    row = ["path", "name", "prio", "ord", "kind", "tpath", "tname", "next_outside"]

    def rows(df, name, prio, kind, tpath, tname, nxt):
        return df.select("path", name.alias("name"), F.lit(prio).alias("prio"), F.col("ord"), kind.alias("kind"), tpath.alias("tpath"), tname.alias("tname"), F.lit(nxt).alias("next_outside"))

    n, p = F.col("name"), F.col("path")
    default = facts.filter("fact = 'default'").groupBy("path").agg(F.max_by("name", "ord").alias("d"))
    defaults = known.select("path").join(default, "path", "left").withColumn("ord", F.lit(0))
    defaults = rows(defaults, F.lit("default"), 0, F.when(F.col("d").isNull(), "module").otherwise("follow"), p, F.col("d"), False)
    functions = rows(facts.filter("fact = 'function' AND owner IS NULL"), n, 1, F.lit("function"), p, n, False)
    classes = rows(facts.filter("fact = 'class'"), n, 2, F.lit("class"), p, n, False)
    located = facts.filter("fact IN ('import', 'reexport')").select("path", "fact", "ord", "name", "detail", F.col("owner").alias("spec")).join(targets, ["path", "spec"])
    whole = F.when(n == "*", "module").otherwise("follow")
    symbol = F.when(n != "*", n)
    # the last import of a name wins: later rows rank first
    imported = located.filter("fact = 'import' AND name IS NOT NULL AND detail IS NOT NULL").withColumn("ord", -F.col("ord"))
    local = rows(imported, F.col("detail"), 3, whole, F.col("target"), symbol, True)
    again = located.filter("fact = 'reexport' AND target <> path")
    exported = rows(again.filter("name IS NOT NULL"), F.col("detail"), 4, whole, F.col("target"), symbol, True)
    every = defaults.unionByName(functions).unionByName(classes).unionByName(local).unionByName(exported)
    # re-exports come last, so the best row of a name is one of them only where nothing else binds it
    best = every.groupBy("path", "name").agg(F.min_by(F.struct(*row[4:], (F.col("prio") < 4).alias("inner")), F.struct("prio", "ord")).alias("b"))
    stars = again.filter("name IS NULL").select("path", "ord", "target").distinct()
    return stored(best.select("path", "name", "b.*")), stored(stars)


def follow(queries: DataFrame, bindings: DataFrame, stars: DataFrame) -> DataFrame:
    """(path, name, outside) -> (kind, tpath, tname) over at most five hops. A name a module does not bind is
    looked for behind its ``export *`` lines, the first line that resolves wins (``way`` keeps their order)."""
    keys = ["path", "name", "outside"]
    open_ = queries.select(*keys).distinct().select(*keys, F.col("path").alias("p"), F.col("name").alias("n"), F.col("outside").alias("o"), F.array().cast("array<int>").alias("way"))
    b = bindings.select(F.col("path").alias("p"), F.col("name").alias("n"), "inner", "kind", "tpath", "tname", "next_outside")
    behind = stars.select(F.col("path").alias("p"), F.col("ord").alias("_s"), F.col("target").alias("_t"))
    done = None
    for hop in range(MAX_HOPS + 1):
        # what a hop meets is written once, for the names that end there and for those that go on
        bound = F.col("inner") | F.col("o")
        met = stored(open_.join(b, ["p", "n"], "left").select(
            *keys, "p", "n", "o", "way", F.when(bound, F.col("kind")).alias("kind"), "tpath", "tname", "next_outside").filter("kind IS NOT NULL OR o"))
        ended = met.filter("kind IS NOT NULL AND kind <> 'follow'").select(*keys, "way", "kind", "tpath", "tname")
        done = ended if done is None else done.unionByName(ended)
        if hop == MAX_HOPS or met.filter("kind IS NULL OR kind = 'follow'").isEmpty():
            break
        onward = met.filter("kind = 'follow'").select(*keys, F.col("tpath").alias("p"), F.col("tname").alias("n"), F.col("next_outside").alias("o"), "way")
        starred = met.filter("kind IS NULL AND o").join(behind, "p").select(*keys, F.col("_t").alias("p"), "n", "o", F.concat("way", F.array(F.col("_s"))).alias("way"))
        open_ = onward.unionByName(starred)
    return done.groupBy(*keys).agg(F.min_by(F.struct("kind", "tpath", "tname"), "way").alias("r")).select(*keys, "r.*")


def call_edges(facts: DataFrame, bindings: DataFrame, stars: DataFrame) -> DataFrame:
    """Distinct resolved calls; local variables and unknown receivers resolve to nothing."""
    calls = stored(facts.filter("fact = 'call'").select("path", F.col("owner").alias("caller_class"), F.col("name").alias("caller_name"), F.col("detail").alias("call"), "obj", "target").distinct())
    methods = facts.filter("fact = 'function' AND owner IS NOT NULL").select("path", "owner", "name").distinct()
    fields = facts.filter("fact = 'field'").groupBy("path", F.col("owner").alias("caller_class"), F.col("name").alias("obj")).agg(F.max_by("detail", "ord").alias("first"))
    asked = calls.filter("call = 'plain'").withColumn("first", F.col("target")).unionByName(calls.filter("call = 'attr'").withColumn("first", F.col("obj"))).unionByName(
        calls.filter("call = 'field'").join(fields, ["path", "caller_class", "obj"]).select(*calls.columns, "first"))
    inside = lambda df, n: df.select("path", F.col(n).alias("name"), F.lit(False).alias("outside"))
    seen = follow(inside(asked, "first"), bindings, stars)
    hit = stored(asked.join(seen.select("path", F.col("name").alias("first"), "kind", "tpath", "tname"), ["path", "first"]))
    # a called module means its default export; a member of a module is one of its exports
    second = hit.filter("kind = 'module' AND call IN ('plain', 'attr')").withColumn("second", F.when(F.col("call") == "plain", "default").otherwise(F.col("target")))
    outer = follow(second.select(F.col("tpath").alias("path"), F.col("second").alias("name"), F.lit(True).alias("outside")), bindings, stars)
    member = stored(second.drop("kind", "tname").join(outer.select(F.col("path").alias("tpath"), F.col("name").alias("second"), "kind", F.col("tpath").alias("_p"), "tname"), ["tpath", "second"], "left"))
    out = lambda df, m, c, n: df.select(F.col("path").alias("caller_module"), "caller_class", "caller_name", m.alias("callee_module"), c.alias("callee_class"), n.alias("callee_name"))
    null = F.lit(None).cast("string")
    own = calls.filter("call = 'this' AND caller_class IS NOT NULL").join(
        methods.select("path", F.col("owner").alias("caller_class"), F.col("name").alias("target")), ["path", "caller_class", "target"], "left_semi")
    functions = out(hit.filter("call = 'plain' AND kind = 'function'"), F.col("tpath"), null, F.col("tname")).unionByName(
        out(member.filter("kind = 'function'"), F.col("_p"), null, F.col("tname")))
    known = methods.select(F.col("path").alias("tpath"), F.col("owner").alias("tname"), F.col("name").alias("target"))
    on_class = hit.filter("call <> 'plain' AND kind = 'class'").join(known, ["tpath", "tname", "target"], "left_semi")
    # an unknown member of a module is the method of the only class there that has one
    sole = methods.groupBy("path", "name").agg(F.min("owner").alias("_c"), F.max("owner").alias("_c2")).filter("_c = _c2").select(F.col("path").alias("tpath"), F.col("name").alias("target"), "_c")
    lone = member.filter("call = 'attr' AND kind IS NULL").join(sole, ["tpath", "target"])
    return (out(own, F.col("path"), F.col("caller_class"), F.col("target")).unionByName(functions)
            .unionByName(out(on_class, F.col("tpath"), F.col("tname"), F.col("target"))).unionByName(out(lone, F.col("tpath"), F.col("_c"), F.col("target"))).distinct())


def _located(facts: DataFrame, files: DataFrame, config_files: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(known, targets): the script files, and the file each specifier names."""
    known = files.filter(F.col("path").rlike(r"\.(js|jsx|ts|tsx)$") & ~F.col("path").endswith(".d.ts")).select("path").distinct()
    wanted = facts.filter("fact IN ('import', 'reexport')").select("path", F.col("owner").alias("spec")).distinct()
    return known, resolve_specifiers(wanted, known, None if config_files is None else path_configs(config_files))


def resolve_imports(files: DataFrame, config_files: DataFrame | None = None) -> DataFrame:
    """Import edges of script files (path, content); names and calls are not looked at."""
    from codestrata.sources import script_source

    facts = stored(script_source.facts(files).filter("fact IN ('import', 'reexport')").select("path", "fact", "owner"))
    return import_edges(facts, _located(facts, files, config_files)[1])


def resolve(files: DataFrame, config_files: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, import edges, call edges) of script files (path, content)."""
    from codestrata.sources import script_source

    facts = stored(script_source.facts(files))
    known, targets = _located(facts, files, config_files)
    targets = stored(targets)
    bindings, stars = name_tables(facts, targets, known)
    return facts, import_edges(facts, targets), call_edges(facts, bindings, stars)
