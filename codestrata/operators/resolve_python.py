"""Python names across files: module index, import edges, re-exports, call targets. All joins.

Every lookup table has one row per key, so no join multiplies rows; hot names are handled by AQE's skew join on
the fact side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions.paths import dotted_name
from codestrata.session import cut_lineage

MAX_HOPS = 5  # re-exports followed


def _given(paths: DataFrame, by: tuple = ()) -> tuple[DataFrame, DataFrame]:
    """(name, path, _prio): full dotted names, and package names of ``__init__`` files."""
    full = paths.select(*by, dotted_name(F.col("path")).alias("name"), "path", F.lit(0).alias("_prio"))
    return full, full.filter(F.col("name").endswith(".__init__")).select(
        *by, F.regexp_replace("name", r"\.__init__$", "").alias("name"), "path", F.lit(1).alias("_prio"))


def _suffixes(named: DataFrame, by: tuple = ()) -> DataFrame:
    """(path, name): every shorter dotted suffix of a name."""
    pieces = F.split("name", r"\.")
    return named.select(*by, "path", F.explode(F.transform(
        F.sequence(F.lit(2), F.greatest(F.size(pieces), F.lit(2))), lambda i: F.array_join(F.slice(pieces, i, F.size(pieces)), "."))).alias("name")).filter(
        "name <> '' AND name <> '__init__'")


def claims(paths: DataFrame) -> DataFrame:
    """(name, path): every file a name may mean, whichever files stand beside it."""
    full, packages = _given(paths)
    named = full.unionByName(packages).select("path", "name")
    return named.unionByName(_suffixes(named)).distinct()


def module_index(paths: DataFrame, by: tuple = ()) -> DataFrame:
    """(name, path): what an import may call each file. Full dotted names come first, then package names of
    ``__init__`` files, then every shorter dotted suffix that exactly one file can claim. ``by`` adds leading keys, such as
    a revision, within which names are looked up."""
    full, packages = _given(paths, by)
    named = full.unionByName(packages).groupBy(*by, "name").agg(F.min_by("path", "_prio").alias("path"))
    suffixes = _suffixes(named, by)
    claims = suffixes.groupBy(*by, "name").agg(F.min("path").alias("path"), F.max("path").alias("_other"))
    unique = claims.filter(F.col("path") == F.col("_other")).select(*by, "name", "path").join(named, [*by, "name"], "left_anti")
    return named.unionByName(unique)


def _defined(facts: DataFrame, by: tuple = ()) -> DataFrame:
    """(path, name, kind): module-level functions and classes, functions first."""
    top = facts.filter("fact = 'function' AND owner IS NULL OR fact = 'class'")
    return top.groupBy(*by, "path", "name").agg(F.min(F.when(F.col("fact") == "function", 0).otherwise(1)).alias("_k")).select(
        *by, "path", "name", F.when(F.col("_k") == 0, "function").otherwise("class").alias("kind"))


def settled(imports: DataFrame, facts: DataFrame, claimed: DataFrame) -> DataFrame:
    """``imports`` with what they mean if that hangs on a file's being there alone: ``_open`` is true if a name of the import is
    claimed by several files, or if the stem's file may define what is imported. Else it means ``_stem`` and ``_sub``, each
    where it exists. ``claimed`` is ``claims`` of all files that stand anywhere."""
    wide = imports.withColumn("_full", F.when(F.col("name").isNotNull(), F.concat_ws(".", "owner", "name")))
    wanted = wide.select(F.explode(F.array("owner", "_full")).alias("name")).filter("name IS NOT NULL").distinct()
    one = claimed.join(wanted, "name", "left_semi").groupBy("name").agg(F.min("path").alias("path"), (F.min("path") != F.max("path")).alias("many"))
    for key, named in (("owner", "_stem"), ("_full", "_sub")):
        wide = wide.join(one.select(F.col("name").alias(key), F.col("path").alias(named), F.col("many").alias(f"{named}_many")), key, "left")
    taken = _defined(facts).select(F.col("path").alias("_stem"), "name", F.lit(True).alias("_taken"))
    several = F.coalesce("_stem_many", F.lit(False)) | F.coalesce("_sub_many", F.lit(False))
    return wide.join(taken, ["_stem", "name"], "left").withColumn("_open", several | (F.col("_sub").isNotNull() & F.col("_taken").isNotNull())).select(
        *imports.columns, "_full", "_stem", "_sub", "_open")


def _located(facts: DataFrame, index: DataFrame, defined: DataFrame, by: tuple = ()) -> DataFrame:
    """Imports with the file their stem names (``target``) and, when the imported name is a file of its own and
    not something the stem's file defines, that file (``sub``)."""
    imports = facts.filter("fact = 'import'").select(
        *by, "path", "ord", F.col("owner").alias("stem"), F.col("name").alias("imported"), F.col("detail").alias("alias"))
    stems = index.select(*by, F.col("name").alias("stem"), F.col("path").alias("target"))
    subs = index.select(*by, F.col("name").alias("_full"), F.col("path").alias("sub"))
    taken = defined.select(*by, F.col("path").alias("target"), F.col("name").alias("imported"), F.lit(True).alias("_taken"))
    j = imports.join(stems, [*by, "stem"], "left").withColumn("_full", F.concat_ws(".", "stem", "imported")).join(
        subs, [*by, "_full"], "left").join(taken, [*by, "target", "imported"], "left")
    return j.withColumn("sub", F.when(F.col("imported").isNotNull() & F.col("_taken").isNull(), F.col("sub"))).drop("_full", "_taken")


def import_edges(facts: DataFrame, index: DataFrame, by: tuple = ()) -> DataFrame:
    """Distinct (from, to) module edges without self edges."""
    located = _located(facts, index, _defined(facts, by), by)
    ends = located.select(*by, F.col("path").alias("from"), F.explode(F.array("target", "sub")).alias("to"))
    return ends.filter("to IS NOT NULL AND to <> `from`").distinct()


def _bindings(located: DataFrame, index: DataFrame) -> DataFrame:
    """(path, name, kind, tpath, tname): what imports bind in each module. The last resolving import of a name
    wins; ``import a.b.c`` also binds ``a`` and ``a.b`` unless something else does."""
    whole = located.filter("imported IS NULL AND alias IS NOT NULL AND target IS NOT NULL").select(
        "path", F.col("alias").alias("name"), "ord", F.lit("module").alias("kind"), F.col("target").alias("tpath"), F.lit(None).cast("string").alias("tname"))
    symbols = located.filter("imported IS NOT NULL AND alias IS NOT NULL AND (sub IS NOT NULL OR target IS NOT NULL)").select(
        "path", F.col("alias").alias("name"), "ord", F.when(F.col("sub").isNotNull(), "module").otherwise("symbol").alias("kind"),
        F.coalesce("sub", "target").alias("tpath"), F.when(F.col("sub").isNull(), F.col("imported")).alias("tname"))
    value = F.struct("kind", "tpath", "tname")
    direct = whole.unionByName(symbols).groupBy("path", "name").agg(F.max_by(value, "ord").alias("v"))
    pieces = F.split("stem", r"\.")
    prefixes = located.filter("imported IS NULL AND alias = stem").select("path", "ord", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(pieces)), lambda i: F.array_join(F.slice(pieces, F.lit(1), i), "."))).alias("name"), "stem").filter("name <> stem")
    owners = index.select("name", F.col("path").alias("tpath"))
    implied = prefixes.join(owners, "name").select("path", "name", F.struct(
        F.lit("module").alias("kind"), "tpath", F.lit(None).cast("string").alias("tname")).alias("v")).dropDuplicates(["path", "name"])
    return direct.unionByName(implied.join(direct, ["path", "name"], "left_anti")).select("path", "name", "v.*")


def name_table(facts: DataFrame, index: DataFrame) -> DataFrame:
    """(path, name) -> (kind, tpath, tname) with kind function, class or module: what a name means in a module
    once re-exports are followed. Each pass joins only the names still pointing at another module's name."""
    defined = _defined(facts)
    own = defined.select("path", "name", "kind", F.col("path").alias("tpath"), F.col("name").alias("tname"))
    bound = _bindings(_located(facts, index, defined), index).join(defined, ["path", "name"], "left_anti")
    table = cut_lineage(own.unionByName(bound))
    step = table.select(F.col("path").alias("tpath"), F.col("name").alias("tname"), F.col("kind").alias("_k"), F.col("tpath").alias("_p"), F.col("tname").alias("_n"))
    done, open_ = table.filter("kind <> 'symbol'"), table.filter("kind = 'symbol'")
    for _ in range(MAX_HOPS):
        # inner join: a name the target module does not know resolves to nothing
        moved = open_.join(step, ["tpath", "tname"]).select("path", "name", F.col("_k").alias("kind"), F.col("_p").alias("tpath"), F.col("_n").alias("tname"))
        done = done.unionByName(moved.filter("kind <> 'symbol'"))
        open_ = moved.filter("kind = 'symbol'")
    return done


def _callable(found: DataFrame, methods: DataFrame) -> DataFrame:
    """Callee columns for a resolved function, or the constructor of a resolved class that has one."""
    inits = methods.filter("name = '__init__'").select(F.col("path").alias("tpath"), F.col("owner").alias("tname"), F.lit(True).alias("_init"))
    j = found.join(inits, ["tpath", "tname"], "left").filter("kind = 'function' OR (kind = 'class' AND _init)")
    is_class = F.col("kind") == "class"
    return j.select("path", "caller_class", "caller_name", F.col("tpath").alias("callee_module"),
                    F.when(is_class, F.col("tname")).alias("callee_class"), F.when(is_class, "__init__").otherwise(F.col("tname")).alias("callee_name"))


def _method(found: DataFrame, methods: DataFrame) -> DataFrame:
    """Callee columns for ``target`` called on a resolved class that defines it."""
    known = methods.select(F.col("path").alias("tpath"), F.col("owner").alias("tname"), F.col("name").alias("target"))
    return found.filter("kind = 'class'").join(known, ["tpath", "tname", "target"], "left_semi").select(
        "path", "caller_class", "caller_name", F.col("tpath").alias("callee_module"), F.col("tname").alias("callee_class"), F.col("target").alias("callee_name"))


def call_edges(facts: DataFrame, index: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct resolved calls. Receivers that are local variables or of unknown class resolve to nothing."""
    calls = facts.filter("fact = 'call'").select("path", F.col("owner").alias("caller_class"), F.col("name").alias("caller_name"),
                                                 F.col("detail").alias("call"), "obj", "target").distinct()
    methods = facts.filter("fact = 'function' AND owner IS NOT NULL").select("path", "owner", "name").distinct()
    # names.name is looked up under different columns below
    def lookup(rows, module, name):
        return rows.join(names.select(F.col("path").alias(module), F.col("name").alias(name), "kind", "tpath", "tname"), [module, name])

    own = calls.filter("call = 'self' AND caller_class IS NOT NULL").join(
        methods.select("path", F.col("owner").alias("caller_class"), F.col("name").alias("target")), ["path", "caller_class", "target"], "left_semi").select(
        "path", "caller_class", "caller_name", F.col("path").alias("callee_module"), F.col("caller_class").alias("callee_class"), F.col("target").alias("callee_name"))
    plain = _callable(lookup(calls.filter("call = 'plain'"), "path", "target"), methods)
    fields = facts.filter("fact = 'field'").groupBy("path", F.col("owner").alias("caller_class"), F.col("name").alias("obj")).agg(F.max_by("detail", "ord").alias("type"))
    field = _method(lookup(calls.filter("call = 'field'").join(fields, ["path", "caller_class", "obj"]), "path", "type"), methods)
    received = _receivers(calls.filter("call = 'attr'"), index, names)
    on_module = lookup(received.filter("kind = 'module'").select("path", "caller_class", "caller_name", F.col("tpath").alias("_m"), "target"), "_m", "target")
    attr = _callable(on_module, methods).unionByName(_method(received, methods))
    edges = own.unionByName(plain).unionByName(field).unionByName(attr)
    return edges.select(F.col("path").alias("caller_module"), "caller_class", "caller_name", "callee_module", "callee_class", "callee_name").distinct()


def _receivers(calls: DataFrame, index: DataFrame, names: DataFrame) -> DataFrame:
    """Calls with what their receiver is: the dotted text as a bound name, else its first part walked attribute
    by attribute through modules. One pass per dot actually written (their maximum is one number)."""
    known = names.select("path", F.col("name").alias("obj"), "kind", "tpath", "tname")
    direct = calls.join(known, ["path", "obj"])
    rest = calls.filter(F.col("obj").contains(".")).join(known, ["path", "obj"], "left_anti")
    deepest = rest.agg(F.max(F.size(F.split("obj", r"\.")))).first()[0]
    if deepest is None:
        return direct
    head = names.select("path", F.col("name").alias("_part"), "kind", "tpath", "tname")
    walk = rest.withColumn("_part", F.substring_index("obj", ".", 1)).join(head, ["path", "_part"]).withColumn("_at", F.lit(1))
    sub = index.select(F.col("name").alias("_full"), F.col("path").alias("_sub"))
    member = names.select(F.col("path").alias("tpath"), F.col("name").alias("_part"), F.col("kind").alias("_k"), F.col("tpath").alias("_p"), F.col("tname").alias("_n"))
    finished = direct
    for at in range(1, deepest):
        left = walk.filter((F.size(F.split("obj", r"\.")) > at) & (F.col("kind") == "module")).withColumn(
            "_part", F.get(F.split("obj", r"\."), F.lit(at))).withColumn(
            "_full", F.concat(F.regexp_replace(dotted_name(F.col("tpath")), r"\.__init__$", ""), F.lit("."), "_part"))
        moved = left.join(member, ["tpath", "_part"], "left").join(sub, "_full", "left").filter("_k IS NOT NULL OR _sub IS NOT NULL")
        step = moved.select(*calls.columns, F.coalesce("_k", F.lit("module")).alias("kind"), F.coalesce("_p", "_sub").alias("tpath"), F.col("_n").alias("tname"))
        finished = finished.unionByName(step.filter(F.size(F.split("obj", r"\.")) == at + 1).select(*finished.columns))
        walk = step
    return finished
