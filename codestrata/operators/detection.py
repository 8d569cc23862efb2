"""All decision detectors over one history, as one relation.

Positions order the commits of a first-parent history; snapshots are a sample of positions. What changed between two
snapshots (a folder, a violation) is pinned to the first commit of the gap between them that shows it: every touched file and
file version is given its gap first, so the pin is an equi-join and a ``min_by``, never a range join over the history.

Relations: commits (hash, pos, date), touched (hash, pos, ord, path, old_path, status), snapshots (idx, pos), consecutive
and few."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions import paths
from codestrata.operators import decisions, temporal
from codestrata.session import dealt, stored

SHAPE = ["sha", "kind", "subject", "significance", "n_files", "packages"]


def with_gap(rows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``rows`` with ``idx``, the snapshot that first holds their position; rows after the last snapshot go. The list of
    snapshots is one small array beside every row."""
    ends = snapshots.agg(F.sort_array(F.collect_list("pos")).alias("_ends"))
    placed = rows.join(F.broadcast(ends)).withColumn("idx", F.size(F.filter("_ends", lambda end: end < F.col("pos"))).cast("bigint"))
    return placed.filter(F.col("idx") < F.size("_ends")).drop("_ends")


def _shaped(rows: DataFrame) -> DataFrame:
    packages = F.col("packages") if "packages" in rows.columns else F.array().cast("array<string>")
    return rows.select(*[c for c in SHAPE if c != "packages"], packages.alias("packages"))


def infrastructure_decisions(touched: DataFrame, excluded: Column, counts: DataFrame | None = None) -> DataFrame:
    """The first commit that brings in each kind of infrastructure. ``counts`` is what ``commit_counts`` gives, if it is known."""
    counts = decisions.commit_counts(touched) if counts is None else counts
    first = decisions.infrastructure(touched.filter(~excluded), ["pos", "ord"])
    return _shaped(first.join(counts.select(F.col("hash").alias("sha"), "n_files"), "sha").select(
        "sha", F.lit("infrastructure").alias("kind"), F.concat(F.lit("Introduce "), "label").alias("subject"), F.lit(1.0).alias("significance"), "n_files"))


def _folders_above(path: Column) -> Column:
    """The folders a module group can be named after that hold this path: its first one and its first two."""
    parts = paths.parts(path)
    return F.filter(F.array(F.when(F.size(parts) >= 2, F.get(parts, F.lit(0))), F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, 1, 2), "/"))),
                    lambda folder: folder.isNotNull())


def structure_decisions(modules: DataFrame, touched: DataFrame, snapshots: DataFrame, excluded: Column) -> DataFrame:
    """Module groups that appear or vanish, pinned to the first commit of the gap that adds (deletes) a file below the
    folder. ``modules`` is (idx, path), the files of each snapshot; changes without such a commit are left out."""
    last = snapshots.agg(F.max("idx").alias("last"))
    # one pass over the files counts those of each group and those below each folder a group can be
    top = F.when(~excluded, decisions.top_folder(F.col("path")))
    above = modules.select("idx", "path").distinct().select("idx", top.alias("_top"), F.explode(_folders_above(F.col("path"))).alias("folder"))
    counts = stored(above.groupBy("folder", "idx").agg(F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("_top") == F.col("folder")).alias("n")))
    changes = decisions.count_changes(counts.filter("n > 0").select("folder", "idx", "n"), last)
    status = F.when(F.col("change") == "appeared", "A").otherwise("D")
    wanted = changes.withColumn("status", status).withColumn("held", F.when(F.col("change") == "appeared", F.col("idx")).otherwise(F.col("idx") - 1))
    below = with_gap(touched.filter("status in ('A', 'D')").select("hash", "pos", "status", "path"), snapshots).select(
        "hash", "pos", "idx", "status", F.explode(_folders_above(F.col("path"))).alias("folder"))
    # folders that hold most files are one row a task before they are dealt out
    pinned = below.groupBy("folder", "idx", "status").agg(F.min_by("hash", "pos").alias("sha"))
    files = counts.select("folder", F.col("idx").alias("held"), "n_files")
    verb = F.when(F.col("change") == "appeared", "Introduce").otherwise("Remove")
    return _shaped(wanted.join(pinned, ["folder", "idx", "status"]).join(files, ["folder", "held"]).select(
        "sha", F.lit("structure").alias("kind"), F.format_string("%s the %s/ module group (%d modules)", verb, "folder", "n").alias("subject"),
        F.round(0.8 + 0.1 * F.least("n", F.lit(10)), 3).alias("significance"), "n_files"))


def occurrences(text: Column, needle: Column) -> Column:
    """How often a needle stands in a text, without overlaps; a missing text holds none."""
    return F.coalesce(((F.length(text) - F.length(F.replace(text, needle))) / F.length(needle)).cast("bigint"), F.lit(0).cast("bigint"))


def needle_changes(versions: DataFrame, needles: DataFrame) -> DataFrame:
    """(path, needle, hash, pos, idx): versions that hold a needle more or less often than the path's version before.

    ``versions`` is (hash, pos, idx, path, content), ``needles`` distinct (path, needle). Each version is read once with all of its
    path's needles, which leave it as an array of counts; arrays are compared along the path's versions, and only a needle whose
    count changes becomes a row. A deleted file is a version without content."""
    asked = needles.groupBy("path").agg(F.collect_set("needle").alias("needles"))  # of one file's changed neighbours
    # a task holds the needles of its paths, one row a path, and sorts versions only once, for the comparison
    counted = versions.join(asked.hint("shuffle_hash"), "path").withColumn("_n", F.transform("needles", lambda needle: occurrences(F.col("content"), needle)))
    before = F.coalesce(F.lag("_n").over(Window.partitionBy("path").orderBy("pos")), F.transform("needles", lambda _: F.lit(0).cast("bigint")))
    changed = F.filter(F.arrays_zip("needles", "_n", "_before"), lambda pair: pair["_n"] != pair["_before"])
    return (counted.drop("content").withColumn("_before", before).select("path", "hash", "pos", "idx", F.explode(changed).alias("_c"))
            .select("path", F.col("_c.needles").alias("needle"), "hash", "pos", "idx"))


def violation_decisions(presence: DataFrame, versions: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Violations that appear or go between snapshots, one decision for each rule, caller and callee module, pinned to the first
    commit of the gap that changes how often the caller's text names the callee.

    ``presence`` is (idx, rule_name, caller_module, caller_class, caller_name, callee_module, callee_class, callee_name)."""
    keys = ["rule_name", "caller_module", "caller_class", "caller_name", "callee_module", "callee_class", "callee_name"]
    between = ["rule_name", "caller_module", "callee_module"]
    # dealt once for the differences and for the groups made of them
    known = dealt(presence.select("idx", *[F.coalesce(F.col(k), F.lit("")).alias(k) for k in keys]), *between)
    changed = temporal.diffs(known, keys, snapshots.agg(F.max("idx").alias("last")))
    group = ["idx", "change", *between]
    first = changed.groupBy(*group).agg(F.min_by("callee_name", F.struct("caller_class", "caller_name", "callee_class", "callee_name")).alias("_name"))
    file = paths.basename(F.col("callee_module"))
    stem = F.regexp_replace(file, r"(?<=.)\.[^.]*$", "")
    needle = F.when(F.col("_name") != "", F.col("_name")).otherwise(stem)
    wanted = stored(first.select(*group, needle.alias("needle"), F.col("caller_module").alias("path")))  # read for the needles and for the pins
    changes = needle_changes(with_gap(versions, snapshots), wanted.select("path", "needle").distinct())
    pinned = changes.groupBy("path", "needle", "idx").agg(F.min_by("hash", "pos").alias("sha"))
    added = F.col("change") == "added"
    return _shaped(wanted.join(pinned, ["path", "needle", "idx"]).select(
        "sha", F.when(added, "violation_introduced").otherwise("violation_resolved").alias("kind"),
        F.concat(F.when(added, "Introduce ").otherwise("Resolve "), "rule_name", F.lit(": "), "caller_module", F.lit(" -> "), "callee_module").alias("subject"),
        F.lit(0.9).alias("significance"), F.when(F.col("caller_module") == F.col("callee_module"), 1).otherwise(2).cast("bigint").alias("n_files")))


def unusable(touched: DataFrame, excluded: Column) -> DataFrame:
    """(hash) of commits that touch only excluded files; they can be no decision."""
    return touched.groupBy("hash").agg(F.min(excluded).alias("_all")).filter("_all").select("hash")


def detect(commits: DataFrame, touched: DataFrame, snapshots: DataFrame, modules: DataFrame, presence: DataFrame, versions: DataFrame,
           dependencies: DataFrame, patterns: tuple[str, ...] = (), name: Column | None = None) -> DataFrame:
    """(id, sha, date, kind, subject, significance, n_files, packages) of all detectors. ``dependencies`` are the decisions of
    manifest changes (sha, kind, subject, significance, packages). Paths that match ``patterns`` are excluded. Shorter keys may stand for
    hashes everywhere; ``name`` makes the hash of a key ``sha``.

    Each detector is written before the next begins, and its shuffles go with it: the disk holds those of one at a time. What the
    detectors ask of a commit is counted once."""
    excluded = decisions.excluded(F.col("path"), list(patterns)) if patterns else F.lit(False)
    if patterns:
        gone = stored(unusable(touched, excluded))
        commits, touched, versions = (df.join(gone, "hash", "left_anti") for df in (commits, touched, versions))
    counts = stored(decisions.commit_counts(dealt(touched.select("hash", "path", "old_path"), "hash")))
    dates = commits.select(F.col("hash").alias("sha"), "date")

    def dated(rows: DataFrame) -> DataFrame:
        return stored(rows.join(dates, "sha"))

    sizes = counts.select(F.col("hash").alias("sha"), "n_files")
    found = [
        # left as they are dealt by commit, the dependencies meet counts and dates where they are
        dated(_shaped(dependencies.join(sizes, "sha", "left").na.fill(0, ["n_files"]))),
        dated(infrastructure_decisions(touched, excluded, counts)),
        dated(structure_decisions(modules, touched, snapshots, excluded)),
        dated(_shaped(decisions.restructures(touched, counts=counts))),
        dated(violation_decisions(presence, versions, snapshots)),
    ]
    united = reduce(DataFrame.unionByName, found)
    if name is not None:
        united = united.withColumn("sha", name)
    return united.select(
        decisions.decision_id(F.col("sha"), F.col("kind"), F.col("subject")).alias("id"), "sha", "date", "kind", "subject", "significance", "n_files", "packages")
