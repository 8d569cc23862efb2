"""What part of a repository is analysed: language mix, noise, folder groups under a file budget."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions import paths
from codestrata.session import cut_lineage

# Folders whose children are separate packages.
CONTAINERS = ("packages", "apps", "libs", "services", "modules", "plugins", "projects", "workspaces")


def language_of(path: Column) -> Column:
    return F.when(path.endswith(".py"), "python").when(path.rlike(r"\.tsx?$"), "typescript").otherwise("javascript")


def initial_group(path: Column, base_depth: int = 0) -> Column:
    """Folder a file is first counted under: the first level below the base (the second inside a container
    folder), or ``<folder>/*`` for files directly at the base."""
    dirs = paths.folders(path)
    below = F.size(dirs) - base_depth
    container = F.lower(F.get(dirs, F.lit(base_depth))).isin(*CONTAINERS)
    depth = F.lit(base_depth) + F.when(container & (below >= 2), 2).otherwise(1)
    return F.when(below <= 0, F.array_join(F.concat(dirs, F.array(F.lit("*"))), "/")).otherwise(
        F.array_join(F.slice(dirs, F.lit(1), depth), "/"))


def deeper_group(path: Column, group: Column) -> Column:
    """The group one folder deeper, or the files directly inside when there is no deeper folder."""
    dirs = paths.folders(path)
    depth = F.size(F.split(group, "/")) + 1
    return F.when(F.size(dirs) >= depth, F.array_join(F.slice(dirs, F.lit(1), depth), "/")).otherwise(
        F.concat(group, F.lit("/*")))


def split_groups(files: DataFrame, cap: int, base_depth: int = 0) -> DataFrame:
    """(group, files): folders split until each fits the cap (direct-file groups cannot be split).

    Counts roll up from distinct folders, which carry a file count, so the per-level work is on folders, not
    files. A level only re-splits groups that are still too big, and the loop ends when none is."""
    by_folder = files.select(paths.dirname(F.col("path")).alias("dir")).groupBy("dir").agg(F.count(F.lit(1)).alias("n"))
    sample = F.when(F.col("dir") == "", F.lit("x")).otherwise(F.concat("dir", F.lit("/x")))
    assigned = by_folder.select(sample.alias("path"), "n", initial_group(sample, base_depth).alias("group"))
    while True:
        counts = assigned.groupBy("group").agg(F.sum("n").alias("files"))
        big = counts.filter((F.col("files") > cap) & ~F.col("group").endswith("*")).select("group")
        if big.isEmpty():
            return counts
        marked = assigned.join(big.withColumn("_big", F.lit(True)), "group", "left")
        # written between levels, so a deep tree does not become one long plan
        assigned = cut_lineage(marked.select("path", "n", F.when(F.col("_big"), deeper_group(F.col("path"), F.col("group")))
                                 .otherwise(F.col("group")).alias("group")))


def pick_groups(groups: DataFrame, cap: int) -> DataFrame:
    """(group, files, chosen): largest first while they fit the cap; a group that does not fit is skipped and
    smaller ones still get their chance. One oversized folder alone is taken anyway.

    Groups of one size are interchangeable for the budget: once one does not fit, none of that size does. So the
    greedy pass folds over the distinct sizes up to the cap (at most ``cap`` of them, however many groups there
    are), and the groups taken of each size are its first ones by name."""
    sizes = groups.filter(F.col("files") <= cap).groupBy("files").agg(F.count(F.lit(1)).alias("n"))
    ordered = F.sort_array(F.collect_list(F.struct("files", "n")), asc=False)
    fold = F.aggregate(
        "all", F.struct(F.lit(cap).cast("bigint").alias("left"), F.array().cast("array<struct<files: bigint, take: bigint>>").alias("taken")),
        lambda acc, x: F.struct(
            (acc["left"] - x["files"] * F.least(x["n"], F.floor(acc["left"] / x["files"]))).cast("bigint").alias("left"),
            F.concat(acc["taken"], F.array(F.struct(x["files"].alias("files"), F.least(x["n"], F.floor(acc["left"] / x["files"])).cast("bigint").alias("take")))).alias("taken")),
        lambda acc: acc["taken"])
    taken = sizes.agg(ordered.alias("all")).select(F.explode(fold).alias("t")).select("t.files", "t.take").filter("take > 0")
    # no more than ``cap`` groups of a size can be taken, which trims the ranking inside each task
    first = groups.withColumn("_n", F.row_number().over(Window.partitionBy("files").orderBy("group"))).filter(F.col("_n") <= cap)
    chosen = first.join(F.broadcast(taken), "files").filter(F.col("_n") <= F.col("take")).select("group")
    alone = groups.agg(F.min_by("group", F.struct(-F.col("files"), F.col("group"))).alias("group"), F.min("files").alias("_least")).filter(
        F.col("_least") > cap).select("group")
    marked = chosen.unionByName(alone).withColumn("_in", F.lit(True))
    return groups.join(marked, "group", "left").select("group", "files", F.col("_in").isNotNull().alias("chosen"))


def choose(files: DataFrame, subdir: str = "", large_files: int = 3000, cap: int = 3000) -> dict:
    """The analysis scope: everything up to ``large_files`` source files; beyond that noise is dropped (unless
    nothing else is left) and folders are picked under the cap. Only counts and group names reach the driver."""
    kept = files.filter(paths.is_source(F.col("path")) & ~paths.in_skipped_folder(F.col("path")))
    if subdir:
        kept = kept.filter(F.col("path").startswith(subdir + "/"))
    total, quiet = kept.agg(F.count(F.lit(1)), F.count_if(~paths.is_noise(F.col("path")))).first()
    if not total:
        raise ValueError("no supported source files here")
    scope = {"subdir": subdir, "large": total > large_files, "skip_noise": False, "groups": [], "groups_skipped": [],
             "files_total": total, "files_included": total, "noise_skipped": 0}
    if total <= large_files:
        return scope
    if quiet:
        kept = kept.filter(~paths.is_noise(F.col("path")))
        scope.update(skip_noise=True, noise_skipped=total - quiet, files_included=quiet)
    if scope["files_included"] > cap:
        picked = pick_groups(split_groups(kept, cap, len(subdir.split("/")) if subdir else 0), cap).collect()
        scope["groups"] = [r["group"] for r in picked if r["chosen"]]
        scope["groups_skipped"] = [(r["group"], r["files"]) for r in picked if not r["chosen"]]
        scope["files_included"] = sum(r["files"] for r in picked if r["chosen"])
    return scope


def includes(path: Column, scope: dict) -> Column:
    """The scope as a predicate."""
    keep = F.lit(True)
    if scope["subdir"]:
        keep = keep & path.startswith(scope["subdir"] + "/")
    if scope["skip_noise"]:
        keep = keep & ~paths.is_noise(path)
    if scope["groups"]:
        keep = keep & reduce(lambda a, b: a | b, [paths.in_group(path, F.lit(g)) for g in scope["groups"]])
    return keep
