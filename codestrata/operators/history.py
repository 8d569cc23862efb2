"""Who changed what, when: aggregates over commits and the files they touched.

``commits`` is (hash, idx or any order columns, author, author_id, date, subject...), ``touched`` is
(hash, path, old_path, added, deleted). ``order`` names the columns that put commits oldest first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BULK_COMMIT_FILES = 100


def line_totals(touched: DataFrame) -> DataFrame:
    """Files and changed lines per commit."""
    return touched.groupBy("hash").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum(F.col("added") + F.col("deleted")).alias("lines"))


def with_bulk_flag(commits: DataFrame, touched: DataFrame, bulk_files: int = BULK_COMMIT_FILES) -> DataFrame:
    """Commits with their file count and whether they are bulk changes (no evidence of anything)."""
    counts = touched.groupBy("hash").agg(F.count(F.lit(1)).alias("n_files"))
    return commits.join(counts, "hash", "left").withColumn(
        "n_files", F.coalesce("n_files", F.lit(0)).cast("bigint")).withColumn("bulk", F.col("n_files") > bulk_files)


def contributors_by_id(commits: DataFrame, touched: DataFrame, order: list[str], top: int = 10) -> DataFrame:
    """Commits and changed lines per author id, under the name first seen. Lines are summed per commit before
    the join, so the join side has one row per commit."""
    lines = line_totals(touched).select("hash", "lines")
    return (
        commits.join(lines, "hash", "left")
        .groupBy("author_id")
        .agg(F.min_by("author", F.struct(*order)).alias("name"), F.count(F.lit(1)).alias("commits"),
             F.sum(F.coalesce("lines", F.lit(0))).alias("lines"))
        .orderBy(F.desc("commits"), "name", "author_id").limit(top)
    )


def contributors_by_name(commits: DataFrame, top: int = 15) -> DataFrame:
    """Per display name: people sharing a name are one row here."""
    return (
        commits.groupBy(F.col("author").alias("name"))
        .agg(F.count(F.lit(1)).alias("commits"), F.min("date").alias("first"), F.max("date").alias("last"))
        .orderBy(F.desc("commits"), "name").limit(top)
    )


def commits_touching(commits: DataFrame, touched: DataFrame, path: str) -> DataFrame:
    """Commits that modified one path, with the lines of each. The path filter runs in the touched scan."""
    lines = touched.filter(F.col("path") == path).groupBy("hash").agg(
        F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))
    return commits.join(lines, "hash")


def commits_naming(commits: DataFrame, touched: DataFrame, suffix: str) -> DataFrame:
    """Fallback for a path that is no current module: exact or trailing match of a touched file."""
    hit = touched.filter((F.col("path") == suffix) | F.col("path").endswith("/" + suffix)).select("hash").distinct()
    return commits.join(hit, "hash", "left_semi")


def introduced(commits: DataFrame, touched: DataFrame, order: list[str]) -> DataFrame:
    """path -> the oldest commit touching it (a rename introduces its new path)."""
    when = commits.select("hash", *[c for c in order if c != "hash"], "date")
    return (
        touched.select("hash", "path").join(when, "hash")
        .groupBy("path").agg(F.min_by(F.struct("hash", "date"), F.struct(*order)).alias("_first"))
        .select("path", F.col("_first.hash").alias("introduced_sha"), F.col("_first.date").alias("introduced_at"))
    )


def modified_edges(touched: DataFrame, modules: DataFrame, commits: DataFrame, order: list[str],
                   per_commit: int | None = None, newest: int | None = None) -> DataFrame:
    """MODIFIED relations of the graph: touched paths that are modules now. A sink with limits of its own asks for at
    most ``per_commit`` files of one commit or the ``newest`` latest rows (``order[0]`` is the date).

    The per-commit rank is trimmed inside each task. The overall limit first drops whole days older than the
    one where the limit is reached (counts per day are bounded by the calendar), then numbers what is left with
    a distributed sort, since a top-k of this size would gather every task's rows in one place."""
    from codestrata.session import global_index

    kept = touched.join(modules.select("path"), "path", "left_semi")
    columns = ["hash", "path", "added", "deleted"]
    if per_commit is None and newest is None:
        return kept.select(*columns)
    order_in_commit = Window.partitionBy("hash").orderBy("path", "old_path", "added", "deleted")
    kept = kept.withColumn("_n", F.row_number().over(order_in_commit))
    if per_commit is not None:
        kept = kept.filter(F.col("_n") <= per_commit)
    if newest is None:
        return kept.select(*columns)
    dated = kept.join(commits.select("hash", *[c for c in order if c != "hash"]), "hash")
    day = order[0]
    per_day = dated.groupBy(day).agg(F.count(F.lit(1)).alias("_rows"))
    later = F.sum("_rows").over(Window.orderBy(F.desc(day)).rowsBetween(Window.unboundedPreceding, -1))
    oldest = per_day.withColumn("_later", F.coalesce(later, F.lit(0))).filter(F.col("_later") < newest).agg(F.min(day).alias("_oldest"))
    recent = dated.join(F.broadcast(oldest)).filter(F.col(day) >= F.col("_oldest")).drop("_oldest")
    ranked = global_index(recent, [*[F.desc(c) for c in order], F.col("_n")], "_rank")
    return ranked.filter(F.col("_rank") < newest).select(*columns)


def latest_names(commits: DataFrame, order: list[str]) -> DataFrame:
    """Developer nodes: the name on an author's last commit wins."""
    return commits.groupBy(F.col("author_id").alias("id")).agg(F.max_by("author", F.struct(*order)).alias("name"))


def file_authors(history: DataFrame, top: int = 8) -> DataFrame:
    return history.groupBy(F.col("author").alias("name")).agg(F.count(F.lit(1)).alias("commits")).orderBy(
        F.desc("commits"), "name").limit(top)


def commit_by_prefix(commits: DataFrame, prefix: str) -> DataFrame:
    """Commits whose hash starts with at least four given characters; ``candidates`` counts them, so a prefix that
    names several is seen to be ambiguous. The filter on the hash reaches the commits before anything else."""
    ref = prefix.lower().strip("[]")
    if len(ref) < 4:
        raise ValueError("give at least 4 characters of the commit hash")
    return commits.filter(F.col("hash").startswith(ref)).withColumn("candidates", F.count(F.lit(1)).over(Window.partitionBy()))


def commit_files(found: DataFrame, touched: DataFrame, shown: int = 30) -> DataFrame:
    """(hash, files_changed, files): for each found commit its own files, the first ``shown`` by name listed."""
    own = touched.join(found.select("hash"), "hash", "left_semi")
    total = own.groupBy("hash").agg(F.count(F.lit(1)).alias("files_changed"))
    first = own.withColumn("_n", F.row_number().over(Window.partitionBy("hash").orderBy("path"))).filter(F.col("_n") <= shown)
    listed = first.groupBy("hash").agg(F.array_join(F.sort_array(F.collect_list("path")), ", ").alias("files"))
    return total.join(listed, "hash")


def with_fallback_metadata(wanted: DataFrame, mined: DataFrame, fallback: DataFrame, columns: list[str]) -> DataFrame:
    """Metadata for hashes that may be missing from the mined window (merges are mined separately)."""
    a = mined.select("hash", *[F.col(c).alias("_a_" + c) for c in columns])
    b = fallback.select("hash", *[F.col(c).alias("_b_" + c) for c in columns])
    return wanted.join(a, "hash", "left").join(b, "hash", "left").select(
        *wanted.columns, *[F.coalesce("_a_" + c, "_b_" + c).alias(c) for c in columns])


def without_boundary(commits: DataFrame, boundary: DataFrame) -> DataFrame:
    """Drops commits where a shallow clone cut the history: they seem to add every file."""
    return commits.join(boundary.select("hash"), "hash", "left_anti")


def resolve_range(chain: DataFrame, head: Column, base: Column | None, count: int, empty_tree: str) -> DataFrame:
    """One-row (head, base, empty_base): the explicit base when it is an ancestor on the chain, else the
    commit ``count`` steps back, else the empty tree. ``chain`` is (hash, step) with step 0 at the head."""
    wanted = base if base is not None else F.lit(None).cast("string")
    return chain.agg(
        F.max(F.when(F.col("hash") == wanted, F.col("hash"))).alias("_explicit"),
        F.max(F.when(F.col("step") == count, F.col("hash"))).alias("_back"),
    ).select(head.alias("head"), F.coalesce("_explicit", "_back", F.lit(empty_tree)).alias("base"),
             (F.col("_explicit").isNull() & F.col("_back").isNull()).alias("empty_base"),
             (wanted.isNotNull() & F.col("_explicit").isNull()).alias("fell_back"))
