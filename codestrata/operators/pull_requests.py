"""Pull requests and issues behind commits: message references, merge reachability, withheld texts, branches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.text import clean_body
from codestrata.session import cut_lineage

MERGE_DAYS_BEFORE, MERGE_DAYS_AFTER = 1, 60
# How messages name pull requests and issues.
SQUASH = r"\(#(\d{1,7})\)\s*$"
MERGE = r"^Merge pull request #(\d{1,7})\b"
REFERENCE = r"(?<![\w&/])#(\d{1,7})\b"


def message_refs(subject: Column, body: Column, own: Column | None = None, limit: int | None = None) -> Column:
    """Numbers a commit points at, most specific first: its own merge, a squash suffix, a merge subject, then
    every reference; the first ``limit`` of them if one is given."""
    one = lambda pattern: F.regexp_extract_all(subject, F.lit(pattern), F.lit(1))
    everywhere = F.regexp_extract_all(F.concat_ws("\n", subject, body), F.lit(REFERENCE), F.lit(1))
    refs = F.transform(F.concat(one(SQUASH), one(MERGE), everywhere), lambda n: n.cast("bigint"))
    if own is not None:
        refs = F.concat(F.filter(F.array(own.cast("bigint")), lambda n: n.isNotNull()), refs)
    return F.array_distinct(refs) if limit is None else F.slice(F.array_distinct(refs), 1, limit)


def merge_numbers(merges: DataFrame) -> DataFrame:
    """(hash, first, second, date, number) of two-parent pull-request merges."""
    number = F.regexp_extract("subject", MERGE, 1)
    return merges.filter((F.size("parents") == 2) & (number != "")).select(
        "hash", F.get("parents", F.lit(0)).alias("first"), F.get("parents", F.lit(1)).alias("second"), "date", number.cast("bigint").alias("number"))


def merges_near(merges: DataFrame, commits: DataFrame) -> DataFrame:
    """Merges that could have brought these commits in: from a day before the earliest to sixty days after the
    latest (the range of the commits is one row)."""
    span = commits.agg(F.date_sub(F.min("date").cast("date"), MERGE_DAYS_BEFORE).alias("_a"), F.date_add(F.max("date").cast("date"), MERGE_DAYS_AFTER).alias("_b"))
    return merges.join(F.broadcast(span)).filter((F.col("date").cast("date") >= F.col("_a")) & (F.col("date").cast("date") <= F.col("_b"))).drop("_a", "_b")


def commits_of_merges(merges: DataFrame, parents: DataFrame) -> DataFrame:
    """(hash, number): commits reachable from a merge's second parent and not from its first. ``parents`` is
    (hash, parent). All merges walk together, one join per step over the commits still open, written between
    steps; the walk stops when nothing is open."""
    def walk(start: str) -> DataFrame:
        seen = open_ = cut_lineage(merges.select("number", F.col(start).alias("hash")))
        while not open_.isEmpty():
            after = open_.join(parents, "hash").select("number", F.col("parent").alias("hash")).distinct()
            open_ = cut_lineage(after.join(seen, ["number", "hash"], "left_anti"))
            seen = seen.unionByName(open_)
        return seen

    brought = walk("second").join(walk("first"), ["number", "hash"], "left_anti")
    # a commit belongs to the first merge that brought it
    return brought.groupBy("hash").agg(F.min("number").alias("number"))


def visible_texts(texts: DataFrame, masked_paths: list[str]) -> DataFrame:
    """Texts with cleaned bodies, without those that mention a path left out of the analysis."""
    cleaned = texts.withColumn("body", clean_body(F.col("body")))
    for prefix in [p.rstrip("/*") for p in masked_paths if p.rstrip("/*")]:
        cleaned = cleaned.filter(~F.concat_ws("\n", "title", "body").contains(prefix))
    return cleaned


def attach(commits: DataFrame, texts: DataFrame) -> DataFrame:
    """(hash, number, title, body) for each referenced text that is available. ``commits`` has ``refs``."""
    wanted = commits.select("hash", F.posexplode("refs").alias("ref_ord", "number"))
    return wanted.join(texts, "number")


def split_branch(urls: DataFrame, branches: DataFrame) -> DataFrame:
    """(rest, branch, folder): the longest branch a folder URL's tail starts with. Candidate prefixes are
    generated per URL and joined by equality, not by a prefix comparison of every pair."""
    pieces = F.split("rest", "/")
    prefixes = urls.select("rest", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(pieces)), lambda i: F.array_join(F.slice(pieces, F.lit(1), i), "/"))).alias("branch"))
    best = prefixes.join(branches.select("branch").distinct(), "branch").groupBy("rest").agg(F.max_by("branch", F.length("branch")).alias("branch"))
    return urls.join(best, "rest", "left").select("rest", "branch", F.expr("trim('/' from substr(rest, length(branch) + 2))").alias("folder"))


def ancestors(parents: DataFrame, head: str, max_steps: int) -> DataFrame:
    """(hash, step): commits reachable from ``head`` in at most ``max_steps`` steps with the fewest steps."""
    seen = open_ = cut_lineage(parents.sparkSession.range(1).select(F.lit(head).alias("hash"), F.lit(0).alias("step")))
    for step in range(1, max_steps + 1):
        after = open_.join(parents, "hash").select(F.col("parent").alias("hash"), F.lit(step).alias("step")).distinct()
        open_ = cut_lineage(after.join(seen, "hash", "left_anti"))
        if open_.isEmpty():
            break
        seen = seen.unionByName(open_)
    return seen
