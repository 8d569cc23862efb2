"""Reading and searching source text: (path, content) rows, lines as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.session import running_total
from codestrata.sources.gitlog import numbered_lines

MAX_SEARCH_HITS = 20
LINES_PER_READ = 120
READ_MAX_CHARS = 3000


def search_lines(files: DataFrame, text: str) -> DataFrame:
    """(path, line_no, line) of every line containing the text, case-insensitive. Files without it are dropped
    before their lines are exploded."""
    if len(text) < 2:
        raise ValueError("query must be at least 2 characters")
    needle = text.lower()
    hit = files.filter(F.lower("content").contains(needle))
    return numbered_lines(hit, ["path"]).filter(F.lower("line").contains(needle)).withColumn(
        "line", F.trim("line"))


def search_summary(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count(F.lit(1)).alias("total_matches"), F.count_distinct("path").alias("files_with_matches"))


def first_hits(hits: DataFrame, limit: int = MAX_SEARCH_HITS) -> DataFrame:
    return hits.orderBy("path", "line_no").limit(limit).select(
        F.concat("path", F.lit(":L"), F.col("line_no").cast("string")).alias("location"), "line")


def read_lines(files: DataFrame, path: str, start: int = 1, end: int | None = None) -> DataFrame:
    """Numbered lines of one file from ``start``, at most 120 of them and 3,000 characters with the gutter. The
    windows below cover those lines of a single file."""
    lines = numbered_lines(files.filter(F.col("path") == path), ["path"])
    total = lines.agg(F.max("line_no").alias("total"))
    first = F.greatest(F.lit(1), F.least(F.lit(start), F.col("total")))
    wanted = F.lit(end) if end is not None else first + LINES_PER_READ - 1
    last = F.greatest(first, F.least(wanted, first + LINES_PER_READ - 1, F.col("total")))
    shown = lines.join(F.broadcast(total)).filter((F.col("line_no") >= first) & (F.col("line_no") <= last)).withColumn("_w", F.length(last.cast("string")))
    text = F.concat(F.lpad(F.col("line_no").cast("string"), F.col("_w"), F.lit(" ")), F.lit(" | "), F.col("line"))
    order = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length("text") + 1).over(order), F.lit(0))
    sized = shown.withColumn("text", text).withColumn("_fits", used + F.length("text") <= READ_MAX_CHARS)
    broken = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return sized.withColumn("_ok", F.min("_fits").over(broken)).filter("_ok").select("path", "line_no", "text")


def sizes(files: DataFrame) -> DataFrame:
    """(path, chars, before): every file's size and the size of all files before it in path order, so a reader with a
    budget can take the files whose ``before`` is within it. Contents stay in the scan."""
    return running_total(files.select("path", F.length("content").cast("bigint").alias("chars")), [F.col("path")], "chars", "before")


def snippet_windows(lines: DataFrame, at: DataFrame, context: int = 2) -> DataFrame:
    """(path, line_no, text): numbered lines around each located line; five exact line numbers per location."""
    around = at.select("path", F.col("line_no").alias("at"), F.explode(F.sequence(F.col("line_no") - context, F.col("line_no") + context)).alias("line_no"))
    return around.join(lines, ["path", "line_no"]).select(
        "path", "at", "line_no", F.concat(F.lpad(F.col("line_no").cast("string"), 4, " "), F.lit(" | "), F.col("line")).alias("text"))


def fit_context(entries: DataFrame, key: str, order: str, size: str, budget: int = 14_000) -> DataFrame:
    """(key, dropped): how many of the oldest entries of each conversation have to go so that the rest fits the
    budget; the newest always stays.

    An entry goes when the sizes from it to the newest exceed the budget. Those sums come from one distributed
    running total over (key, newest first), less the total before the key, so a conversation of any length is
    never one window."""
    summed = running_total(entries.select(key, order, size), [F.col(key), F.desc(order)], size, "before")
    start = summed.groupBy(key).agg(F.min("before").alias("_start"), F.max(order).alias("_newest"))
    over = (F.col("before") - F.col("_start") + F.col(size) > budget) & (F.col(order) != F.col("_newest"))
    return summed.join(start, key).groupBy(key).agg(F.count_if(over).alias("dropped"))
