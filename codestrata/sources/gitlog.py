"""Git history text as rows.

Log records use control characters (0x1e before a record, 0x1f between header fields, NUL in the numstat part),
so one regular expression per field is enough; both numstat forms, plain and rename, are one alternation.
Records come as one row each (``record``): read the log with ``lineSep`` 0x1e and nothing larger than a commit is
ever one value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.functions.paths import unquoted
from codestrata.operators.history import BULK_COMMIT_FILES

RECORD, FIELD, NUL = "\x1e", "\x1f", "\x00"
# added, deleted, then the path, or an empty field followed by the old and the new path.
NUMSTAT = r"(?s)(\d+|-)\t(\d+|-)\t(?:([^\x00\t]+)(?:\x00|\z)|\x00([^\x00]*)\x00([^\x00]*)(?:\x00|\z))"
HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """One row per commit of ``git log --no-merges -M --numstat -z --format=%x1e%H%x1f%P%x1f%an%x1f%ae%x1f%at%x1f%s%x1f%b%x1f``."""
    return spark.read.option("lineSep", RECORD).text(path).withColumnRenamed("value", "record")


def _count(field: Column) -> Column:
    return F.when(field == "-", F.lit(0).cast("bigint")).otherwise(field.try_cast("bigint"))


def author_id(email: Column, name: Column) -> Column:
    """Short hash of the address (or the name without one); the address itself is not kept."""
    known = F.when(email == "", name).otherwise(email)
    return F.substring(F.sha1(F.lower(F.trim(known))), 1, 12)


def parse_commits(records: DataFrame, bulk_files: int = BULK_COMMIT_FILES) -> DataFrame:
    """Commit rows; ``stats`` keeps the numstat entries as text, read by ``commit_files``."""
    whole = records.filter(F.length(F.translate("record", "\x00\n", "")) > 0)
    # The header ends at the last field separator; a body may itself contain separators.
    cut = whole.select(
        F.regexp_extract("record", r"(?s)^(.*)\x1f", 1).alias("_header"),
        F.regexp_extract_all(F.substring_index("record", FIELD, -1), F.lit(NUMSTAT), F.lit(0)).alias("stats"))
    split = cut.select(F.split("_header", FIELD, 7).alias("h"), "stats").filter(F.size("h") == 7)
    h = lambda i: F.get("h", F.lit(i))
    ts = F.when(h(4).rlike(r"^\d+$"), h(4).try_cast("bigint")).otherwise(F.lit(0))
    return split.select(
        h(0).alias("hash"), F.substring(h(0), 1, 7).alias("short"), F.filter(F.split(h(1), " "), lambda p: p != "").alias("parents"),
        F.when(F.trim(h(2)) == "", "unknown").otherwise(F.trim(h(2))).alias("author"), author_id(h(3), h(2)).alias("author_id"),
        ts.alias("timestamp"), F.trim(h(5)).alias("subject"), F.regexp_replace(h(6), r"^\s+|\s+$", "").alias("body"),
        "stats", F.size("stats").cast("bigint").alias("n_files")).withColumn("bulk", F.col("n_files") > bulk_files)


def commit_files(commits: DataFrame) -> DataFrame:
    """(hash, file_ord, path, old_path, added, deleted), one numstat entry per row. Entries are taken apart
    after the explode, where the expressions are compiled; the outer form keeps Spark from evaluating the
    extraction a second time in an inferred size filter."""
    entries = commits.select("hash", F.posexplode_outer("stats").alias("file_ord", "entry")).filter("entry IS NOT NULL")
    part = F.split("entry", "\t", 3)
    tail = F.split(F.get(part, F.lit(2)), NUL)
    renamed = F.get(tail, F.lit(0)) == ""
    return entries.select(
        "hash", "file_ord", F.when(renamed, F.get(tail, F.lit(2))).otherwise(F.get(tail, F.lit(0))).alias("path"),
        F.when(renamed, F.get(tail, F.lit(1))).alias("old_path"), _count(F.get(part, F.lit(0))).alias("added"), _count(F.get(part, F.lit(1))).alias("deleted"))


def numbered_lines(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """(keys, line_no, line): 1-based source lines; a trailing newline does not add one."""
    text = F.regexp_replace(content, r"\r\n?", "\n")
    lines = F.split(F.regexp_replace(text, r"\n\z", ""), "\n")
    return files.filter(F.length(content) > 0).select(*keys, F.posexplode(lines).alias("_p", "line")).select(
        *keys, (F.col("_p") + 1).alias("line_no"), "line")


def diff_files(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Per-file sections of unified diffs: (keys, section, path, old_path, status, binary, hunks).

    ``hunks`` is an array of (header, start, lines). A section is one file's diff; its lines are numbered by
    ``diff_lines``, from the hunk starts."""
    whole = F.concat(F.lit("\n"), F.regexp_replace(F.regexp_replace("diff", r"\r\n?", "\n"), r"\n\z", ""))
    sections = F.filter(F.split(whole, r"\ndiff --git "), lambda s: s.rlike(r"\A\S"))
    # the outer form keeps Spark from splitting the text a second time in an inferred size filter
    rows = texts.select(*keys, F.posexplode_outer(sections).alias("section", "s")).filter("s IS NOT NULL")
    rows = rows.withColumn("_head", F.regexp_extract("s", r"(?s)\A(.*?)(?:\n@@|\z)", 1))
    head = F.col("_head")
    # each step is a column of its own: an expression named twice below would be worked out twice
    # the text part of a path line ends at a tab that follows a name with spaces; a tab inside a name is escaped
    grab = lambda pattern: F.nullif(F.regexp_replace(F.regexp_extract(head, pattern, 1), r"\t\z", ""), F.lit(""))
    named = {"_old": r"(?m)^--- (.+)$", "_new": r"(?m)^\+\+\+ (.+)$", "_from": r"(?m)^rename from (.+)$", "_to": r"(?m)^rename to (.+)$"}
    rows = rows.withColumns({c: grab(pattern) for c, pattern in named.items()}).withColumns({c: unquoted(F.col(c)) for c in named})
    strip = lambda c, side: F.when(F.col(c) != "/dev/null", F.regexp_replace(c, rf"^{side}/", ""))
    rows = rows.withColumn("_before", F.coalesce("_from", strip("_old", "a")))
    old_path = F.col("_before")
    path = F.coalesce(strip("_new", "b"), F.col("_to"), old_path)
    status = (F.when(head.rlike(r"(?m)^rename from "), "renamed").when(head.rlike(r"(?m)^deleted file mode"), "deleted")
              .when(head.rlike(r"(?m)^new file mode"), "added").otherwise("modified"))
    body = F.regexp_extract("s", r"(?s)\n(@@.*)\z", 1)
    hunks = F.transform(F.filter(F.split(body, r"\n(?=@@)"), lambda h: h.rlike(HUNK)), lambda h: F.struct(
        F.substring_index(h, "\n", 1).alias("header"), F.regexp_extract(h, HUNK, 1).cast("int").alias("start"),
        F.regexp_replace(h, r"\A[^\n]*\n?", "").alias("body")))
    return rows.select(*keys, "section", path.alias("path"), old_path.alias("old_path"), status.alias("status"),
                       head.rlike(r"(?m)^Binary files ").alias("binary"), hunks.alias("hunks"))


def hunk_lines(body: Column) -> Column:
    """The lines of a hunk's body as they stand there; other rows, such as a mark of no newline, are left out."""
    return F.filter(F.split(body, "\n"), lambda x: x.rlike(r"\A([+\- ]|\z)"))


def line_kind(line: Column) -> Column:
    return F.when(line == "", " ").otherwise(F.left(line, F.lit(1)))


def diff_lines(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, section, path, hunk, pos, kind, new_no, text): every hunk line with its number in the new file;
    removed lines have none. A line's number is the hunk start plus the lines before it that are not removed;
    the window covers one hunk, whose text was a single value anyway."""
    per_hunk = files.select(*keys, "section", "path", F.posexplode_outer("hunks").alias("hunk", "h")).filter("h IS NOT NULL")
    raw = hunk_lines(F.col("h.body"))
    lines = per_hunk.select(*keys, "section", "path", "hunk", F.col("h.start").alias("start"), F.posexplode_outer(raw).alias("pos", "x")).filter("x IS NOT NULL")
    kind = line_kind(F.col("x"))
    hunk = Window.partitionBy(*keys, "section", "hunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(F.col("x").startswith("-"), 0).otherwise(1)).over(hunk), F.lit(0))
    return lines.withColumn("_before", before).select(
        *keys, "section", "path", "hunk", "pos", kind.alias("kind"),
        F.when(kind != "-", F.col("start") + F.col("_before")).cast("bigint").alias("new_no"), F.substr("x", F.lit(2)).alias("text"))


def with_sizes(files: DataFrame) -> DataFrame:
    """Files of ``diff_files`` with ``n_added``, their added lines, and ``n_chars``, the length of all hunk lines without their
    marks; ``hunks`` is left out. A file's hunks are one value, so they are counted where they are."""
    lines = files.withColumn("_lines", F.flatten(F.transform("hunks", lambda h: hunk_lines(h["body"])))).drop("hunks")
    chars = F.aggregate("_lines", F.lit(0).cast("long"), lambda total, x: total + F.greatest(F.length(x) - 1, F.lit(0)))
    sized = lines.withColumns({"n_added": F.size(F.filter("_lines", lambda x: x.startswith("+"))).cast("long"), "n_chars": chars}).drop("_lines")
    # an outer generator keeps filters on these columns from working them out again
    return sized.select(F.explode_outer(F.array(F.struct(*sized.columns))).alias("_file")).select("_file.*")


def render_line(kind: Column, new_no: Column, text: Column) -> Column:
    """Display form of a hunk line: right-aligned new number, kind, text."""
    number = F.coalesce(new_no.cast("string"), F.lit(""))
    padded = F.when(F.length(number) >= 5, number).otherwise(F.lpad(number, 5, " "))
    return F.when(kind == "-", F.concat(F.lit("      - "), text)).otherwise(F.concat(padded, F.lit(" "), kind, F.lit(" "), text))


def render_lines(lines: DataFrame) -> Column:
    """``render_line`` of the rows of ``diff_lines``."""
    return render_line(F.col("kind"), F.col("new_no"), F.col("text"))
