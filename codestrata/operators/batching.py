"""Next-fit batches over rows: consecutive items share a batch until the next one would overflow its budget.

Batches are a chain: where one begins decides where the next does. Rows are sorted by group and order, and a task reads
them once in that order with one running sum; it holds one Arrow batch of rows, however long a group is, and no group is
folded into an array."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from codestrata.operators.review import BATCH_CHARS
from codestrata.sources import gitlog


def _numbered(kept: list[str], budget: int):
    """Arrow batches of sorted rows, with the number of each row's batch after the ``kept`` columns."""

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        batch = used = 0
        for part in rows:
            numbers = []
            for position, size in zip(part.column("_pos").to_pylist(), part.column("_size").to_pylist()):
                if position == 1:
                    batch, used = 0, size
                elif used + size > budget:
                    batch, used = batch + 1, size
                else:
                    used += size
                numbers.append(batch)
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(numbers, pa.int64())], [*kept, "_batch"])

    return run


def next_fit_rows(rows: DataFrame, by: list[str], order: list[str], size: str, budget: int = BATCH_CHARS, name: str = "batch") -> DataFrame:
    """``rows`` with the number (long, from 0) of the batch each falls into, in order within ``by``.

    A null size counts as 0; a null in ``by`` is a key like any other. Rows equal in order stand in any order. Sizes of 0 join the batch before them, or open one."""
    # the window leaves its rows sorted, so position 1 begins a group and the fold needs no look at the keys
    placed = rows.withColumn("_pos", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint")).withColumn(
        "_size", F.coalesce(F.col(size), F.lit(0)).cast("bigint"))
    schema = StructType(list(rows.schema.fields)).add("_batch", LongType())
    return placed.mapInArrow(_numbered(rows.columns, budget), schema).withColumn(name, F.col("_batch")).drop("_batch")


def _shown_chars(hunk: Column) -> Column:
    """Length of a hunk as it is shown: its header, and a line break and the rendered text for each of its lines."""
    lines = gitlog.hunk_lines(hunk["body"])
    first = F.struct(hunk["start"].cast("bigint").alias("no"), F.length(hunk["header"]).cast("bigint").alias("chars"))
    return F.aggregate(lines, first, lambda seen, x: F.struct(
        (seen["no"] + F.when(gitlog.line_kind(x) == "-", 0).otherwise(1)).alias("no"),
        (seen["chars"] + 1 + F.length(gitlog.render_line(gitlog.line_kind(x), seen["no"], F.substr(x, F.lit(2))))).alias("chars")))["chars"]


def hunk_sizes(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, section, path, hunk, chars): the length of every hunk as it is shown. A hunk is one value, so its lines are
    added up beside it."""
    # the outer form keeps Spark from taking the text apart a second time in an inferred size filter
    hunks = files.select(*keys, "section", "path", F.posexplode_outer("hunks").alias("hunk", "_h")).where("_h is not null")
    return hunks.select(*keys, "section", "path", "hunk", _shown_chars(F.col("_h")).alias("chars"))


def file_parts(hunks: DataFrame, keys: list[str], budget: int = BATCH_CHARS) -> DataFrame:
    """(keys, section, path, part, hunks, chars): a file's hunks in parts of at most the budget. A hunk counts in full against
    the budget and is shown up to it; hunks of a part are joined by line breaks."""
    placed = next_fit_rows(hunks, [*keys, "section"], ["hunk"], "chars", budget, "part")
    shown = F.sum(F.least(F.col("chars"), F.lit(budget))) + F.count(F.lit(1)) - 1
    # a section has one path; as a key it leaves the buffers to numbers
    return placed.groupBy(*keys, "section", "path", "part").agg(F.count(F.lit(1)).alias("hunks"), shown.cast("bigint").alias("chars"))


def diff_batches(files: DataFrame, keys: list[str], order: list[str], budget: int = BATCH_CHARS) -> DataFrame:
    """``file_parts`` of ``files`` (as ``gitlog.diff_files`` gives them) with the request each part goes into, files in ``order``
    (columns of keys, section and path)."""
    return next_fit_rows(file_parts(hunk_sizes(files, keys), keys, budget), keys, [*order, "part"], "chars", budget, "batch")
