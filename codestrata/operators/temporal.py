"""Snapshots over time: presence, diffs between neighbours, validity intervals, as-of reads and trends.

A presence relation is (key columns..., idx): the key exists at snapshot ``idx``. Snapshot counts are small by
design (a sample of the history), the keys are what grows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diffs(presence: DataFrame, keys: list[str], last_idx: DataFrame) -> DataFrame:
    """(keys, idx, change) with change 'added' / 'removed' against the previous snapshot.

    The snapshots of a key meet in one small set, and a change is one whose neighbour is missing there, so one shuffle
    replaces a self anti-join per direction. The first snapshot has no diff. ``last_idx`` is a one-row relation (last)."""
    held = presence.groupBy(*keys).agg(F.collect_set("idx").alias("_held"))
    after = F.transform("_held", lambda i: i + 1)
    mark = lambda found, change: F.transform(found, lambda i: F.struct(i.alias("idx"), F.lit(change).alias("change")))
    changes = F.concat(mark(F.array_except("_held", after), "added"), mark(F.array_except(after, "_held"), "removed"))
    return (held.select(*keys, F.explode(changes).alias("_c")).select(*keys, "_c.idx", "_c.change").join(F.broadcast(last_idx))
            .filter((F.col("idx") > 0) & (F.col("idx") <= F.col("last"))).drop("last"))


def intervals(presence: DataFrame, keys: list[str], last_idx: DataFrame) -> DataFrame:
    """Half-open validity [valid_from_idx, valid_to_idx) per contiguous run; null while still live.

    Gaps and islands: the window is over one key's distinct snapshot indices, never more rows than there are
    snapshots."""
    here = presence.select(*keys, "idx").distinct()
    island = F.col("idx") - F.row_number().over(Window.partitionBy(*keys).orderBy("idx"))
    runs = here.withColumn("_island", island).groupBy(*keys, "_island").agg(
        F.min("idx").alias("valid_from_idx"), F.max("idx").alias("_end"))
    return runs.join(F.broadcast(last_idx)).select(
        *keys, "valid_from_idx", F.when(F.col("_end") < F.col("last"), F.col("_end") + 1).alias("valid_to_idx"))


def valid_at(k: Column) -> Column:
    """Predicate of the as-of read."""
    return (F.col("valid_from_idx") <= k) & (F.col("valid_to_idx").isNull() | (F.col("valid_to_idx") > k))


def live_counts(spans: DataFrame, snapshots: DataFrame) -> DataFrame:
    """How many intervals are valid at every snapshot: interval ends become +1 / -1 marks, summed per index
    and accumulated over the (small) snapshot list instead of range-joining intervals with snapshots."""
    marks = spans.select(F.explode(F.array(
        F.struct(F.col("valid_from_idx").alias("idx"), F.lit(1).alias("d")),
        F.struct(F.col("valid_to_idx").alias("idx"), F.lit(-1).alias("d")))).alias("m")).select("m.idx", "m.d") \
        .filter("idx IS NOT NULL").groupBy("idx").agg(F.sum("d").alias("d"))
    line = snapshots.select("idx").join(marks, "idx", "left")
    return line.select("idx", F.sum(F.coalesce("d", F.lit(0))).over(Window.orderBy("idx")).alias("live"))


def module_presence(presence: DataFrame) -> DataFrame:
    """path -> its snapshot indices and the layer at the latest one."""
    return presence.groupBy("path").agg(
        F.max_by("layer_type", "idx").alias("layer_type"),
        F.sort_array(F.collect_set("idx")).alias("snapshots"))


def compare(presence: DataFrame, keys: list[str], a: Column, b: Column) -> DataFrame:
    """Keys gained and lost between two snapshots, swapped into order. ``a`` and ``b`` are already clamped."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    both = presence.filter((F.col("idx") == lo) | (F.col("idx") == hi))
    sides = both.groupBy(*keys).agg(F.max(F.col("idx") == lo).alias("_at_a"), F.max(F.col("idx") == hi).alias("_at_b"))
    return sides.filter(F.col("_at_a") != F.col("_at_b")).select(
        *keys, F.when(F.col("_at_b"), "added").otherwise("removed").alias("change"))


def clamp(k: int, count: int) -> int:
    return min(max(k, 0), count - 1)


def trend(health: DataFrame) -> DataFrame:
    """Change in health against the previous scored snapshot; null when either side is not scored. One row per
    snapshot, so the ordered window is bounded by the sample size."""
    return health.withColumn("delta", F.col("health") - F.lag("health").over(Window.orderBy("idx")))


def largest_moves(trended: DataFrame) -> DataFrame:
    """The largest drop (earliest on ties) and gain (latest on ties), only when there is one."""
    pair = F.struct("delta", "idx")
    moves = trended.filter("delta IS NOT NULL").agg(F.min(pair).alias("drop"), F.max(pair).alias("gain"))
    return moves.select(F.explode(F.array(
        F.struct(F.lit("largest_drop").alias("move"), F.col("drop.delta").alias("delta"), F.col("drop.idx").alias("idx")),
        F.struct(F.lit("largest_gain").alias("move"), F.col("gain.delta").alias("delta"), F.col("gain.idx").alias("idx")),
    )).alias("m")).select("m.*").filter(
        ((F.col("move") == "largest_drop") & (F.col("delta") < 0)) | ((F.col("move") == "largest_gain") & (F.col("delta") > 0)))


def evenly_spaced(indexed: DataFrame, count: int) -> DataFrame:
    """``count`` rows spread evenly over 0..n-1, first and last included (half-to-even rounding, duplicates
    collapse). ``indexed`` has a consecutive ``idx``; only the picked positions are broadcast."""
    spark = indexed.sparkSession
    span = indexed.agg((F.count(F.lit(1)) - 1).alias("_span"))
    picks = spark.range(count).join(F.broadcast(span)).select(
        F.when(F.col("_span") < count, F.col("id")).otherwise(
            F.bround(F.col("id") * F.col("_span").cast("double") / float(max(count - 1, 1)))).cast("bigint").alias("idx")).distinct()
    return indexed.join(F.broadcast(picks), "idx", "left_semi")


def adaptive_count(parse_seconds: Column, requested: int = 20, budget: int = 90, minimum: int = 4) -> Column:
    """How many snapshots fit the time budget."""
    affordable = F.floor(F.lit(float(budget)) / parse_seconds)
    return F.when(parse_seconds <= 0, F.lit(requested)).otherwise(
        F.greatest(F.lit(minimum), F.least(F.lit(requested), affordable))).cast("bigint")


def snapshot_candidates(commits: DataFrame, touched: DataFrame, mined: DataFrame) -> DataFrame:
    """Commits worth a snapshot: merges, commits outside the mined window, and commits that changed a source
    file under its new or old name. ``touched`` is (hash, path, old_path)."""
    from codestrata.functions.paths import has_source_extension

    source = touched.filter(has_source_extension(F.col("path")) | F.coalesce(
        has_source_extension(F.col("old_path")), F.lit(False))).select("hash").distinct().withColumn("_src", F.lit(True))
    window = mined.select("hash").distinct().withColumn("_mined", F.lit(True))
    return commits.join(source, "hash", "left").join(window, "hash", "left").filter(
        F.col("is_merge") | F.col("_mined").isNull() | F.col("_src").isNotNull()).drop("_src", "_mined")
