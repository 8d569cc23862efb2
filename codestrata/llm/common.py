"""Helpers the corpus operators share: words, lineage cuts, gapless positions, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

# monotonically_increasing_id() keeps the position inside a partition in its low 33 bits.
_POSITION_BITS = 33
LAST = (1 << 63) - 1


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder driver and executors share: ``spark.checkpoint.dir``, read from the session. Only a local session
    without one (tests) gets a folder of its own under the working directory's ``spark-warehouse`` setting."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named and context.getCheckpointDir():
        named = context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints"
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh folder name inside the shared folder."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there: executors lost later cost nothing that came before it, a
    column that depends on partition order stays as it is, and sizes are known to the plans that follow."""
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._cut_folder = path
    return written


def drop(*tables: DataFrame) -> None:
    """Deletes what ``cut`` wrote for tables that no plan still to be run reads, so the shared folder holds only what is in use."""
    for df in tables:
        context = df.sparkSession.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(df._cut_folder)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def free(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, compared without case as Spark resolves them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def others(df: DataFrame, *made: str) -> list[str]:
    """The columns of ``df`` that no output column replaces, compared without case."""
    lower = {c.lower() for c in made}
    return [c for c in df.columns if c.lower() not in lower]


def partitions(spark: SparkSession) -> int:
    """How many shuffle partitions the session is set to; they are set so that a partition fits a task."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(docs: DataFrame, name: str) -> tuple[DataFrame, bool]:
    """``docs`` (doc_id, text, ...) with a number (long) that no two rows share, in order of id, nulls last, and whether
    the numbers are the ids themselves (``LAST`` for null).

    They are as long as no id stands in two rows and at most one is null. Otherwise rows are sorted by id, text digest and
    place of reading, and written once with their numbers, so every later read sees the same; rows that share an id, a null one
    too, are documents of their own."""
    key = F.col("doc_id").cast("long")
    shared = docs.select(key.alias("_key")).groupBy("_key").agg(F.count(F.lit(1)).alias("_rows")).where((F.col("_rows") > 1) | (F.col("_key") == LAST))
    if shared.isEmpty():
        return docs.withColumn(name, F.coalesce(key, F.lit(LAST))), True
    id_, digest, at = free(docs, "_key", "_digest", "_at")
    marked = docs.withColumn(id_, key).withColumn(digest, F.md5(F.col("text").cast("binary"))).withColumn(at, F.monotonically_increasing_id())
    order = [F.col(id_).asc_nulls_last(), F.col(digest).asc_nulls_last(), F.col(at).asc()]
    ranged = marked.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).drop(id_, digest, at)
    return cut(ranged.withColumn(name, F.monotonically_increasing_id())), False


def words(text: Column) -> Column:
    """The words of a text, in order; a null or blank text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def n_words(text: Column) -> Column:
    """How many words a text has (long), without building them."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for the row, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def with_slots(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with a gapless position (long, from 0) inside each group, in the given order.

    Rows are sorted into range partitions by group and order, so a group that holds a third of all rows spans many
    tasks and the positions need no window over it: a row's position is its place in the partition, less the place of
    the group's first row there, plus the group's rows in earlier partitions. The totals have a row for each group and
    partition it touches. The rows are cut first, so totals and rows see the same partitions. Rows equal in group and
    order take the positions among themselves in any way."""
    spark = df.sparkSession
    keys = [F.col(c).asc_nulls_last() for c in group] + [F.col(c).asc() for c in order]
    at, part, of, first, rows, offset, *copies = free(df, "_at", "_part", "_p", "_first", "_rows", "_offset", *[f"_g{i}" for i in range(len(group))])
    ranged = df.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    placed = cut(ranged.withColumn(at, F.monotonically_increasing_id())).withColumn(part, F.shiftright(at, _POSITION_BITS).cast("int"))
    pieces = placed.groupBy(*group, part).agg(F.min(at).alias(first), F.count(F.lit(1)).alias(rows))
    # partitions are in range order: a group's earlier rows lie in its earlier partitions
    before = F.sum(rows).over(Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    offsets = pieces.select(*[F.col(c).alias(g) for c, g in zip(group, copies, strict=True)], F.col(part).alias(of), first,
                            F.coalesce(before, F.lit(0)).alias(offset))
    same = F.col(part) == F.col(of)
    for c, g in zip(group, copies, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(g))
    return placed.join(offsets, same, "left").withColumn(
        name, (F.col(at) - F.col(first) + F.col(offset)).cast("long")).drop(at, part, of, first, offset, *copies)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): for every id that an edge names, the smallest id it can reach.

    Contraction: every id hooks to its smallest neighbour, hooks are followed to their roots by doubling, edges are
    restated between roots and made distinct, until none is left. Rounds grow with the logarithm of the longest
    chain; each is an aggregate with map-side combine and joins whose right side is unique, so a centre with any
    number of neighbours is only a long but splittable key."""
    left = cut(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct())
    roots = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = cut(both.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("root")))
        while True:
            up = hooks.select(F.col("id").alias("root"), F.col("root").alias("_up"))
            hooks = cut(hooks.join(up, "root", "left").select(
                "id", F.coalesce("_up", "root").alias("root"), (F.coalesce("_up", "root") != F.col("root")).alias("moved")))
            moved = not hooks.where("moved").isEmpty()
            hooks = hooks.drop("moved")
            if not moved:
                break
        if roots is None:
            roots = hooks
        else:
            up = hooks.select(F.col("id").alias("root"), F.col("root").alias("_up"))
            roots = cut(roots.join(up, "root", "left").select("id", F.coalesce("_up", "root").alias("root")))
        ends = hooks.select(F.col("id").alias("_id"), F.col("root").alias("_root"))
        restated = (left.join(ends, F.col("a") == F.col("_id")).select(F.col("_root").alias("a"), "b")
                    .join(ends, F.col("b") == F.col("_id")).select("a", F.col("_root").alias("b")))
        left = cut(restated.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    if roots is None:
        return left.select(F.col("a").alias("id"), F.col("a").alias("component"))
    return roots.select("id", F.col("root").alias("component"))
