"""Session settings and the two scale helpers every operator shares."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# monotonically_increasing_id() keeps the position inside a partition in the low 33 bits.
_POSITION_BITS = 33
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str = "local[8]", app: str = "codestrata", **conf: str) -> SparkSession:
    """A session with the settings the operators are written for. On a cluster the master, memory and
    ``spark.checkpoint.dir`` come from spark-submit; only semantics-bearing settings are forced here."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A fixed table (rules, word lists) as a local relation: the optimizer knows its size and no Python
    task is needed to read it."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    columns = [pa.array([row[i] for row in rows], type=field.type) for i, field in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Points checkpoints at the folder the cluster names and returns it. Only a local session without one gets a folder
    next to its warehouse: an executor on another machine could not read it."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints"
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the reliable checkpoint folder and returns it as a source, so that later stages
    neither recompute it nor depend on the executors that produced it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the checkpoint folder: ``cut_lineage`` for large relations of plain columns, several
    times smaller there and with a size the planner knows. The shuffles it took are removed once it is written."""
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_RELEASE, None)
    spark.conf.set(_RELEASE, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.unset(_RELEASE) if before is None else spark.conf.set(_RELEASE, before)
    written = spark.read.schema(df.schema).parquet(folder)
    written._folder = folder
    return written


def deleted(*tables: DataFrame) -> None:
    """Deletes what ``stored`` wrote for tables that no plan still to be run reads."""
    for df in tables:
        context = df.sparkSession.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(df._folder)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly before work that is far slower per byte than a shuffle (parsing source text in
    Python): otherwise a few large input splits, or one compacted file, decide how many cores take part."""
    spark = df.sparkSession
    wanted = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(wanted)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by a key, in no fewer parts than ``spread`` makes, before each becomes many that are grouped by it."""
    spark = df.sparkSession
    wanted = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(wanted, *keys)


def _numbered_ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows sorted into range partitions, with ``_at`` (partition id and position) pinned by a checkpoint, so
    that totals per partition and the rows themselves are read from the same files. Sampled bounds over unique
    tails keep the ranges even when a third of the rows share the leading key."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut_lineage(ranged.withColumn("_at", F.monotonically_increasing_id())).withColumn(
        "_part", F.shiftright("_at", _POSITION_BITS))


def _before_partition(totals: DataFrame) -> DataFrame:
    """(_part, _offset): the running total of earlier partitions. One row per partition, so the window is
    bounded by the partition count, not by the data."""
    before = "sum(_total) over (order by _part rows between unbounded preceding and 1 preceding)"
    return totals.select("_part", F.coalesce(F.expr(before), F.lit(0)).alias("_offset"))


def global_index(df: DataFrame, order: list[Column], name: str = "idx") -> DataFrame:
    """Consecutive 0-based positions over a total order, without a single-partition window."""
    numbered = _numbered_ranges(df, order)
    offsets = _before_partition(numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_total")))
    position = F.col("_at").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    return numbered.join(F.broadcast(offsets), "_part").withColumn(
        name, (F.col("_offset") + position).cast("bigint")).drop("_part", "_at", "_offset")


def running_total(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """Sum of ``value`` over all earlier rows of a total order (exclusive), partition by partition: a window
    inside each range partition plus the total of the partitions before it."""
    numbered = _numbered_ranges(df, order)
    offsets = _before_partition(numbered.groupBy("_part").agg(F.sum(value).alias("_total")))
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    return numbered.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(offsets), "_part").withColumn(
        name, (F.col("_offset") + F.col("_inside")).cast("bigint")).drop("_part", "_at", "_offset", "_inside")
