"""Push-triggered review as a stream: findings arrive with pushes, each fingerprint is raised once.

The stream is the only place with state. A push that is delivered twice, or a finding that several pushes
repeat, must not raise a second issue, so fingerprints are deduplicated in the state store (on disk with the
checkpoint, RocksDB when the cluster configures it) and written by an append-only file sink, whose commit log
makes a restarted batch idempotent. With an event time the store forgets a fingerprint once the watermark has passed it
by the horizon, so its size follows the findings of one horizon; what was raised before that is met in the table of
raised issues."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.session import ensure_checkpoint_dir


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's Parquet file as a stream of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def deduplicated(findings: DataFrame, fingerprint: Column, at: str | None = None, horizon: str = "30 days", raised: DataFrame | None = None) -> DataFrame:
    """One row per fingerprint.

    ``at`` names the event time: a fingerprint is then kept in the state for ``horizon`` behind the newest event, and rows
    that come later than that are dropped by the stream (rows without a time too). ``raised`` (fingerprint) are issues known
    before the stream starts; what they name is not raised again, however old. Without ``at`` every fingerprint is kept for
    the life of the stream."""
    marked = findings.withColumn("fingerprint", fingerprint)
    if raised is not None:
        marked = marked.join(raised.select("fingerprint").distinct(), "fingerprint", "left_anti")
    if at is None:
        return marked.dropDuplicates(["fingerprint"])
    return marked.withWatermark(at, horizon).dropDuplicatesWithinWatermark(["fingerprint"])


def _shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder below the checkpoint folder, which all executors see."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, label: str) -> DataFrame:
    """Processes everything available now into an append-only Parquet table and returns that table."""
    spark = stream.sparkSession
    root = _shared_folder(spark, label)
    query = (stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def exit_code(findings: DataFrame, fail_on: str = "high") -> int:
    """1 when any finding is at or above the severity, for use in a build."""
    from codestrata.operators.review import SEVERITY_WEIGHT, severity_weight

    worst = findings.agg(F.max(severity_weight(F.col("severity")))).first()[0]
    return int(worst is not None and worst >= SEVERITY_WEIGHT[fail_on])
