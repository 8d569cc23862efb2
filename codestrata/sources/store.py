"""Reading a working tree, and keeping the relations of many analyses side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions import paths

# Fixed value: node and edge rows are replaced per analysis, never merged across analyses.
PARTITION = "analysis_id"


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the source and configuration files below a folder, at most a megabyte each. Size and
    name filters run on the file listing, before any content is read; bytes that are not UTF-8 are replaced."""
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{py,js,jsx,ts,tsx,json}").load(root)
           .filter(F.col("length") <= paths.MAX_BLOB_BYTES))
    base = root.rstrip("/").removeprefix("file:")
    files = raw.select(F.substring_index("path", base + "/", -1).alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    p = F.col("path")
    return files.filter((paths.has_source_extension(p) | paths.is_config_file(p)) & paths.is_safe_relative(p))


def save(relations: dict[str, DataFrame], folder: str, analysis_id: str) -> None:
    """Writes each relation as Parquet under its name, replacing only this analysis's partition."""
    for name, rows in relations.items():
        (rows.withColumn(PARTITION, F.lit(analysis_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(PARTITION).parquet(f"{folder}/{name}"))


def load(spark: SparkSession, folder: str, name: str, analysis_id: str) -> DataFrame:
    """One relation of one analysis; the filter prunes to its partition."""
    return spark.read.parquet(f"{folder}/{name}").filter(F.col(PARTITION) == analysis_id).drop(PARTITION)


def upsert_records(stored: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Stored rows overlaid with new ones of the same key."""
    return stored.join(new.select(key), key, "left_anti").unionByName(new)


def evidence_edges(records: DataFrame, evidence: DataFrame, modules: DataFrame, affected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(EVIDENCED_BY, AFFECTS) of stored records; affected paths have to be modules that exist."""
    cited = evidence.join(records.select(F.col("id").alias("decision")), "decision", "left_semi").select("decision", "hash", "relevance")
    return cited, affected.join(modules.select("path"), "path", "left_semi").select("decision", "path").distinct()


def artifact_digest(*parts: Column) -> Column:
    """Content address of a cached artifact: everything its text depends on."""
    return F.sha1(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def cache_misses(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    return wanted.join(stored.select("digest"), "digest", "left_anti")


def storable(artifacts: DataFrame) -> DataFrame:
    """Degraded results are shown but never stored."""
    return artifacts.filter(~F.col("degraded"))


def save_lines(lines: DataFrame, order: list[str], path: str) -> None:
    """Writes a document's lines in order as text; the sort is distributed, parts are in order of their names."""
    lines.orderBy(*order).select("line").write.mode("overwrite").text(path)
