"""From documents to packed training batches: five stages, each an operator of ``codestrata.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and
reads it as the next stage's documents, so a stage never repeats an earlier one's work and survives lost executors. All
but the last return the columns of ``documents``.

1. quality rules: documents that policy ``v1`` of the rule ledger rejects go.
2. near-dedup: of each group of equal or near-equal documents the smallest id stays. Two documents are near if their
   five-word shingles reach 80 % or their three-word shingles 85 %: a block put on or cut off passes the first sooner, words
   changed here and there the second.
3. substring dedup: words covered by a 20-word window that also starts earlier are removed from the text; ``n_chars``
   follows. A document may be left with an empty text; it stays a row.
4. mixing: documents are repeated or left out as their source's target says.
5. packing: every copy gets its length bucket, padded length and batch (the text is left out).

Edge cases are those of the operators; an empty table passes through all stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import op1_packing, op2_quality_rules, op7_mixing, op9_substrings, op10_minhash
from codestrata.llm.common import scratch, table

POLICY = "v1"
NEAR = ((5, 80),)  # besides the measure of the op10 query


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op2_quality_rules.apply_policy(op2_quality_rules.ledger(docs), POLICY, "_kept").where("_kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op10_minhash.keep_one(docs, also=NEAR)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = op9_substrings.dedup(docs)
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op7_mixing.emit(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op1_packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

# The packing stage's dynamic program has no SQL form; tests compare the whole run with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed rows of all stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = scratch(spark, f"stage{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
