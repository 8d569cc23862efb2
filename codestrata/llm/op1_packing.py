"""Packing into optimal length buckets.

A global histogram of lengths (words) is aggregated by Spark; dynamic programming over it chooses the bucket boundaries
that minimise padding when every document is padded to its bucket's boundary. Inside each bucket documents form batches
under a token budget: ``max(1, budget // boundary)`` rows each.

The histogram is exact up to ``EXACT`` words and has 256 bins per doubling above, each standing for its longest
document, so it has at most ``EXACT + 256 * 64`` rows however many documents there are; only it reaches the driver.
Boundaries are optimal among the bin maxima, hence optimal outright while no document exceeds ``EXACT`` words.

Nulls and edge cases: a null or blank text has length 0 and is packed like any other (a bucket whose boundary is 0
pads to 0 and fills a batch with ``budget`` rows). A document longer than the budget has a batch to itself; nothing is
cut or dropped. Repeated rows are packed each. Extra columns are kept unless an output column has their
name, compared without case. An empty
table gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm.common import cut, free, n_words, others, table, with_slots

BUCKETS = 16
BUDGET = 16384
EXACT = 131072
BINS_PER_DOUBLING = 256


def _bin(length: Column) -> Column:
    """The histogram bin of a length: itself up to EXACT, then by the logarithm."""
    fine = F.floor(F.log2(length.cast("double") / EXACT) * BINS_PER_DOUBLING) + EXACT + 1
    return F.when(length <= EXACT, length).otherwise(fine).cast("long")


def histogram(lengths: DataFrame) -> list[tuple[int, int, int]]:
    """(longest length, documents, total length) per bin, ascending; bounded by the bins, not by the rows."""
    rows = lengths.groupBy(_bin(F.col("n_words")).alias("bin")).agg(
        F.max("n_words").alias("top"), F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("total")).collect()
    return sorted((r["top"], r["n"], r["total"]) for r in rows)


def boundaries(bins: list[tuple[int, int, int]], buckets: int = BUCKETS) -> list[int]:
    """The boundaries, ascending, of at most ``buckets`` buckets with the least total padding.

    ``best[k][j]``, the least padding of the first j bins in k buckets, is a minimum over i of
    ``best[k-1][i] + top[j] * (count[j] - count[i]) - (total[j] - total[i])``: lines with falling slopes ``-count[i]``
    asked at rising ``top[j]``, so a hull of lines answers each layer in linear time, in whole numbers."""
    d = len(bins)
    if not d:
        return []
    count, total = [0] * (d + 1), [0] * (d + 1)
    for j, (_, n, length) in enumerate(bins):
        count[j + 1], total[j + 1] = count[j] + n, total[j] + length
    infinite = None
    best: list[int | None] = [0] + [infinite] * d
    choices: list[list[int]] = []
    costs: list[int] = []
    for _ in range(min(buckets, d)):
        hull: list[tuple[int, int, int]] = []  # slope, intercept, i
        head, layer, chosen = 0, [infinite] * (d + 1), [0] * (d + 1)
        for j in range(1, d + 1):
            if best[j - 1] is not None:
                m, b = -count[j - 1], best[j - 1] + total[j - 1]
                while len(hull) - head >= 2 and (b - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - m):
                    hull.pop()
                hull.append((m, b, j - 1))
            if head < len(hull):
                x = bins[j - 1][0]
                while head + 1 < len(hull) and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
                    head += 1
                m, b, i = hull[head]
                layer[j], chosen[j] = m * x + b + x * count[j] - total[j], i
        best = layer
        choices.append(chosen)
        costs.append(layer[d])
    k = min(range(len(costs)), key=lambda i: costs[i])
    edges, j = [], d
    for chosen in reversed(choices[: k + 1]):
        edges.append(bins[j - 1][0])
        j = chosen[j]
    return sorted(edges)


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """``docs`` without the text, with n_words, bucket, pad_to, batch and row_in_batch. (bucket, batch) names a batch."""
    kept = others(docs, "n_words", "bucket", "pad_to", "batch", "row_in_batch", "text")
    slot, room = free(docs, "_slot", "_rows")
    # lengths are counted once: histogram and placement read them, not the texts
    sized = cut(docs.select(*kept, n_words(F.col("text")).alias("n_words")))
    edges = boundaries(histogram(sized.select("n_words")), buckets)
    pad, bucket = F.lit(None).cast("long"), F.lit(None).cast("int")
    for i, edge in reversed(list(enumerate(edges))):
        pad = F.when(F.col("n_words") <= edge, F.lit(edge).cast("long")).otherwise(pad)
        bucket = F.when(F.col("n_words") <= edge, F.lit(i)).otherwise(bucket)
    placed = with_slots(sized.withColumn("bucket", bucket).withColumn("pad_to", pad), ["bucket"], ["n_words", "doc_id"], slot)
    rows = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(F.col("pad_to"), F.lit(1)))).cast("long")
    return placed.withColumn(room, rows).withColumn("batch", F.floor(F.col(slot) / F.col(room)).cast("long")).withColumn(
        "row_in_batch", F.col(slot) % F.col(room)).drop(slot, room)


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's bucket, padded length and batch."""
    return pack(table(spark, folder, "documents").select("doc_id", "text"))
