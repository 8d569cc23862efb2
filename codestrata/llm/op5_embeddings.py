"""Near-duplicate vectors by spherical-cap filters.

A filter direction is a product of ``PARTS`` codewords, one per part of the (randomly rotated) vector, so ``words **
PARTS`` directions come from ``PARTS * words`` random codewords. A vector is decoded to all directions whose inner
product reaches the cap height; halves of the product are summed and the sorted halves searched, so the directions are
never listed. Vectors that share label, length and a direction meet; pairs are verified in double precision.

The number of directions grows with the largest label, so chance meetings stay constant per vector. A vector in a thin
place of the code takes its ``LEAST_FILTERS`` best directions, so none is left without.

Vectors equal in label and value are one class with a multiplicity. A bucket is processed in blocks of ``BLOCK``
members: every pair of blocks is a unit of bounded size, so a bucket with a third of all vectors spreads over many
tasks, and what leaves a unit is one row per member (links counted, one edge to its local component), never the pairs.
A pair is counted in the smallest direction both have, so counts are exact for all pairs found.

Nulls and edge cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without a label,
link with nothing and stay. A null id orders last. Rows that repeat an id count as rows. Extra columns are ignored. An
empty table gives no rows."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm.common import components, cut, partitions, table

COSINE = 0.98
PARTS = 4
FILTERS = 32              # expected directions of a vector
LEAST_FILTERS = 16
CHANCE = 0.25             # expected chance members of a bucket within a label
BLOCK = 256
UNIT_ROWS = 4096
SEED = 11
LAST = (1 << 63) - 1


def code(length: int, words: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """The rotation and, for each part, its codewords (unit rows)."""
    rng = np.random.Generator(np.random.PCG64([SEED, length, words]))
    rotation, _ = np.linalg.qr(rng.standard_normal((length, length)))
    books = []
    for part in np.array_split(np.arange(length), PARTS):
        book = rng.standard_normal((words, len(part)))
        books.append(book / np.maximum(np.linalg.norm(book, axis=1, keepdims=True), 1e-30))
    return rotation, tuple(books)


def plan(largest_label: int) -> tuple[int, float]:
    """(codewords per part, share of directions a vector exceeds)."""
    directions = max(256.0, FILTERS * largest_label / CHANCE)
    words = max(4, math.ceil(directions ** (1 / PARTS)))
    return words, min(0.5, FILTERS / float(words) ** PARTS)


def decode(vectors: np.ndarray, words: int, share: float, codes: dict) -> list[np.ndarray]:
    """For each unit vector (row), the sorted numbers of all directions whose inner product reaches the cap;
    ``codes`` keeps the code of each length."""
    length = vectors.shape[1]
    rotation, books = codes[length] if length in codes else codes.setdefault(length, code(length, words))
    turned = vectors @ rotation
    cuts = np.array_split(np.arange(length), PARTS)
    scores = [turned[:, cut_] @ book.T if len(cut_) else np.zeros((len(vectors), words)) for cut_, book in zip(cuts, books, strict=True)]
    half = PARTS // 2

    def summed(parts: list[np.ndarray]) -> np.ndarray:
        total = parts[0]
        for nxt in parts[1:]:
            total = (total[:, :, None] + nxt[:, None, :]).reshape(len(total), -1)
        return total

    left, right = summed(scores[:half]), summed(scores[half:])
    best = right.max(axis=1)
    height = NormalDist().inv_cdf(1 - share) / math.sqrt(length) * math.sqrt(PARTS)
    found = []
    for row in range(len(vectors)):
        h = height
        while True:
            near = np.flatnonzero(left[row] + best[row] >= h)
            a, b = np.nonzero(left[row, near][:, None] + right[row][None, :] >= h)
            if len(a) >= min(LEAST_FILTERS, words ** PARTS):
                break
            h -= 0.02
        found.append(np.sort(near[a].astype(np.int64) * right.shape[1] + b))
    return found


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, length, digest, vector): digest and vector are null where a row links with nothing."""
    import xxhash

    for batch in batches:
        digests, vectors, lengths = [], [], []
        for label, row in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            values = row.values if row.is_valid and label is not None else None
            v = None
            if values is not None and len(values) and not values.null_count:
                v = values.to_numpy().astype(np.float64) + 0.0  # -0 is 0
                v = v if np.isfinite(v).all() and v.any() and np.isfinite(np.dot(v, v)) and np.dot(v, v) > 0 else None
            digests.append(None if v is None else xxhash.xxh3_128_digest(v))
            vectors.append(None if v is None else v.tobytes())
            lengths.append(0 if v is None else len(v))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths, pa.int32()), pa.array(digests, pa.binary()), pa.array(vectors, pa.binary())],
                                         names=["id", "label", "length", "digest", "vector"])


def _unit(vectors: list[bytes]) -> np.ndarray:
    v = np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _decoded(words: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                raw, filters = batch.column("vector").to_pylist(), [None] * batch.num_rows
                by_length: dict[int, list[int]] = {}
                for i, v in enumerate(raw):
                    by_length.setdefault(len(v), []).append(i)
                for rows in by_length.values():
                    for i, f in zip(rows, decode(_unit([raw[i] for i in rows]), words, share, codes), strict=True):
                        filters[i] = f
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "label", "length", "n", "vector")], pa.array(filters, pa.list_(pa.int64()))],
                                                 names=["id", "label", "length", "n", "vector", "filters"])

    return run


def _seen_before(filters_a: list[np.ndarray], filters_b: list[np.ndarray], this: int) -> np.ndarray:
    """Which pairs share a direction smaller than this one (and are counted there)."""
    below_a, below_b = [f[f < this] for f in filters_a], [f[f < this] for f in filters_b]
    kinds = np.unique(np.concatenate([*below_a, np.zeros(0, np.int64)]))
    if not len(kinds):
        return np.zeros((len(below_a), len(below_b)), bool)

    def marks(lists: list[np.ndarray]) -> np.ndarray:
        m = np.zeros((len(lists), len(kinds)), np.float32)
        for i, f in enumerate(lists):
            at = np.searchsorted(kinds, f)
            ok = at < len(kinds)
            at, f = at[ok], f[ok]
            m[i, at[kinds[at] == f]] = 1
        return m

    return marks(below_a) @ marks(below_b).T > 0.5


def _roots(ids: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """The smallest id each member reaches inside the unit."""
    roots = ids.copy()
    reach = linked | np.eye(len(ids), dtype=bool)
    while True:
        smaller = np.where(reach, roots[None, :], LAST).min(axis=1)
        if (smaller == roots).all():
            return roots
        roots = smaller


def _verified(cosine: float):
    def run(unit: pa.Table) -> pa.Table:
        unit = unit.sort_by([(c, "ascending") for c in ("label", "length", "filter", "bi", "bj", "side", "id")])
        keys = np.stack([unit.column(c).to_numpy().astype(np.int64) for c in ("label", "length", "filter", "bi", "bj")])
        ids, n, side = unit.column("id").to_numpy(), unit.column("n").to_numpy(), unit.column("side").to_numpy()
        vectors, lists = unit.column("vector").to_pylist(), unit.column("filters")
        edges = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0), [True]])) if len(ids) else np.zeros(1, int)
        out_id, out_n, out_root = [], [], []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a < 2:
                continue
            own = keys[3, a] == keys[4, a]
            middle = b if own else a + int((side[a:b] == 0).sum())
            if not own and (middle == a or middle == b):
                continue
            v = _unit(vectors[a:b])
            k = middle - a
            near = (v[:k] @ (v if own else v[k:]).T) >= cosine
            if own:
                np.fill_diagonal(near, False)
            if not near.any():
                continue
            here = near.copy()
            rows = np.flatnonzero(near.any(axis=1))
            cols = np.flatnonzero(near.any(axis=0))
            right = a if own else middle
            filters = {i: lists[i].values.to_numpy() for i in {*(a + rows).tolist(), *(right + cols).tolist()}}
            seen = _seen_before([filters[a + i] for i in rows.tolist()], [filters[right + j] for j in cols.tolist()], int(keys[2, a]))
            here[np.ix_(rows, cols)] &= ~seen
            size = b - a
            full = np.zeros((size, size), bool)
            counted = np.zeros(size, np.int64)
            if own:
                full |= near
                counted += here.astype(np.int64) @ n[a:b]
            else:
                full[:k, k:] = near
                full |= full.T
                counted[:k] += here.astype(np.int64) @ n[middle:b]
                counted[k:] += here.T.astype(np.int64) @ n[a:middle]
            touched = np.flatnonzero(full.any(axis=1))
            roots = _roots(ids[a:b], full)
            out_id.append(ids[a:b][touched])
            out_n.append(counted[touched])
            out_root.append(roots[touched])
        cat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return pa.table([pa.array(cat(x).astype(np.int64)) for x in (out_id, out_n, out_root)], names=["id", "links", "root"])

    return run


def link(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, label, embedding)."""
    spark = vectors.sparkSession
    rows = cut(vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(LAST)).alias("id"), F.col("label").cast("long").alias("label"),
                              F.col("embedding").cast("array<double>").alias("embedding"))
               .mapInArrow(_read, "id long, label long, length int, digest binary, vector binary"))
    classes = cut(rows.where("digest is not null").groupBy("label", "length", "digest").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("vector").alias("vector")))
    largest = classes.groupBy("label", "length").count().agg(F.max("count")).first()[0] or 0
    words, share = plan(largest)
    spread = classes.repartition(partitions(spark), "id")
    decoded = cut(spread.select("id", "label", "length", "n", "vector").mapInArrow(
        _decoded(words, share), "id long, label long, length int, n long, vector binary, filters array<long>"))
    met = decoded.select("id", "label", "length", F.explode("filters").alias("filter"))
    shared = met.groupBy("label", "length", "filter").agg(F.count(F.lit(1)).alias("size")).where("size > 1").withColumn(
        "blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    # each member's block, and the pairs of blocks it takes part in
    placed = met.join(shared.select("label", "length", "filter", "blocks"), ["label", "length", "filter"]).withColumn(
        "own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = cut(placed.select("id", "label", "length", "filter", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"),
                              F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side")))
    tasks = max(1, math.ceil(units.count() / UNIT_ROWS))
    loaded = units.join(decoded.select("id", "n", "vector", "filters"), "id").withColumn(
        "_task", F.pmod(F.xxhash64("label", "length", "filter", "bi", "bj"), F.lit(tasks)))
    found = cut(loaded.groupBy("_task").applyInArrow(_verified(cosine), "id long, links long, root long"))
    linked = found.groupBy("id").agg(F.sum("links").alias("links"))
    reached = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    groups = classes.select(F.col("label").alias("_label"), F.col("length").alias("_length"), F.col("digest").alias("_digest"), F.col("id").alias("least"), "n")
    groups = groups.join(linked.withColumnRenamed("id", "_i"), F.col("least") == F.col("_i"), "left").join(
        reached.withColumnRenamed("id", "_j"), F.col("least") == F.col("_j"), "left").select(
        "_label", "_length", "_digest", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "least").alias("component"))
    got = rows.select("id", "label", "length", "digest").join(
        groups, (F.col("label") == F.col("_label")) & (F.col("length") == F.col("_length")) & (F.col("digest") == F.col("_digest")), "left")
    component = F.coalesce("component", "id")
    return got.select(F.when(F.col("id") != LAST, F.col("id")).alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                      F.when(component != LAST, component).alias("component_id"), (component == F.col("id")).alias("kept"))


def op5_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector's links and group."""
    return link(table(spark, folder, "embeddings").select("vec_id", "label", "embedding"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
 ok AS (SELECT vec_id, label, x FROM v WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0
  AND list_dot_product(x, x) > 0),
 e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
 r(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y),
 c AS (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY x),
 n AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a)
SELECT v.vec_id, coalesce(n, 0) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN c ON c.vec_id = v.vec_id LEFT JOIN n ON n.vec_id = v.vec_id
"""
