"""MinHash near-dedup by chosen-path set similarity joins.

Sets are the distinct word shingles of a text. Equal sets are one class (one row from here on). Every class has a
signature of ``POSITIONS`` minhash values, its selected tokens. Trees grow side by side, one from each of ``TREES``
chosen positions; at a node ``BRANCHES`` paths go on, each by ``STEP`` positions chosen by a hash of the node, and
members that agree on all of a path's values meet in a child. Two sets of similarity J agree on a position with
probability J, so a pair at 0.85 begins in ten trees with all but probability 6e-9, and of a pair in a tree at least one
path goes on for ever with probability 0.92 (ten trees: all but 1e-10), while unlike sets part in a few levels. All trees
read one signature, so its filter (``SLACK``) is a floor of its own: a pair at 0.85 is dropped with probability 1.3e-9.

Per level:
* members of a node that are already connected need no comparison, and a node in one component is finished.
* a node of at most ``SMALL`` members is compared exhaustively inside a task: signatures first (agreement far below the
  threshold already suffices), then the full sets of the clusters that leaves, by one product of their membership
  matrix. What leaves a task is an edge per member, never the pairs.
* a larger node compares its members with one pivot and branches. If all but ``FEW`` of its members are connected, those
  few are compared with all and the node is finished.
* links confirmed on full sets extend the components. Full sets are built again from the texts of candidates only.
Levels go on until no node is left, so no bucket is capped: from level ``DEEPEST`` on, nodes that still would not split
are compared exhaustively whatever their size. The trees grow in ``BATCHES``: the first ones find most links, which end
most nodes of the others.

A large node is only rows: sizes, pivots and components are aggregates, a pivot meets members in a join that can be
split. A group of near copies becomes one component through its pivots, which ends its nodes.

Nulls and edge cases: a null or blank text has no set, links with nothing and is kept; a text of fewer than three words
has its whole sequence as its one shingle; null ids order after all others and their component, if its smallest id is one,
is null. Rows that share an id, a null one too, are told apart by a number of their own: rows repeated in full link as
equal sets and one of them is kept. Extra columns are ignored by ``link`` and kept by ``keep_one``. An empty table
gives no rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm.common import LAST, components, cut, drop, free, numbered, table
from codestrata.llm.shingles import Words, rolled

SHINGLE = 3
PERCENT = 85
POSITIONS = 128
TREES = 10
BRANCHES, STEP = 3, 3
BATCHES = (2, 8)
SMALL, FEW = 4096, 32
DEEPEST = 12
UNIT_BYTES = 8 << 20  # of member data in one task's call
SLACK = 0.21          # the estimate may lie this far below the threshold: at 0.85 82 of 128 positions, missed with probability 1.3e-9 (agreeing bytes by chance only add)
BROADCAST_ROWS = 500_000

_rng = np.random.Generator(np.random.PCG64(20240607))
_MULTIPLY = _rng.integers(0, 1 << 32, POSITIONS, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, POSITIONS, dtype=np.uint32)


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ends, hashes): the sorted distinct shingle hashes of each text, one after another."""
    words = Words(texts, lower=True)
    n = len(words.codes)
    hashes = words.hashes()
    out, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n >= k:
        out = rolled(hashes, k)
        inside = words.left()[:len(out)] >= k
        out, owner = out[inside], words.owner[:len(inside)][inside]
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        whole = np.array([rolled(hashes[a:a + c], c)[0] ^ np.uint64(c) for a, c in zip(words.starts[short], words.counts[short], strict=True)], dtype=np.uint64)
        out, owner = np.concatenate([out, whole]), np.concatenate([owner, short])
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    if len(out):
        new = np.concatenate([[True], (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])])
        out, owner = out[new], owner[new]
    return np.cumsum(np.bincount(owner, minlength=len(texts))).astype(np.int64), out


def _slices_of(batches: Iterator[pa.RecordBatch], size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about ``size`` bytes of text, so that arrays stay small."""
    for batch in batches:
        rows, at = max(1, int(batch.num_rows * size / max(batch.nbytes, 1))), 0
        while at < batch.num_rows:
            yield batch.slice(at, rows)
            at += rows


def _describe(k: int):
    """Per text: size of the set, a 128-bit digest of it, its signature, and a byte of each signature value."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices_of(batches):
            ends, sets = shingle_sets(batch.column(1), k)
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            some = np.flatnonzero(ends > starts)
            signature = np.zeros((len(some), POSITIONS), np.uint32)
            if len(some):
                low = (sets >> np.uint64(32)).astype(np.uint32)
                for i in range(POSITIONS):
                    signature[:, i] = np.minimum.reduceat(low * _MULTIPLY[i] + _ADD[i], starts[some])
            digests, marks, briefs = ([None] * batch.num_rows for _ in range(3))
            for row, at in enumerate(some.tolist()):
                digests[at] = xxhash.xxh3_128_digest(sets[starts[at]:ends[at]])
                marks[at] = signature[row].tobytes()
                briefs[at] = (signature[row] & np.uint32(255)).astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends - starts), *[pa.array(x, pa.binary()) for x in (digests, marks, briefs)]],
                                             names=["id", "n", "digest", "signature", "brief"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices_of(batches):
            ends, sets = shingle_sets(batch.column(1), k)
            starts = np.concatenate([[0], ends[:-1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sets[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())],
                                             names=["id", "shingles"])

    return run


def _estimated(least: float):
    """Pairs whose signatures agree on at least that share of positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, POSITIONS) for c in ("sa", "sb"))
                near = pa.array((left == right).mean(axis=1) >= least)
                yield batch.select(["a", "b"]).filter(near)

    return run


def _confirmed(percent: int):
    """Pairs whose full sets reach the threshold, in whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("xa"), batch.column("xb"), strict=True):
                a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


ROWS = 512  # of a square matrix looked at together


def _roots(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric, reflexive relation the smallest row it reaches."""
    size = len(near)
    roots = np.arange(size, dtype=np.int32)
    while True:
        smaller = np.concatenate([np.where(near[i:i + ROWS], roots[None, :], np.int32(size)).min(axis=1) for i in range(0, size, ROWS)])
        smaller = smaller[smaller]
        if (smaller == roots).all():
            return roots
        roots = smaller


def _runs(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """(begin, end) of runs of equal rows."""
    if len(columns[0]):
        new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0), [True]])
        at = np.flatnonzero(new).tolist()
        yield from zip(at, at[1:], strict=False)


def _clusters(least: float, percent: int):
    """Members of small nodes in clusters of agreeing signatures that hold more than one component."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("node", "ascending"), ("id", "ascending")])
        node, ids, n, component = (rows.column(c).to_numpy() for c in ("node", "id", "n", "component"))
        marks = rows.column("brief")
        clusters, members, known = [], [], []
        for a, b in _runs(node):
            briefs = np.frombuffer(b"".join(marks.slice(a, b - a).to_pylist()), np.uint8).reshape(b - a, POSITIONS)
            near, size = np.zeros((b - a, b - a), bool), n[a:b]
            for i in range(b - a):
                fits = np.flatnonzero(100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i]))
                near[i, fits] = np.count_nonzero(briefs[fits] == briefs[i], axis=1) >= least * POSITIONS
            roots = _roots(near)
            for root in np.unique(roots).tolist():
                inside = np.flatnonzero(roots == root)
                if len(inside) > 1 and len(np.unique(component[a:b][inside])) > 1:
                    name = _named(ids[a:b][inside])  # equal clusters of different nodes have one name
                    clusters += [name] * len(inside)
                    members += ids[a:b][inside].tolist()
                    known += component[a:b][inside].tolist()
        return pa.table([pa.array(clusters, pa.int64()), pa.array(members, pa.int64()), pa.array(known, pa.int64())], names=["cluster", "id", "component"])

    return run


def _named(ids: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(ids.tobytes()) - (1 << 63)


def _linked(percent: int):
    """(a, b) edges that connect the members of each cluster as far as their full sets link them."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("cluster", "ascending"), ("id", "ascending")])
        cluster, ids = (rows.column(c).to_numpy() for c in ("cluster", "id"))
        sets = rows.column("shingles")
        out_a, out_b = [], []
        for a, b in _runs(cluster):
            raw = [np.frombuffer(x, np.uint64) for x in sets.slice(a, b - a).to_pylist()]
            size = np.array([len(x) for x in raw], np.int64)
            kinds, code, count = np.unique(np.concatenate(raw), return_inverse=True, return_counts=True)
            shared = np.flatnonzero(count > 1)  # what one member has alone links nothing
            column = np.full(len(kinds), -1, np.int64)
            column[shared] = np.arange(len(shared))
            code, owner = column[code], np.repeat(np.arange(b - a), size)
            owner, code = owner[code >= 0], code[code >= 0]
            both = np.zeros((b - a, b - a), np.float32)
            for low in range(0, len(shared), 4096):
                here = (code >= low) & (code < low + 4096)
                part = np.zeros((b - a, min(4096, len(shared) - low)), np.float32)
                part[owner[here], code[here] - low] = 1
                both += part @ part.T
            linked = np.eye(b - a, dtype=bool)  # whole numbers far below 2^24, exact as floats until multiplied
            for i in range(0, b - a, ROWS):
                some = both[i:i + ROWS].astype(np.int64)
                linked[i:i + ROWS] |= 100 * some >= percent * (size[i:i + ROWS, None] + size[None, :] - some)
            roots = _roots(linked)
            far = np.flatnonzero(roots != np.arange(b - a))
            out_a += ids[a:b][roots[far]].tolist()
            out_b += ids[a:b][far].tolist()
        return pa.table([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return run


def _value(signature: str, position) -> Column:
    """The four bytes of a signature's position."""
    return F.expr(f"substring({signature}, cast(4 * ({position}) + 1 as int), 4)")


class _Join:
    """State of one join: classes with signatures, the texts, and the links found so far."""

    def __init__(self, classes: DataFrame, texts: DataFrame, k: int, percent: int):
        self.classes, self.texts, self.k, self.percent = classes, texts, k, percent
        self.links: DataFrame | None = None
        self.labels: DataFrame | None = None

    def component(self, rows: DataFrame, id_: str, name: str) -> DataFrame:
        """``rows`` with the component of an id; an id without links is its own."""
        if self.labels is None:
            return rows.withColumn(name, F.col(id_))
        known = self.labels.select(F.col("id").alias("_id"), F.col("component").alias("_component"))
        return rows.join(known, F.col(id_) == F.col("_id"), "left").withColumn(name, F.coalesce("_component", id_)).drop("_id", "_component")

    def sets(self, ids: DataFrame) -> DataFrame:
        """(id, shingles) of the named ids, from their texts; ids are sent to the scan while they are few, else joined by
        a shuffle."""
        ids = cut(ids)
        few = ids.count() <= BROADCAST_ROWS
        wanted = self.texts.join(F.broadcast(ids) if few else ids, "id", "left_semi")
        sets = cut(wanted.dropDuplicates(["id"]).select("id", "text").mapInArrow(_sets(self.k), "id long, shingles binary"))
        drop(ids)
        return sets

    def pairs(self, pairs: DataFrame) -> DataFrame | None:
        """Links among candidate pairs (a < b)."""
        marks = self.classes.select("id", "brief")
        near = cut(pairs.join(marks.select(F.col("id").alias("a"), F.col("brief").alias("sa")), "a")
                   .join(marks.select(F.col("id").alias("b"), F.col("brief").alias("sb")), "b")
                   .select("a", "b", "sa", "sb").mapInArrow(_estimated(self.percent / 100 - SLACK), "a long, b long"))
        if near.isEmpty():
            drop(near)
            return None
        sets = self.sets(near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id"))).distinct())
        linked = cut(near.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("xa")), "a")
                     .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("xb")), "b")
                     .select("a", "b", "xa", "xb").mapInArrow(_confirmed(self.percent), "a long, b long"))
        drop(near, sets)
        return linked

    def exhaustive(self, rows: DataFrame, count: int) -> DataFrame | None:
        """Links inside small nodes, ``rows`` (node, id, n, component); edges that connect what is linked."""
        tasks = max(1, -(-count * POSITIONS // UNIT_BYTES), -(-count // SMALL))
        loaded = rows.join(self.classes.select("id", "brief"), "id").withColumn("_task", F.pmod(F.xxhash64("node"), F.lit(tasks)))
        clusters = cut(loaded.groupBy("_task").applyInArrow(_clusters(self.percent / 100 - SLACK, self.percent), "cluster long, id long, component long").distinct())
        count = clusters.count()
        if not count:
            drop(clusters)
            return None
        sets = self.sets(clusters.select("id").distinct())
        size = sets.agg(F.avg(F.octet_length("shingles"))).first()[0]
        tasks = max(1, int(count * size // UNIT_BYTES) + 1)
        loaded = clusters.select("cluster", "id").join(sets, "id").withColumn("_task", F.pmod(F.xxhash64("cluster"), F.lit(tasks)))
        linked = cut(loaded.groupBy("_task").applyInArrow(_linked(self.percent), "a long, b long").distinct())
        drop(clusters, sets)
        return linked

    def add(self, found: list[DataFrame | None]) -> None:
        """Extends links and components."""
        new = [f for f in found if f is not None and not f.isEmpty()]
        if new:
            for f in new:
                self.links = f if self.links is None else self.links.unionByName(f)
            self.labels = components(self.links)

    def run(self) -> DataFrame | None:
        """(id, component) of all linked classes, or None."""
        positions = np.random.Generator(np.random.PCG64(7)).permutation(POSITIONS)[:TREES].tolist()
        for size in BATCHES:
            self.grow(positions[:size])
            positions = positions[size:]
        return self.labels

    def grow(self, positions: list[int]) -> None:
        """All levels of the trees that begin at the given positions."""
        roots = F.explode(F.array(*[F.xxhash64(F.lit(p), _value("signature", p)) for p in positions]))
        members = self.classes.select("id", "n", roots.alias("node"))
        level, read = 1, []
        while True:
            # nodes of one member end here
            sizes = members.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
            placed = cut(self.component(members.join(sizes.select("node"), "node", "left_semi"), "id", "component"))
            each = placed.groupBy("node", "component").agg(F.count(F.lit(1)).alias("c"))
            nodes = cut(each.groupBy("node").agg(F.sum("c").alias("size"), F.max("c").alias("most"), F.max_by("component", "c").alias("main"))
                        .where("most < size"))
            drop(*read)  # the level above, of which these members came
            read = [placed, nodes]
            small = F.col("size") <= SMALL
            inside = nodes.agg(F.sum(F.when(small, F.col("size"))), F.sum(F.when(~small, F.col("size")))).first()
            rows = placed.select("node", "id", "n", "component")
            found = [self.exhaustive(rows.join(nodes.where(small).select("node"), "node", "left_semi"), inside[0])] if inside[0] else []
            if not inside[1]:
                self.add(found)
                drop(*read)
                return
            large = nodes.where(~small)
            few = F.lit(level >= DEEPEST) | (F.col("size") - F.col("most") <= FEW)
            outside = rows.join(large.where(few).select("node", "main"), "node").where("component <> main").select(
                "node", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("component").alias("cx"))
            branching = rows.join(large.where(~few).select("node"), "node", "left_semi")
            order = F.xxhash64("node", "id")
            pivots = branching.groupBy("node").agg(*[F.min_by(c, order).alias(x) for c, x in (("id", "x"), ("n", "nx"), ("component", "cx"))])
            similar = 100 * F.least("n", "nx") >= self.percent * F.greatest("n", "nx")
            pairs = rows.join(outside.unionByName(pivots), "node").where(similar & (F.col("component") != F.col("cx"))).select(
                F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b")).distinct()
            self.add([*found, self.pairs(pairs)])
            paths = []
            for i in range(BRANCHES):
                steps = [_value("signature", f"pmod(xxhash64(node, {i}, {j}), {POSITIONS})") for j in range(STEP)]
                paths.append(F.xxhash64("node", F.lit(i), *steps))
            members = branching.join(self.classes.select("id", "signature"), "id").select("id", "n", F.explode(F.array(*paths)).alias("node"))
            level += 1


def _grouped(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, n, component) for every row of ``texts`` (id, text), whose ids are all different."""
    signed = cut(texts.mapInArrow(_describe(k), "id long, n long, digest binary, signature binary, brief binary"))
    # rows of one digest have one set, so any of their signatures will do
    classes = cut(signed.where("n > 0").groupBy("digest").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n", "signature", "brief")]))
    described = cut(signed.select("id", "n", "digest"))
    drop(signed)  # signatures are needed once a class, and classes have theirs
    labels = _Join(classes.select("id", "n", "signature", "brief"), texts.where("text is not null"), k, percent).run()
    groups = classes.select(F.col("digest").alias("_digest"), F.col("id").alias("least"))
    if labels is not None:
        groups = groups.join(labels, groups["least"] == labels["id"], "left").select("_digest", F.coalesce("component", "least").alias("least"))
    got = described.join(groups, F.col("digest") == F.col("_digest"), "left")
    return got.select("id", "n", F.coalesce("least", "id").alias("component"))


def link(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text)."""
    rows, own = numbered(docs.select("doc_id", "text"), "_row")
    got = _grouped(rows.select(F.col("_row").alias("id"), "text"), k, percent)
    if own:
        doc_id, component_id = (F.when(F.col(c) != LAST, F.col(c)) for c in ("id", "component"))
    else:
        for c in ("id", "component"):
            got = got.join(rows.select(F.col("_row").alias(f"_{c}"), F.col("doc_id").cast("long").alias(f"{c}_name")), F.col(c) == F.col(f"_{c}"))
        doc_id, component_id = F.col("id_name"), F.col("component_name")
    return got.select(doc_id.alias("doc_id"), F.col("n").alias("n_shingles"), component_id.alias("component_id"),
                      (F.col("component") == F.col("id")).alias("kept"))


def keep_one(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, also: tuple[tuple[int, int], ...] = ()) -> DataFrame:
    """``docs`` without the documents that another one of their group stands for. ``also`` names further measures
    (shingle words, percent): two documents link if any measure links them, and groups are the components of all links."""
    row = free(docs, "_row")[0]
    rows, _ = numbered(docs, row)
    texts = rows.select(F.col(row).alias("id"), "text")
    pieces = [_grouped(texts, *measure).where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
              for measure in ((k, percent), *also)]
    if also:
        # a star per group of each measure; stars that share a document become one group
        joined = components(reduce(DataFrame.unionByName, pieces))
        gone = joined.where("id <> component").select(F.col("id").alias(row))
    else:
        gone = pieces[0].select(F.col("a").alias(row))
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def op10_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's set size, group and whether it stays."""
    return link(table(spark, folder, "documents").select("doc_id", "text"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT doc_id, i, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, least(len(w), 1)))) AS i FROM d)),
 u AS (SELECT DISTINCT doc_id, g FROM s),
 n AS (SELECT doc_id, count(*) AS n FROM u GROUP BY doc_id),
 shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 e AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
 sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, sym.b FROM r JOIN sym ON sym.a = r.y),
 c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.doc_id = d.doc_id
"""
