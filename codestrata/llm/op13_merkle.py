"""Merkle manifest of a data set by lag and lead windows.

A leaf digests one document; the documents of a language, in order of id, are its leaves. Every ``ARITY`` consecutive
nodes become their parent until one is left, the language's subroot; the subroots, in order of language, give the
root the same way. Per level one window does the work: lags and leads at the fixed offsets 1 to 7, masked by a node's
place in its run (slot mod 8) and by where the level ends, are the node's siblings on its left and right, and a run's
first row hashes itself and its leads to the parent.

Windows never hold a language: their key is the language and a chunk of whole runs (``CHUNK`` slots), so a language with a
third of all documents is dealt like any other. A level is an eighth of the one below it. Proofs come from the top: a
node's path is its own siblings and then its parent's path, joined on the parent's slot; a leaf's path is about one entry for
each level. ``verify`` folds a leaf over its path, so documents are checked one by one without the tree.

Nulls and edge cases: a null field is written ``-``; null languages are a language of their own, first in order; null ids
come first in theirs. Rows that share an id, a null one too, are leaves of their own, ordered by digest (equal rows have
equal leaves, so any order gives the same tree). Columns other than the five fields do not enter a leaf. A language of one
document has its leaf as subroot; an only subroot is the root. An empty table gives no rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.llm.common import cut, table, with_slots

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 8
CHUNK = 64  # slots of a window, whole runs

# Names inside the tree; inputs are narrowed to their key, order and digest first, so nothing clashes.
PATH = "array<struct<l:string,r:string>>"


def _up(name: str) -> Column:
    """The parent's slot, in whole numbers."""
    return F.expr(f"{name} div {ARITY}")


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, one after another."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """How a value enters a leaf: ``-``, or its length in bytes, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column | None = None) -> Column:
    """The digest of a document, with another text in place of its own if one is given."""
    values = [F.col(name) for name in FIELDS[:-1]] + [F.col("text") if text is None else text]
    return digest(*map(field, values))


def level_of(nodes: DataFrame) -> DataFrame:
    """``nodes`` (tree, slot, last, digest) with ``left`` and ``right``, the digests of the run's other nodes, and
    ``parent``, which is null but on a run's first row."""
    place = F.pmod("slot", F.lit(ARITY))
    window = Window.partitionBy("tree", F.expr(f"slot div {CHUNK}")).orderBy("slot")
    left = [F.when(place >= d, F.lag("digest", d).over(window)) for d in range(ARITY - 1, 0, -1)]
    # beyond the end of a level there is no row, so the lead is null there
    right = [F.when(place + d < ARITY, F.lead("digest", d).over(window)) for d in range(1, ARITY)]
    sided = nodes.select("*", F.concat_ws("", *left).alias("left"), F.concat_ws("", *right).alias("right"))
    return sided.withColumn("parent", F.when(place == 0, digest("digest", "right")))


def grow(leaves: DataFrame) -> list[DataFrame]:
    """All levels of a forest, leaves first, from (tree, slot, last, digest); a tree ends where ``last`` is 0."""
    levels = []
    nodes = leaves
    while True:
        levels.append(cut(level_of(nodes)))
        open_ = levels[-1].where("last > 0 and parent is not null")
        if open_.isEmpty():
            return levels
        nodes = open_.select("tree", _up("slot").alias("slot"), _up("last").alias("last"), F.col("parent").alias("digest"))


def tops(levels: list[DataFrame]) -> DataFrame:
    """(tree, digest) of every tree's last node."""
    return reduce(DataFrame.unionByName, [level.where("last = 0").select("tree", "digest") for level in levels])


def paths(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """(tree, slot, digest, path, and the columns of ``above``) of every leaf: its siblings level by level and then the path that
    ``above`` (tree, path, ...) gives its tree."""
    known = above.select(F.col("tree").alias("_tree"), *[c for c in above.columns if c != "tree"])
    carried = [c for c in known.columns if c not in ("_tree", "path")]
    out = None
    for level in reversed(levels):
        here = level.where("last = 0").join(known, F.col("tree").eqNullSafe(F.col("_tree"))).select("tree", "slot", "digest", "path", *carried)
        inner = level.where("last > 0")
        if out is not None:
            up = out.select(F.col("tree").alias("_tree"), F.col("slot").alias("_slot"), F.col("path").alias("_path"), *carried)
            below = inner.join(up, F.col("tree").eqNullSafe(F.col("_tree")) & (_up("slot") == F.col("_slot")))
            own = F.array(F.struct(F.col("left").alias("l"), F.col("right").alias("r")))
            here = here.unionByName(below.select("tree", "slot", "digest", F.concat(own, F.col("_path")).alias("path"), *carried))
        out = here if level is levels[0] else cut(here)
    return out


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` (tree, ...) with slot and last, the largest slot of the tree."""
    slotted = with_slots(nodes, ["tree"], order, "slot")
    ends = slotted.groupBy("tree").agg(F.max("slot").alias("last"))
    return slotted.join(ends.select(F.col("tree").alias("_tree"), "last"), F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree")


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, start, lambda node, step: digest(step["l"], node, step["r"]))


def siblings(path: Column) -> Column:
    """All digests of a path in one text, level by level and left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["l"], step["r"])), "")


def manifest(docs: DataFrame, suspect: Column | None = None) -> DataFrame:
    """(doc_id, lang, leaf, presented, subroot, root, path) for every document. ``suspect`` is another leaf digest, an expression
    over the columns of ``docs``, that ``verify`` is to check against the tree; the document's own by default."""
    spark = docs.sparkSession
    own = leaf()
    leaves = docs.select(F.col("lang").alias("tree"), F.col("doc_id").alias("id"), own.alias("digest"), (own if suspect is None else suspect).alias("presented"))
    leaves = cut(placed(cut(leaves), ["id", "digest"]))  # texts are hashed once, before rows are sorted
    levels = grow(leaves.select("tree", "slot", "last", "digest"))
    subroots = cut(tops(levels))
    upper = cut(placed(subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("name"), "digest"), ["name"]))
    crown = grow(upper.select("tree", "slot", "last", "digest"))
    root = tops(crown).select("tree", F.col("digest").alias("root"))
    lang_paths = paths(crown, root.withColumn("path", F.from_json(F.lit("[]"), PATH)))
    names = upper.select("slot", "name").join(lang_paths, "slot").select(F.col("name").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
    found = paths(levels, cut(names)).select(F.col("tree").alias("_tree"), F.col("slot").alias("_slot"), F.col("digest").alias("leaf"), "path", "subroot", "root")
    rows = leaves.select("tree", "slot", F.col("id").alias("doc_id"), "presented")
    return rows.join(found, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("slot") == F.col("_slot"))).select(
        "doc_id", F.col("tree").alias("lang"), "leaf", "presented", "subroot", "root", "path")


def verify(rows: DataFrame) -> DataFrame:
    """``rows`` of a manifest with the root that the presented leaf and the path give, and whether it is the manifest's."""
    return rows.withColumn("folded_root", fold(F.col("presented"), F.col("path"))).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's proof, with the texts of a third of the documents tampered with."""
    docs = table(spark, folder, "documents").select(*FIELDS)
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    checked = verify(manifest(docs, leaf(F.when(chosen, lowered).otherwise(F.col("text")))))
    return checked.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", "verified")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, lang, text, CAST(doc_id AS VARCHAR) AS id, CAST(n_chars AS VARCHAR) AS n, source,
  list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
   lambda crc, b: list_reduce(list_prepend(xor(crc, b), CAST(range(8) AS BIGINT[])), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END)) AS crc FROM documents),
 f AS (SELECT *, coalesce(strlen(id) || ':' || id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n) || ':' || n, '-') AS head,
  CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other FROM d),
 leaves AS (SELECT doc_id, coalesce('l' || lang, '') AS tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS shown FROM f),
 base AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS slot FROM leaves),
 t(level, tree, slot, digest) AS (
  SELECT 0, tree, slot, leaf FROM base
  UNION ALL SELECT * FROM (
   WITH p AS (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM t)
   SELECT level + 1 AS level, tree, slot // 8 AS slot, sha256(string_agg(digest, '' ORDER BY slot)) AS digest FROM p WHERE n > 1 GROUP BY level, tree, slot // 8)),
 h AS (SELECT tree, max(level) AS top FROM t GROUP BY tree),
 subs AS (SELECT t.tree, t.digest, row_number() OVER (ORDER BY t.tree) - 1 AS slot FROM t JOIN h ON h.tree = t.tree AND h.top = t.level),
 r(level, slot, digest) AS (
  SELECT 0, slot, digest FROM subs
  UNION ALL SELECT * FROM (
   WITH p AS (SELECT *, count(*) OVER () AS n FROM r)
   SELECT level + 1 AS level, slot // 8 AS slot, sha256(string_agg(digest, '' ORDER BY slot)) AS digest FROM p WHERE n > 1 GROUP BY level, slot // 8)),
 root AS (SELECT digest AS root FROM r ORDER BY level DESC LIMIT 1),
 every AS (SELECT level, tree, slot, digest FROM t UNION ALL SELECT top + 1 + level, h.tree, slot, r.digest FROM h, r),
 runs AS (SELECT level, tree, slot // 8 AS run, list(digest ORDER BY slot) AS members FROM every GROUP BY level, tree, slot // 8),
 hr AS (SELECT max(level) AS crown FROM r),
 walk AS (
  SELECT b.doc_id, b.tree, b.slot AS id, 0 AS level, b.slot AS place, b.shown AS node, CAST('' AS VARCHAR) AS proof FROM base b
  UNION ALL
  SELECT w.doc_id, w.tree, w.id, w.level + 1, CASE WHEN w.level = h.top THEN s.slot ELSE w.place // 8 END,
   CASE WHEN w.level = h.top THEN w.node ELSE sha256(array_to_string(u.members[1:w.place % 8], '') || w.node || array_to_string(u.members[w.place % 8 + 2:], '')) END,
   CASE WHEN w.level = h.top THEN w.proof ELSE w.proof || array_to_string(u.members[1:w.place % 8], '') || array_to_string(u.members[w.place % 8 + 2:], '') END
  FROM walk w JOIN h ON h.tree = w.tree JOIN subs s ON s.tree = w.tree, hr JOIN runs u ON true
  WHERE u.tree = w.tree AND u.level = w.level AND u.run = w.place // 8 AND w.level < h.top + 1 + hr.crown)
SELECT b.doc_id, b.leaf, s.digest AS subroot, root, sha256(w.proof) AS proof_sha256, w.node AS folded_root, w.node = root AS verified
FROM base b JOIN h ON h.tree = b.tree JOIN subs s ON s.tree = b.tree JOIN walk w ON w.tree = b.tree AND w.id = b.slot, hr, root WHERE w.level = h.top + 1 + hr.crown
"""
