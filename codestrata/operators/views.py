"""Views of the stored graph: the first nodes of some labels and the relationships between them.

A label is a relation with ``key`` (what relationships name it by), ``id`` (its text) and the columns its views sort by. A view
takes the first nodes of each label as a top-k inside each task, so no label is shuffled or ranked whole, and relationships
meet the nodes shown, whose number the view's caps bound, before any text of theirs is built. Relationships of the past
carry the snapshots [valid_from_idx, valid_to_idx) they hold in; others have nulls there."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.operators.graph import MAX_RELATIONSHIPS, VIEWS

SPAN = ("valid_from_idx", "valid_to_idx")
# Views that show only nodes some relationship leads to: (view, label) -> its type.
REACHED = {("temporal", "Commit"): "AT", ("decisions", "Commit"): "EVIDENCED_BY", ("decisions", "Module"): "AFFECTS"}


class Kind(NamedTuple):
    """Relationships of one type between two labels; ``src`` and ``dst`` of ``rows`` hold the named column of the label."""

    type: str
    source: tuple[str, str]
    target: tuple[str, str]
    rows: DataFrame


def spans(relation: DataFrame, src: Column, dst: Column) -> DataFrame:
    """Relationships from validity intervals."""
    return relation.select(src.alias("src"), dst.alias("dst"), *SPAN)


def shown(view: str, labels: dict[str, DataFrame], kinds: list[Kind]) -> dict[str, DataFrame]:
    """label -> (key, id) of the nodes a view shows, the first ones in its order, ties by id."""
    out = {}
    for label, order, cap in VIEWS[view][0]:
        rows = labels[label]
        if (view, label) in REACHED:
            for kind in (k for k in kinds if k.type == REACHED[view, label] and k.target[0] == label):
                rows = rows.join(kind.rows.select(F.col("dst").alias(kind.target[1])).distinct(), kind.target[1], "left_semi")
        by = [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in order]
        out[label] = rows.orderBy(*by, "id").limit(cap).select("key", "id")
    return out


def nodes(view: str, labels: dict[str, DataFrame], kinds: list[Kind]) -> DataFrame:
    """(label, id) of a view."""
    return reduce(DataFrame.unionByName, [rows.select(F.lit(label).alias("label"), "id") for label, rows in shown(view, labels, kinds).items()])


def relationships(view: str, labels: dict[str, DataFrame], kinds: list[Kind], limit: int = MAX_RELATIONSHIPS) -> DataFrame:
    """(type, src, dst, valid_from_idx, valid_to_idx): the first relationships between the nodes of a view, by type and ids."""
    here, types, parts = shown(view, labels, kinds), VIEWS[view][1], []
    for kind in kinds:
        if (types is None or kind.type in types) and kind.source[0] in here and kind.target[0] in here:
            rows = kind.rows
            for c in SPAN:
                rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("long"))
            # at most a cap of nodes each, so both ends are small whatever the label's size
            for end, (label, by) in (("src", kind.source), ("dst", kind.target)):
                node = F.broadcast(here[label].select(F.col(by).alias(end), F.col("id").alias(f"_{end}")))
                rows = rows.join(node, end)
            parts.append(rows.select(F.lit(kind.type).alias("type"), F.col("_src").alias("src"), F.col("_dst").alias("dst"), *[F.col(c).cast("long").alias(c) for c in SPAN]))
    return reduce(DataFrame.unionByName, parts).orderBy("type", "src", "dst", *SPAN).limit(limit)


def hidden(view: str, labels: dict[str, DataFrame], kinds: list[Kind]) -> DataFrame:
    """(label, total, shown) of the labels a view shows in part; labels it only reaches count in full."""
    totals = reduce(DataFrame.unionByName, [
        labels[label].agg(F.count(F.lit(1)).alias("total")).select(F.lit(label).alias("label"), "total") for label, _, _ in VIEWS[view][0]])
    counts = nodes(view, labels, kinds).groupBy("label").agg(F.count(F.lit(1)).alias("shown"))
    return totals.join(F.broadcast(counts), "label", "left").select("label", "total", F.coalesce("shown", F.lit(0)).alias("shown")).where("total > shown")
