"""Reachability on the commit graph by labels, in rounds that grow with logarithms.

Parents are (hash, parent, ord), ord 0 for the first parent. A first-parent history is found by contraction: a round takes
about a quarter of the commits out of the pointers, so all rounds together read a few times the commits; one task follows the
few that are left, and the commits passed over come back level by level. Many short histories are followed by doubling
instead. Every other commit is labelled with the oldest commit of such a history that reaches it (its *entry*): commits a
merge brought in are those whose entry is the merge, and commits between two points follow from entries, so no merge carries
its ancestry along. Only labels that rose move on: parent by parent at first, and from ``STEPS`` rounds on also along first
parents by doubling. Every table has at most a row for each edge and is written between rounds."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from codestrata.session import deleted, stored

EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"  # fixed value: the hash of a tree without files
FOLLOWED = 1 << 19  # so many pointers and heads at most are followed in one task
SHORT = 8  # commits a head, on average, from which on doubling is the shorter way
STEPS = 8  # rounds in which labels move one parent at a time


def first_parents(parents: DataFrame) -> DataFrame:
    return parents.filter("ord = 0").select("hash", F.col("parent").alias("to"))


def _twice(jump: DataFrame) -> DataFrame:
    """Pointers (hash, to, span) twice as long."""
    on = jump.select(F.col("hash").alias("to"), F.col("to").alias("_to"), F.col("span").alias("_span"))
    return stored(jump.join(on, "to").select("hash", F.col("_to").alias("to"), (F.col("span") + F.col("_span")).alias("span")))


def _spliced(pointers: DataFrame, level: int) -> DataFrame:
    """(hash, to, span, keep, over, before): the pointers (hash, to, span, keep) without some commits that none of the others points to
    any more: those whose coin shows tails and their target's heads, so no two in a row go. ``over`` is the commit a pointer now passes
    over, ``before`` the steps up to it. A commit marked ``keep`` stays."""
    def coin(node: str) -> Column:
        return F.xxhash64(node, F.lit(level)).bitwiseAND(F.lit(1)) == 1

    goes = ~F.col("keep") & ~coin("hash") & coin("to")
    gone = pointers.filter(goes).select(F.col("hash").alias("over"), F.col("to").alias("_to"), F.col("span").alias("_span"))
    left = pointers.filter(~goes)
    none = F.lit(None)
    still = left.filter(coin("to")).select("hash", "to", "span", "keep", none.cast(pointers.schema["hash"].dataType).alias("over"), none.cast("long").alias("before"))
    moved = left.filter(~coin("to")).join(gone, F.col("to") == F.col("over"), "left").select(
        "hash", F.coalesce("_to", "to").alias("to"), (F.col("span") + F.coalesce("_span", F.lit(0))).alias("span"), "keep", "over",
        F.when(F.col("over").isNotNull(), F.col("span")).alias("before"))
    return still.unionByName(moved)


def _walk(parts: Iterator) -> Iterator:
    """(head, hash, step) from rows (hash, to, span) of pointers and, with a null span, heads: at most ``FOLLOWED``."""
    import pyarrow as pa
    import pyarrow.compute as pc

    parts = list(parts)
    if not parts:
        return
    rows = pa.Table.from_batches(parts)
    ends = rows.filter(pc.is_null(rows.column("span"))).column("hash").combine_chunks()
    rows = rows.filter(pc.is_valid(rows.column("span"))).combine_chunks()
    names, to = (rows.column(c).combine_chunks() for c in ("hash", "to"))
    start, onward = (pc.fill_null(pc.index_in(x, value_set=names), -1).to_pylist() for x in (ends, to))
    spans = rows.column("span").to_pylist()

    def batch(heads: list[int], at: list[int], steps: list[int]):
        return pa.RecordBatch.from_arrays([ends.take(pa.array(heads, pa.int64())), to.take(pa.array(at, pa.int64())), pa.array(steps, pa.int64())], ["head", "hash", "step"])

    yield pa.RecordBatch.from_arrays([ends, ends, pa.array([0] * len(ends), pa.int64())], ["head", "hash", "step"])
    heads, at, steps = [], [], []
    for head, i in enumerate(start):
        step = 0
        while i >= 0:
            step += spans[i]
            heads.append(head)
            at.append(i)
            steps.append(step)
            i = onward[i]
            if len(at) == 1 << 16:
                yield batch(heads, at, steps)
                heads, at, steps = [], [], []
    yield batch(heads, at, steps)


def _followed(pointers: DataFrame, heads: DataFrame) -> DataFrame:
    """(head, hash, step) of few ``pointers`` (hash, to, span), followed from ``heads`` in one task."""
    node = pointers.schema["hash"].dataType
    starts = heads.select("hash", F.lit(None).cast(node).alias("to"), F.lit(None).cast("long").alias("span"))
    schema = StructType().add("head", node).add("hash", node).add("step", LongType())
    return pointers.select("hash", "to", "span").unionByName(starts).repartition(1).mapInArrow(_walk, schema)


def _doubled(pointers: DataFrame, heads: DataFrame) -> DataFrame:
    """(head, hash, step) of ``pointers`` (hash, to, span), followed from ``heads`` by doubling: one round finds as many commits as all
    before it."""
    seen = heads.select(F.col("hash").alias("head"), "hash", F.lit(0).cast("long").alias("step"))
    jump = pointers.select("hash", "to", "span")
    while True:
        found = stored(seen.join(jump, "hash").select("head", F.col("to").alias("hash"), (F.col("step") + F.col("span")).alias("step")))
        if found.isEmpty():
            return seen
        seen, jump = seen.unionByName(found), _twice(jump)


def chains(first: DataFrame, heads: DataFrame) -> DataFrame:
    """(head, hash, step): the first-parent histories of ``heads`` (hash), from ``first`` (hash, to)."""
    heads, pointers = stored(heads.select("hash")), stored(first.select("hash", "to", F.lit(1).cast("long").alias("span")))
    ends, rows, levels = heads.count(), pointers.count(), []
    if rows + ends > FOLLOWED:
        whole = pointers
        pointers = pointers.join(heads.withColumn("keep", F.lit(True)), "hash", "left").withColumn("keep", F.col("keep").isNotNull())
        while rows + ends > FOLLOWED and rows > SHORT * ends:
            levels.append(stored(_spliced(pointers, len(levels))))
            pointers = levels[-1].select("hash", "to", "span", "keep")
            rows = pointers.count()
            if len(levels) == 1:
                deleted(whole)
    chain = _followed(pointers, heads) if rows + ends <= FOLLOWED else _doubled(pointers, heads)
    for level in reversed(levels):
        passed = level.filter("over is not null").select("hash", "over", "before")
        here, over = F.struct("hash", "step"), F.struct(F.col("over").alias("hash"), (F.col("step") + F.col("before")).alias("step"))
        both = F.when(F.col("over").isNull(), F.array(here)).otherwise(F.array(here, over))
        chain = chain.join(passed, "hash", "left").select("head", F.explode(both).alias("_c")).select("head", "_c.hash", "_c.step")
    chain = stored(chain)
    deleted(*levels)
    return chain


def entries(parents: DataFrame, heads: DataFrame) -> DataFrame:
    """(head, hash, step, entry_step, on_chain) of every commit ``heads`` reach: its place on its head's first-parent history, or the
    step of the oldest commit there that reaches it. No two heads may reach one commit through ``parents``."""
    chain = chains(first_parents(parents), heads)
    # edges whose parent is not on a history, with the label of the commit if it is on one: only those carry labels
    off = parents.join(chain.select(F.col("hash").alias("parent")), "parent", "left_anti")
    off = stored(off.join(chain.select("hash", "head", F.col("step").alias("label")), "hash", "left"))
    edges = off.filter("label is null").select("hash", F.col("parent").alias("to"), "ord")
    pointers: list[DataFrame] = []  # each twice as long as the one before, as far as they are asked for
    new = stored(_raised(off.filter("label is not null").select(F.col("parent").alias("hash"), "head", "label")))
    side, rounds = new, 0  # labels of commits on no history; a commit may have several, the largest counts
    while not new.isEmpty():
        moved = new.join(edges, "hash").select(F.col("to").alias("hash"), "head", "label")
        if rounds >= STEPS:
            moved = _along(moved, edges, pointers)
        old = side.select("hash", "head", "label", F.lit(True).alias("_old"))
        best = old.unionByName(moved.withColumn("_old", F.lit(False))).groupBy("hash").agg(
            F.max(F.when(F.col("_old"), F.col("label"))).alias("_held"), F.max(F.when(~F.col("_old"), F.col("label"))).alias("label"), F.min("head").alias("head"))
        new = stored(best.filter("label > coalesce(_held, -1)").select("hash", "head", "label"))
        side, rounds = side.unionByName(new), rounds + 1
    side = stored(_raised(side))
    deleted(off, *pointers)
    return chain.select("head", "hash", "step", F.col("step").alias("entry_step"), F.lit(True).alias("on_chain")).unionByName(
        side.select("head", "hash", F.lit(None).cast("long").alias("step"), F.col("label").alias("entry_step"), F.lit(False).alias("on_chain")))


def _along(moved: DataFrame, edges: DataFrame, pointers: list[DataFrame]) -> DataFrame:
    """Labels also taken on along first parents by doubling, until none gets further; pointers longer than the way are not made."""
    moved, at = stored(_raised(moved)), 0
    while True:
        if at == len(pointers):
            first = edges.filter("ord = 0").select("hash", "to", F.lit(1).cast("long").alias("span"))
            pointers.append(_twice(pointers[-1]) if pointers else stored(first))
        found = stored(moved.join(pointers[at], "hash").select(F.col("to").alias("hash"), "head", "label"))
        if found.isEmpty():
            return moved
        moved, at = stored(_raised(moved.unionByName(found))), at + 1


def _raised(labels: DataFrame) -> DataFrame:
    """Each commit's largest label (the oldest entry)."""
    return labels.groupBy("hash").agg(F.max("label").alias("label"), F.min("head").alias("head")).select("hash", "head", "label")


def one_head(parents: DataFrame, head: str) -> DataFrame:
    return parents.sparkSession.range(1).select(F.lit(head).cast(parents.schema["hash"].dataType).alias("hash"))


def first_parent_chain(parents: DataFrame, head: str) -> DataFrame:
    """(hash, step): the first-parent history of a commit."""
    return chains(first_parents(parents), one_head(parents, head)).select("hash", "step")


def reachable(parents: DataFrame, head: str) -> DataFrame:
    """(hash) of all commits a commit reaches, itself included."""
    return entries(parents, one_head(parents, head)).select("hash")


def commits_in_range(parents: DataFrame, base: str, head: str) -> DataFrame:
    """(hash) of the commits, merges left out, that ``head`` reaches and ``base`` does not; all for the empty tree."""
    heads, inside = one_head(parents, head), parents
    if base != EMPTY_TREE:
        # a way from the head to a commit that the base does not reach never passes one it does
        held = reachable(parents, base)
        heads = heads.join(held, "hash", "left_anti")
        inside = stored(parents.join(held.withColumnRenamed("hash", "parent"), "parent", "left_anti").select("hash", "parent", "ord"))
    found = entries(inside, heads).select("hash")
    merges = parents.filter("ord > 0").select("hash").distinct()
    return found.join(merges, "hash", "left_anti")


def resolve_range(parents: DataFrame, commits: DataFrame, head: str, base: str | None, count: int, found: DataFrame | None = None) -> DataFrame:
    """One row (base, head, empty_base, fallback): the given base if it is a commit that ``head`` reaches; otherwise the commit
    ``count`` first parents back, or the empty tree if the history is shorter, and why it fell back. ``found`` is what ``entries`` gave
    for this head, if it is known."""
    asked = base is not None and set(base) != {"0"}
    if asked:
        found = entries(parents, one_head(parents, head)) if found is None else found
        chain = found.filter("on_chain")
        known = commits.filter(F.col("hash") == base).agg((F.count(F.lit(1)) > 0).alias("_known"))
        held = found.filter(F.col("hash") == base).agg((F.count(F.lit(1)) > 0).alias("_held"))
    else:
        chain = first_parent_chain(parents, head) if found is None else found.filter("on_chain")
        known, held = (parents.sparkSession.range(1).select(F.lit(False).alias(c)) for c in ("_known", "_held"))
    chain = chain.filter(F.col("step") == max(1, count)).agg(F.max("hash").alias("_back"))
    row = chain.crossJoin(known).crossJoin(held)  # one row each
    explicit = F.when(F.col("_held"), F.lit(base))
    why = F.when(F.lit(asked) & ~F.col("_known"), F.lit(f"base {(base or '')[:12]} is not a commit in this history")).when(
        F.lit(asked) & ~F.col("_held"), F.lit(f"{(base or '')[:7]} is not an ancestor of HEAD (force push?)"))
    return row.select(F.coalesce(explicit, "_back", F.lit(EMPTY_TREE)).alias("base"), F.lit(head).alias("head"),
                      (explicit.isNull() & F.col("_back").isNull()).alias("empty_base"), why.alias("fallback"))


def pull_request_commits(parents: DataFrame, numbered: DataFrame, head: str) -> DataFrame:
    """(hash, number): the pull request that brought each commit, merges left out. ``numbered`` is (hash, number) of two-parent
    pull-request merges.

    Merges of the head's first-parent history decide. What an unnumbered merge brought is looked at again as a region of its
    own, whose history starts at the merge's second parent, so pull requests merged inside such a branch count; a round
    takes one level of nesting."""
    inner, heads, found = parents, one_head(parents, head), None
    while True:
        label = entries(inner, heads)
        at = label.filter("on_chain").select("head", F.col("step").alias("entry_step"), F.col("hash").alias("entry"))
        brought = stored(label.filter("not on_chain").join(at, ["head", "entry_step"]).select("hash", "entry").join(
            numbered.select(F.col("hash").alias("entry"), "number"), "entry", "left"))
        mine = brought.filter("number is not null").select("hash", "number")
        found = mine if found is None else found.unionByName(mine)
        region = brought.filter("number is null").select("hash", F.col("entry").alias("region"))
        if region.isEmpty():
            break
        ends = region.select(F.col("hash").alias("parent"), F.col("region").alias("_region"))
        # a second parent that an older commit reaches is of that one's region, and no head
        heads = stored(parents.filter("ord = 1").join(ends, "parent").filter("hash = _region").select(F.col("parent").alias("hash")))
        inner = stored(parents.join(region, "hash").join(ends, "parent").filter("region = _region").select("hash", "parent", "ord"))
    merges = parents.filter("ord > 0").select("hash").distinct()
    return found.join(merges, "hash", "left_anti")


def spread_over(chain: DataFrame, count: int) -> DataFrame:
    """(hash, step) of ``count`` commits spread evenly over a first-parent history, oldest and newest included."""
    span = chain.agg(F.max("step").alias("_span"))
    picks = chain.sparkSession.range(count).join(F.broadcast(span)).select(_pick(count).alias("_age")).distinct()
    aged = chain.join(F.broadcast(span)).withColumn("_age", F.col("_span") - F.col("step"))
    return aged.join(F.broadcast(picks), "_age", "left_semi").select("hash", "step")


def _pick(count: int) -> Column:
    return F.when(F.col("_span") < count, F.col("id")).otherwise(F.bround(F.col("id") * F.col("_span").cast("double") / float(max(count - 1, 1)))).cast("long")
