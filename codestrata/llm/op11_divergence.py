"""Source divergence audit over a vocabulary kept in minimal acyclic transducers.

1. Terms of every text, counted once per document, give the kept terms of each language: those in at least ``LEAST_DOCS`` of
   its documents. They are put in UTF-8 order by range partitions, and their places are their ordinals.
2. Each run of ``SHARD_TERMS`` ordinals of a language becomes one minimal acyclic transducer over bytes, built from its sorted
   terms (`Builder`): states with equal futures are one state, and outputs on the arcs add up to a term's ordinal.
3. Texts are streamed through the transducers again (`Transducer.ordinals`): all terms of a batch step from state to state
   together, byte by byte, and the occurrences of each ordinal are counted per language and source.
4. Counts give every group a distribution over the language's kept terms, in whole numbers; groups are compared with each
   other over all terms, and with their language term by term. Ties go by ordinal, which is the order of the terms.

Scale: a shard's transducer is bounded by its terms; ``MOST_BYTES`` of transducers are sent to the tasks at a time, and texts
are read again for the next ones, so a vocabulary of any size is counted whole. A text batch is tokenised in slices. Counts
leave a task added up per (language, source, ordinal). The comparison of the groups of a language takes blocks of terms
with all their groups (``CELLS`` numbers at a time) and of ``SIDE`` groups by ``SIDE``; what leaves a task is one sum per pair of
groups, and one row per term only among a block's ``TOP`` best of a group. The result itself has a row per pair of sources
of a language.

Nulls and edge cases: null texts, languages and sources are read as ''. A group without terms is compared like any other;
a language without kept terms gives pairs of value 0 and no terms. Repeated rows are documents of their own. Columns
other than text, lang and source are not read. An empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.llm.common import cut, table, with_slots

LEAST_DOCS = 3
TOP = 200
SHARD_TERMS = 1 << 16
MOST_BYTES = 32 << 20    # of transducers in a task at a time
SLICE_BYTES = 1 << 20    # of text tokenised at a time
KEPT_COUNTS = 1 << 18    # counts a task adds up before it passes them on
CELLS = 1 << 18          # of the matrix of terms and groups in a task at a time
SIDE = 128               # groups compared with as many at a time
SCALE = 1_000_000_000


# ---- terms of a batch of texts

_IS_TERM = np.zeros(256, bool)
_IS_TERM[65:91] = _IS_TERM[97:123] = _IS_TERM[128:] = True


def slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of about ``size`` bytes; a row that is longer stays whole."""
    for batch in batches:
        rows, at = max(1, int(batch.num_rows * size / max(batch.nbytes, 1))), 0
        while at < batch.num_rows:
            yield batch.slice(at, rows)
            at += rows


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts one after another (large binary), and each one's text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    inside = _IS_TERM[data]
    joined = inside[1:] & inside[:-1]
    breaks = ends[1:-1]
    breaks = breaks[(breaks > 0) & (breaks < len(data))]
    joined[breaks - 1] = False  # a term ends with its text
    first = inside.copy()
    first[1:] &= ~joined
    last = inside.copy()
    last[:-1] &= ~joined
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    kept = data[inside]
    kept = np.where((kept >= 65) & (kept <= 90), kept + 32, kept).astype(np.uint8)
    offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    return found, np.searchsorted(ends, starts, side="right") - 1


def _document_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, docs): in how many documents of a slice a term stands."""
    for batch in slices(batches, SLICE_BYTES):
        found, owner = terms(batch.column("text"))
        coded = found.dictionary_encode()
        codes, n = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
        once = np.unique(owner * n + codes) if len(codes) else codes
        langs = batch.column("lang").dictionary_encode()
        lang = langs.indices.to_numpy().astype(np.int64)[once // max(n, 1)]
        pairs, docs = np.unique(lang * n + once % max(n, 1), return_counts=True)
        yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(pairs // max(n, 1))).cast(pa.string()),
                                          coded.dictionary.take(pa.array(pairs % max(n, 1))).cast(pa.large_string()).cast(pa.string()), pa.array(docs, pa.int64())],
                                         names=["lang", "term", "docs"])


# ---- transducers

class Builder:
    """A minimal acyclic transducer, from terms in ascending order of their bytes.

    ``path`` holds the states of the last term that may still change. A new term closes those after their common prefix: a
    closed state that equals a known one (same arcs, same finality) is replaced by it. A state's size is the number of
    terms that end below it, so an arc's output, what sorts before it in its state, is known as soon as its state is closed."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.states: list[tuple] = []   # (final, ((byte, target), ...)) by number
        self.sizes: list[int] = []      # terms that end in or below a state
        self.path: list[list] = [[False, []]]
        self.last = b""

    def add(self, term: bytes) -> None:
        shared = 0
        while shared < len(self.last) and shared < len(term) and self.last[shared] == term[shared]:
            shared += 1
        self.close(shared)
        self.path.extend([False, []] for _ in range(len(term) - shared))
        self.path[-1][0] = True
        self.last = term

    def close(self, depth: int) -> None:
        """Closes the states of the last term below ``depth``."""
        while len(self.path) > depth + 1:
            number = self.register(self.path.pop())
            self.path[-1][1].append((self.last[len(self.path) - 1], number))

    def register(self, state: list) -> int:
        key = (state[0], tuple(state[1]))
        number = self.known.get(key)
        if number is None:
            number = self.known[key] = len(self.states)
            self.states.append(key)
            self.sizes.append(state[0] + sum(self.sizes[target] for _, target in state[1]))
        return number

    def arcs(self) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(root, final, keys, targets, outputs); a key is state * 256 + byte, and keys ascend."""
        self.close(0)
        root = self.register(self.path[0])
        keys, targets, outputs = [], [], []
        for number, (final, arcs) in enumerate(self.states):
            before = int(final)
            for byte, target in arcs:
                keys.append(number << 8 | byte)
                targets.append(target)
                outputs.append(before)
                before += self.sizes[target]
        return root, np.array([s[0] for s in self.states], bool), np.array(keys, np.int64), np.array(targets, np.int32), np.array(outputs, np.int32)


def built(sorted_terms: list[bytes]) -> bytes:
    """The transducer of sorted terms as bytes: root, number of states and arcs, then their arrays."""
    builder = Builder()
    for term in sorted_terms:
        builder.add(term)
    root, final, keys, targets, outputs = builder.arcs()
    head = np.array([root, len(final), len(keys)], np.int64)
    return b"".join(x.tobytes() for x in (head, keys, targets, outputs, final))


class Transducer:
    """Reads what `built` wrote, and gives the ordinals of many terms at once."""

    def __init__(self, raw: bytes):
        root, states, arcs = np.frombuffer(raw, np.int64, 3).tolist()
        self.root, at = root, 24
        self.keys = np.frombuffer(raw, np.int64, arcs, at)
        self.targets = np.frombuffer(raw, np.int32, arcs, at + 8 * arcs)
        self.outputs = np.frombuffer(raw, np.int32, arcs, at + 12 * arcs)
        self.final = np.frombuffer(raw, bool, states, at + 16 * arcs)

    def ordinals(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The ordinal of each term ``data[start:start + length]``, -1 for those the transducer does not hold."""
        state, total = np.full(len(starts), self.root, np.int64), np.zeros(len(starts), np.int64)
        out = np.full(len(starts), -1, np.int64)
        rows, depth = np.arange(len(starts)), 0
        while len(rows) and len(self.keys):
            ended = lengths[rows] == depth
            done = rows[ended]
            done = done[self.final[state[done]]]
            out[done] = total[done]
            rows = rows[~ended]
            wanted = state[rows] << 8 | data[starts[rows] + depth]
            arc = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            goes = self.keys[arc] == wanted
            rows, arc = rows[goes], arc[goes]
            state[rows] = self.targets[arc]
            total[rows] += self.outputs[arc]
            depth += 1
        return out


def _transducers(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("ordinal")
    made = built(pc.cast(rows.column("term"), pa.binary()).to_pylist())
    return pa.table({"lang": rows.column("lang").slice(0, 1), "shard": rows.column("shard").slice(0, 1), "first": rows.column("term").slice(0, 1),
                     "base": rows.column("ordinal").slice(0, 1), "arcs": pa.array([made], pa.binary())})


def vocabulary(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, ordinal): the kept terms of ``docs`` (text, lang)."""
    counted = docs.select("text", "lang").mapInArrow(_document_terms, "lang string, term string, docs long")
    kept = cut(counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least).select("lang", "term"))
    return cut(with_slots(kept, ["lang"], ["term"], "ordinal"))


def transducers(terms_: DataFrame) -> DataFrame:
    """(lang, shard, first, base, arcs): a transducer for each run of ordinals, its first term and ordinal."""
    sharded = terms_.withColumn("shard", F.expr(f"ordinal div {SHARD_TERMS}"))
    return cut(sharded.groupBy("lang", "shard").applyInArrow(_transducers, "lang string, shard long, first string, base long, arcs binary"))


def blocks(made: DataFrame, most: int = MOST_BYTES) -> Iterator[list[tuple[str, bytes, int, bytes]]]:
    """Transducers (lang, first term, base, arcs) in blocks of about ``most`` bytes, in order of language and shard. Only sizes
    are looked at for all of them (a row for each ``SHARD_TERMS`` terms); a block is fetched when its turn comes."""
    sizes = made.select("lang", "shard", F.octet_length("arcs").alias("n")).orderBy("lang", "shard").collect()
    at = 0
    while at < len(sizes):
        end, total = at, 0
        while end < len(sizes) and (end == at or total + sizes[end]["n"] <= most):
            total += sizes[end]["n"]
            end += 1
        order = F.struct("lang", "shard")
        low, high = (F.struct(F.lit(sizes[i]["lang"]).alias("lang"), F.lit(sizes[i]["shard"]).alias("shard")) for i in (at, end - 1))
        rows = made.where((order >= low) & (order <= high)).orderBy("lang", "shard").collect()
        yield [(r["lang"], r["first"].encode(), r["base"], bytes(r["arcs"])) for r in rows]
        at = end


def _recounted(block):
    """(lang, source, ordinal, n): occurrences of a block's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for lang, first, base, raw in block.value:
            held.setdefault(lang, []).append((first, base, Transducer(raw)))
        groups: dict[tuple[str, str], int] = {}
        kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]

        def passed() -> pa.RecordBatch:
            group, ordinal, n = _added(kept)
            names = list(groups)
            return pa.RecordBatch.from_arrays([pa.array([names[g][0] for g in group.tolist()], pa.string()), pa.array([names[g][1] for g in group.tolist()], pa.string()),
                                               pa.array(ordinal), pa.array(n)], names=["lang", "source", "ordinal", "n"])

        for batch in slices(batches, SLICE_BYTES):
            found, owner = terms(batch.column("text"))
            coded = found.dictionary_encode()
            kinds, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            order = pc.sort_indices(kinds).to_numpy().astype(np.int64)  # by bytes
            ends = np.frombuffer(kinds.buffers()[1], np.int64)[kinds.offset:kinds.offset + len(kinds) + 1]
            data = np.frombuffer(kinds.buffers()[2] or b"", np.uint8)
            pairs = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True))
            number = np.array([groups.setdefault(pair, len(groups)) for pair in pairs], np.int64)
            spoken = np.array([pair[0] for pair in pairs], object)
            for lang in set(spoken.tolist()) & held.keys():
                here = (spoken == lang)[owner] if len(owner) else np.zeros(0, bool)
                there = np.zeros(len(kinds), bool)
                there[codes[here]] = True
                mine = order[there[order]]
                places = np.full(len(kinds), -1, np.int64)
                shards = held[lang]
                for i, (first, base, transducer) in enumerate(shards):
                    low = _place(kinds, mine, first)
                    high = _place(kinds, mine, shards[i + 1][0]) if i + 1 < len(shards) else len(mine)
                    some = mine[low:high]
                    got = transducer.ordinals(data, ends[some], ends[some + 1] - ends[some])
                    places[some] = np.where(got >= 0, got + base, -1)
                at = places[codes[here]]
                group = number[owner[here]][at >= 0]
                at = at[at >= 0]
                if len(at):
                    span = int(at.max()) + 1
                    both, n = np.unique(group * span + at, return_counts=True)
                    kept.append((both // span, both % span, n.astype(np.int64)))
            kept[:] = [_added(kept)]
            if len(kept[0][0]) >= KEPT_COUNTS:
                yield passed()
                kept[:] = [tuple(k[:0] for k in kept[0])]
                groups.clear()
        yield passed()

    return run


def _added(kept: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Counts (group, ordinal, n) with equal keys added up."""
    group, ordinal, n = (np.concatenate([k[i] for k in kept]) for i in range(3))
    if not len(group):
        return group, ordinal, n
    order = np.lexsort((ordinal, group))
    group, ordinal, n = group[order], ordinal[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (ordinal[1:] != ordinal[:-1])]))
    return group[new], ordinal[new], np.add.reduceat(n, new)


def _place(kinds: pa.Array, order: np.ndarray, term: bytes) -> int:
    """Where ``term`` would stand among sorted kinds."""
    low, high = 0, len(order)
    while low < high:
        middle = (low + high) // 2
        if kinds[int(order[middle])].as_py() < term:
            low = middle + 1
        else:
            high = middle
    return low


def recount(docs: DataFrame, made: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """(lang, source, ordinal, n): how often each kept term stands in the texts of each group of ``docs`` (text, lang, source)."""
    context = docs.sparkSession.sparkContext
    schema = "lang string, source string, ordinal long, n long"
    found = []
    for block in blocks(made, most):
        sent = context.broadcast(block)
        found.append(cut(docs.select("text", "lang", "source").mapInArrow(_recounted(sent), schema)
                         .groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))))
        sent.destroy()
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)


# ---- distributions

def _p(count: str, total: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kinds)), exactly, whatever the counts."""
    return F.expr(f"1 + cast({SCALE} as decimal(10,0)) * cast({count} + 1 as decimal(19,0)) div cast({total} + kinds as decimal(19,0))")


def distributions(docs: DataFrame, terms_: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups (lang, source, slot, width, kinds, total, p) with the p of a term they lack, slots in order of source; and present
    terms (lang, source, slot, ordinal, p, q) with the group's and the language's p."""
    kinds = terms_.groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = with_slots(docs.select("lang", "source").distinct(), ["lang"], ["source"], "slot")
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("width")).join(kinds, "lang", "left").select("lang", "width", F.coalesce("kinds", F.lit(0)).alias("kinds"))
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang").withColumn("total", F.coalesce("total", F.lit(0)))
    groups = cut(groups.select("lang", "source", "slot", "width", "kinds", "total", F.when(F.col("kinds") > 0, _p("0", "total")).alias("p")))
    spoken = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    everywhere = F.sum("n").over(Window.partitionBy("lang", "ordinal"))  # at most one row for each source
    present = counts.withColumn("lang_n", everywhere).join(groups.drop("p"), ["lang", "source"]).join(spoken, "lang")
    return groups, cut(present.select("lang", "source", "slot", "ordinal", _p("n", "total").alias("p"), _p("lang_n", "lang_total").alias("q")))


def _block_sums(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, slot, other, value): the sums of a block of terms, from its groups' rows (ordinal -1) and its terms'."""
    lang, block = (k.as_py() for k in key)
    rows = pa.Table.from_batches(list(batches))
    slot, ordinal, p = (rows.column(c).to_numpy() for c in ("slot", "ordinal", "p"))
    size, kinds = (rows.column(c)[0].as_py() for c in ("size", "kinds"))
    groups = np.flatnonzero(ordinal < 0)
    base = np.zeros(len(groups), np.int64)
    base[slot[groups]] = p[groups]
    inside = ordinal >= 0
    for x, y, value in compare_block(block * size, min(kinds, (block + 1) * size), base, slot[inside], ordinal[inside], p[inside]):
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(x), pa.string()), pa.array(x), pa.array(y), pa.array(value)], names=["lang", "slot", "other", "value"])


def pairs(groups: DataFrame, present: DataFrame) -> DataFrame:
    """(lang, slot, other, value) for every two groups of a language, over all its kept terms."""
    size = F.expr(f"greatest(1, {CELLS} div width)")
    sized = groups.withColumn("size", size)
    every = F.explode(F.expr("sequence(0L, greatest(0L, kinds - 1) div size)"))
    bases = sized.select("lang", every.alias("block"), "slot", F.lit(-1).cast("long").alias("ordinal"), F.coalesce("p", F.lit(1)).alias("p"), "size", "kinds")
    sizes = sized.groupBy("lang").agg(F.first("size").alias("size"), F.first("kinds").alias("kinds"))
    held = present.join(sizes, "lang").select("lang", F.expr("ordinal div size").alias("block"), "slot", "ordinal", "p", "size", "kinds")
    sums = bases.unionByName(held).groupBy("lang", "block").applyInArrow(_block_sums, "lang string, slot long, other long, value long")
    return sums.where("slot <> other").groupBy("lang", "slot", "other").agg(F.sum("value").alias("value"))


def compare_block(first: int, last: int, base: np.ndarray, group: np.ndarray, ordinal: np.ndarray,
                  p: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(group, other, sum) over the terms ``first`` to ``last`` (not included), from the p of absent terms by group and the p of
    those present. ``CELLS`` numbers and ``SIDE`` by ``SIDE`` groups at a time."""
    width = len(base)
    step = max(1, CELLS // max(width, 1))
    order = np.argsort(ordinal, kind="stable")
    group, ordinal, p = group[order], ordinal[order], p[order]
    for a in range(0, width, SIDE):
        for b in range(0, width, SIDE):
            left, right = base[a:a + SIDE], base[b:b + SIDE]
            sums = np.zeros((len(left), len(right)), np.int64)
            for low in range(first, last, step):
                high = min(last, low + step)
                i, j = np.searchsorted(ordinal, [low, high])
                ps, qs = (_dense(side, at, low, high, group[i:j], ordinal[i:j], p[i:j]) for side, at in ((left, a), (right, b)))
                for k in range(len(left)):
                    apart = ps[k][None, :] - qs
                    sums[k] += (apart * apart // qs).sum(axis=1)
            x, y = np.meshgrid(np.arange(a, a + len(left)), np.arange(b, b + len(right)), indexing="ij")
            yield x.ravel(), y.ravel(), sums.ravel()


def _dense(base: np.ndarray, at: int, low: int, high: int, group: np.ndarray, ordinal: np.ndarray, p: np.ndarray) -> np.ndarray:
    out = np.repeat(base[:, None], high - low, axis=1)
    mine = (group >= at) & (group < at + len(base))
    out[group[mine] - at, ordinal[mine] - low] = p[mine]
    return out


# ---- the audit

def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, most: int = MOST_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank) for ``docs`` (text, lang, source): part ``pair`` has the other sources of the
    language, part ``term`` the ``top`` terms a group says more often than its language does."""
    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    terms_ = vocabulary(docs, least)
    counts = recount(docs, transducers(terms_), most)
    groups, present = distributions(docs, terms_, counts)
    names = groups.select("lang", "slot", "source")
    ranked = F.row_number().over(Window.partitionBy("lang", "slot").orderBy(F.col("value").desc(), "other"))
    pair = pairs(groups, present).withColumn("rank", ranked).join(names, ["lang", "slot"]).join(
        names.select("lang", F.col("slot").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    value = F.expr("(p - q) * (p - q) div q")
    said = present.where("p > q").select("lang", "source", "ordinal", value.alias("value")).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "ordinal"))).where(F.col("rank") <= top)
    term = said.join(terms_.select("lang", "ordinal", F.col("term").alias("item")), ["lang", "ordinal"])
    return pair.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").unionByName(
        term.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def op11_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """How far the sources of each language are apart, and the terms that set each of them apart."""
    return audit(table(spark, folder, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+') AS w FROM documents),
 o AS (SELECT row, lang, source, unnest(w) AS term FROM d),
 kept AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
 v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
 g AS (SELECT DISTINCT lang, source FROM d),
 c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
 gn AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
 ln AS (SELECT lang, sum(total) AS total FROM gn GROUP BY lang),
 lc AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term),
 p AS (SELECT gn.lang, gn.source, kept.term, coalesce(n, 0) AS n, CAST(1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // (total + v) AS BIGINT) AS p
  FROM gn JOIN kept ON kept.lang = gn.lang JOIN v ON v.lang = gn.lang LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = kept.term),
 q AS (SELECT lc.lang, term, CAST(1 + 1000000000::HUGEINT * (n + 1) // (total + v) AS BIGINT) AS q FROM lc JOIN ln ON ln.lang = lc.lang JOIN v ON v.lang = lc.lang),
 pair AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
 terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)) WHERE part = 'pair' OR rank <= 200
"""
