"""Substring dedup with repeated-phrase automata.

A window is 20 consecutive words of one document. A word is removed if a window over it also starts earlier (smaller
id, or the same document further up). Steps:

1. Documents equal in text are one class; only the one with the smallest id goes on. A later copy of 20 words or more is
   covered by windows of the first and loses every word; a shorter one has no window.
2. Documents are dealt into slices by a hash of the id. Each slice reports its phrases: 8 words whose hash is the least
   among the 13 of some window. Equal windows choose the same phrase, so a window that recurs holds a phrase that does.
   Phrases are counted over all slices.
3. Passages are confirmed: for each recurring phrase every slice reports the spans it stands in (the up to 32 words that
   windows around it can reach), once per span with its first place. All but the first place of a span repeat it, and
   so do all windows around the phrase there.
4. Only where a phrase stands in several spans can windows of one span recur in another (the ends of passages). The
   first place of each such span reports its windows; those that are not the first of their kind are repeats.
5. A passage is confirmed when its span stands in two places or more. Each slice is told the confirmed spans it holds,
   with their first place of all and a place of its own to read the phrase's words at, compiles Aho-Corasick automata of
   those phrases as strings of word numbers, and streams all its documents through them to locate every occurrence.
   An occurrence that is not its span's first place, and every window of step 4, covers its words.

The automata are sharded by documents and, inside a slice, by ``SHARD`` phrases: a slice's hold only phrases that occur in
it, so memory follows the slice, and a passage shared by a third of all documents is one row per slice. What is
grouped by one phrase or window has at most a row per slice, or is an aggregate and a join that can be split. Slices are
``SLICES_PER_PARTITION`` to a shuffle partition. Spans and windows are compared by 128 bits of hashes.

Nulls and edge cases: a null or blank text has no words and comes back as it is. A null id orders last. Rows that
share an id, a null one too, are documents of their own, in order of their texts' digests, so of rows repeated in full only
one keeps its words. Extra columns are carried by ``dedup`` unless they have an output's name. An empty table gives no rows. A text is handled whole inside one task."""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codestrata.llm.common import cut, free, numbered, others, partitions, table
from codestrata.llm.shingles import NOTHING, Words, mixed, rolled, sliding

WINDOW = 20
PHRASE = 8
REACH = WINDOW - PHRASE + 1
# an odd base and its inverse modulo 2^64
BASE = np.uint64(0xD1342543DE82EF95)
INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
SLICES_PER_PARTITION = 4
SHARD = 131_072  # phrases of an automaton; its words, at most 2^20, fit the code points

# What a slice is told. Kind 0: a later copy (id). 1: a recurring phrase (h1). 2: the first place (id, start) of a span
# (h1, h2) in all slices, and the first one (own, begin) in this slice; n is 1 if its phrase stands in other spans too.
# 3: a repeated window (id, start).


def _sorted(docs: pa.Table) -> pa.Table:
    return docs.sort_by([("_id", "ascending")])


def _without_copies(docs: pa.Table, told: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """Documents in id order and which of them are later copies."""
    docs = _sorted(docs)
    copies = told.filter(pc.equal(told.column("kind"), 0)).column("id")
    return docs, pc.is_in(docs.column("_id"), value_set=copies.combine_chunks()).to_numpy(zero_copy_only=False).astype(bool)


def _phrases(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the phrases that windows choose."""
    n = len(words.codes)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    left = words.left()
    hashes = np.full(n, NOTHING)
    hashes[:n - PHRASE + 1] = rolled(words.hashes(), PHRASE)
    hashes[left < PHRASE] = NOTHING
    least = sliding(hashes, REACH, np.minimum)
    # only windows inside one text choose; a phrase is chosen if some window that begins up to 12 words earlier has it as its least
    least[left < WINDOW] = 0
    chosen = sliding(np.concatenate([np.zeros(REACH - 1, np.uint64), least]), REACH, np.maximum)[:n]
    at = np.flatnonzero((chosen == hashes) & (hashes != NOTHING))
    return at, hashes[at]


def _around(words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) place at which a window over the whole phrase at a place can begin."""
    owner = words.owner[at]
    return np.maximum(at - REACH + 1, words.starts[owner]), np.minimum(at, words.ends[owner] - WINDOW)


class _Ranges:
    """Hashes of any range of words: a polynomial over the words' own hashes, brought to the range's begin."""

    def __init__(self, words: Words, seed: int):
        hashes = words.hashes(seed)
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(hashes), BASE)]).astype(np.uint64))
            self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(hashes), INVERSE)]).astype(np.uint64))
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * powers[:-1], dtype=np.uint64)])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[begin]) * self.back[begin]


def _spans(words: Words, at: np.ndarray, ranges: _Ranges) -> np.ndarray:
    """The hash of the words that windows around each phrase reach, and of the phrase's place among them."""
    begin, last = _around(words, at)
    end = last + WINDOW
    return mixed(ranges.of(begin, end), ((at - begin) * 64 + (end - begin)).astype(np.uint64))


def _texts(docs: pa.Table, copies: np.ndarray) -> pa.Array:
    """Texts with later copies emptied."""
    texts = docs.column("text").combine_chunks()
    return pc.if_else(pa.array(copies), pa.scalar("", texts.type), texts) if copies.any() else texts


def _report_phrases(docs: pa.Table, told: pa.Table) -> pa.Table:
    schema = pa.schema([("_slice", pa.int32()), ("h1", pa.int64()), ("n", pa.int32())])
    if not docs.num_rows:
        return schema.empty_table()
    rows, copies = _without_copies(docs, told)
    _, hashes = _phrases(Words(_texts(rows, copies)))
    kinds, n = np.unique(hashes, return_counts=True)
    return pa.table([_number(docs, len(kinds)), pa.array(kinds.view(np.int64)), pa.array(np.minimum(n, 2), pa.int32())], schema=schema)


PLACES = pa.schema([("_slice", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("id", pa.int64()), ("start", pa.int32())])
SPANS = PLACES.append(pa.field("n", pa.int32()))


def _number(docs: pa.Table, rows: int) -> pa.Array:
    return pa.array(np.full(rows, docs.column("_slice")[0].as_py(), np.int32))


def _located(docs: pa.Table, rows: pa.Table, words: Words, h1: np.ndarray, h2: np.ndarray, at: np.ndarray) -> pa.Table:
    owner = words.owner[at]
    return pa.table([_number(docs, len(at)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(rows.column("_id").to_numpy()[owner]),
                     pa.array((at - words.starts[owner]).astype(np.int32))], schema=PLACES)


def _of_kind(told: pa.Table, kind: int) -> pa.Table:
    return told.filter(pc.equal(told.column("kind"), kind))


def _report_spans(docs: pa.Table, told: pa.Table) -> pa.Table:
    """The first place in the slice of every span of a recurring phrase, and whether it has one (n 1) or more (2)."""
    known = _of_kind(told, 1).column("h1").to_numpy().view(np.uint64)
    if not docs.num_rows or not len(known):
        return SPANS.empty_table()
    rows, copies = _without_copies(docs, told)
    words = Words(_texts(rows, copies))
    at, phrases = _phrases(words)
    again = np.isin(phrases, known)
    at, phrases = at[again], phrases[again]
    spans = _spans(words, at, _Ranges(words, 1))
    order = np.lexsort((at, spans, phrases))
    at, phrases, spans = at[order], phrases[order], spans[order]
    first = np.flatnonzero(np.concatenate([[True], (phrases[1:] != phrases[:-1]) | (spans[1:] != spans[:-1])]) if len(at) else np.zeros(0, bool))
    n = np.minimum(np.diff(np.append(first, len(at))), 2).astype(np.int32)
    return _located(docs, rows, words, phrases[first], spans[first], at[first]).append_column("n", pa.array(n))


def _places(words: Words, ids: np.ndarray, told: pa.Table, id_: str = "id", start: str = "start") -> np.ndarray:
    """Word places of (id, start) rows; -1 for those of other slices."""
    wanted = told.column(id_).to_numpy()
    row = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
    return np.where(ids[row] == wanted, words.starts[row] + told.column(start).to_numpy(), -1)


def _report_windows(docs: pa.Table, told: pa.Table) -> pa.Table:
    """The windows around the first places, as far as they lie in this slice, of spans whose phrase stands in others too."""
    spans = _of_kind(told, 2)
    spans = spans.filter(pc.equal(spans.column("n"), 1))
    if not docs.num_rows or not spans.num_rows:
        return PLACES.empty_table()
    rows, copies = _without_copies(docs, told)
    words = Words(_texts(rows, copies))
    at = _places(words, rows.column("_id").to_numpy(), spans)
    begin, last = _around(words, at[at >= 0])
    edges = np.zeros(len(words.codes) + 1, np.int64)
    np.add.at(edges, begin, 1)
    np.add.at(edges, last + 1, -1)
    found = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
    return _located(docs, rows, words, _Ranges(words, 1).of(found, found + WINDOW), _Ranges(words, 2).of(found, found + WINDOW), found)


def _letters(numbers: np.ndarray) -> str:
    """A character for each number, surrogates left out."""
    points = np.where(numbers >= 0xD800, numbers + 0x800, numbers).astype("<u4")
    return points.tobytes().decode("utf-32-le")


def _readable(stream: np.ndarray) -> np.ndarray:
    """Places at which an occurrence can lie: runs of at least a phrase's words that phrases have, and the place after each."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], stream > 0, [0]]).astype(np.int8)))
    begin, end = edges[::2], edges[1::2]
    long = end - begin >= PHRASE
    begin, size = begin[long], np.minimum(end[long] + 1, len(stream)) - begin[long]
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())


def _occurrences(words: Words, phrases: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, numbers): every place at which a phrase stands inside one text, and its row in ``phrases``, the places its
    words are read at (phrases differ). Words marked ``apart`` belong to no occurrence."""
    found = [np.zeros((2, 0), np.int64)]
    left = words.left()
    for low in range(0, len(phrases), SHARD):
        codes = words.codes[phrases[low:low + SHARD, None] + np.arange(PHRASE)]
        kinds, numbers = np.unique(codes, return_inverse=True)
        letters, automaton = _letters(numbers.ravel() + 1), ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for row in range(len(codes)):
            automaton.add_word(letters[row * PHRASE:(row + 1) * PHRASE], low + row)
        automaton.make_automaton()
        number = np.zeros(len(words.kinds), np.int64)  # 0: a word of no phrase
        number[kinds] = np.arange(1, len(kinds) + 1)
        stream = number[words.codes]
        stream[apart] = 0
        places = _readable(stream)
        hits = np.fromiter(automaton.iter(_letters(stream[places])), dtype=[("last", np.int64), ("row", np.int64)])
        at = places[hits["last"]] - PHRASE + 1
        inside = left[at] >= PHRASE
        found.append(np.stack([at[inside], hits["row"][inside]]))
    at, row = np.concatenate(found, axis=1)
    return at, row


def _covered(words: Words, ids: np.ndarray, copies: np.ndarray, told: pa.Table) -> np.ndarray:
    """Which words a repeated window covers, later copies aside."""
    edges = np.zeros(len(words.codes) + 1, np.int64)
    spans = _of_kind(told, 2)
    if spans.num_rows:
        h1, h2 = (spans.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        known, one = np.unique(h1, return_index=True)
        at, row = _occurrences(words, _places(words, ids, spans, "own", "begin")[one], (copies | (words.counts < WINDOW))[words.owner])
        # an occurrence belongs to the span it stands in; that span's first place in all slices was told
        key, told_key = mixed(known[row], _spans(words, at, _Ranges(words, 1))), mixed(h1, h2)
        order = np.argsort(told_key)
        told_key, first = told_key[order], _places(words, ids, spans)[order]
        row = np.minimum(np.searchsorted(told_key, key), len(told_key) - 1)
        begin, last = _around(words, at[(told_key[row] == key) & (first[row] != at)])
        np.add.at(edges, begin, 1)
        np.add.at(edges, last + WINDOW, -1)
    repeats = _places(words, ids, _of_kind(told, 3))
    np.add.at(edges, repeats, 1)
    np.add.at(edges, repeats + WINDOW, -1)
    return np.cumsum(edges[:-1]) > 0


def _remove(carried: list[str], want_text: bool, schema: pa.Schema):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        rows, copies = _without_copies(docs, told)
        words = Words(rows.column("text"))
        gone = _covered(words, rows.column("_id").to_numpy(), copies, told)
        gone |= (copies & (words.counts >= WINDOW))[words.owner]
        n_removed = np.bincount(words.owner[gone], minlength=rows.num_rows).astype(np.int64)
        kept = np.concatenate([[0], np.cumsum(words.counts - n_removed)])
        left = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept, pa.int32()), words.words.filter(pa.array(~gone))), pa.scalar(" ", pa.large_string()))
        out = [rows.column(c) for c in carried] + [pa.array(words.counts), pa.array(n_removed)]
        if want_text:
            # a document that loses nothing keeps its text to the letter
            out.append(pc.if_else(pa.array(n_removed > 0), left, rows.column("text").combine_chunks().cast(pa.large_string())).cast(pa.string()))
        else:
            out.append(pa.array([hashlib.sha256(x).hexdigest() for x in left.cast(pa.large_binary()).to_pylist()], pa.string()))
        return pa.table([c.cast(t) if isinstance(c, pa.ChunkedArray) else c for c, t in zip(out, schema.types, strict=True)], schema=schema)

    return run


def dedup(docs: DataFrame, want_text: bool = True) -> DataFrame:
    """``docs`` with n_words and n_removed, and ``text`` without the removed words (or, without ``want_text``,
    ``kept_sha256`` of the kept words joined by one space in its place)."""
    spark = docs.sparkSession
    slices = SLICES_PER_PARTITION * partitions(spark)
    last = "text" if want_text else "kept_sha256"
    kept = others(docs, "n_words", "n_removed", "text", last)
    # carried columns travel under numbers, so no name of theirs meets one of the slices'
    carried = [f"_c{i}" for i in range(len(kept))]

    def slice_of(key):
        return F.pmod(F.xxhash64(key), F.lit(slices)).cast("int")

    row = free(docs, "_id")[0]
    rows, _ = numbered(docs.select(*kept, "text"), row)
    keyed = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, carried, strict=True)], "text", F.col(row).alias("_id"))
    sliced = keyed.withColumn("_slice", slice_of("_id"))
    parts = sliced.groupBy("_slice")

    # later copies of a text, by id
    marks = keyed.where(F.col("text").isNotNull()).select("_id", F.md5(F.col("text").cast("binary")).alias("mark"))
    many = marks.groupBy("mark").agg(F.min("_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = marks.join(many, "mark").where("_id > least").select("_id").distinct()
    zero, nothing = F.lit(0), F.lit(0).cast("long")

    def told(rows: DataFrame, kind: int, at=None, **columns) -> DataFrame:
        """Rows of what slices are told; columns not given are 0."""
        empty = {"h1": nothing, "h2": nothing, "id": nothing, "start": zero, "own": nothing, "begin": zero, "n": zero}
        return rows.select((F.col("_slice") if at is None else at).alias("_slice"), F.lit(kind).alias("kind"),
                           *[columns.get(c, default).alias(c) for c, default in empty.items()])

    flags = told(copies, 0, at=slice_of("_id"), id=F.col("_id"))

    def cogrouped(other: DataFrame, run, schema: str | T.StructType) -> DataFrame:
        return parts.cogroup(other.groupBy("_slice")).applyInArrow(run, schema)

    h1, h2, id_, start = (F.col(c) for c in ("h1", "h2", "id", "start"))
    # a phrase has one row per slice here
    phrases = cogrouped(flags, _report_phrases, "_slice int, h1 long, n int")
    again = phrases.withColumn("n", F.sum("n").over(Window.partitionBy("h1"))).where("n > 1")
    place = "_slice int, h1 long, h2 long, id long, start int"
    spans = cut(cogrouped(flags.unionByName(told(again, 1, h1=h1)), _report_spans, place + ", n int"))
    # a span has one row per slice; a phrase may stand in any number of spans, so those are only aggregated
    whole = Window.partitionBy("h1", "h2").orderBy("id", "start").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mixed_phrases = spans.groupBy(h1.alias("_h")).agg(F.min("h2").alias("_least"), F.max("h2").alias("_most")).where("_least < _most")
    firsts = spans.select("_slice", "h1", "h2", id_.alias("own"), start.alias("begin"), F.first("id").over(whole).alias("id"),
                          F.first("start").over(whole).alias("start"), F.sum("n").over(whole).alias("places"))
    firsts = cut(firsts.join(mixed_phrases.select("_h"), h1 == F.col("_h"), "left").withColumn("n", F.col("_h").isNotNull().cast("int")).where("n = 1 or places > 1"))
    known = {c: F.col(c) for c in ("h1", "h2", "id", "start", "own", "begin", "n")}
    windows = cut(cogrouped(flags.unionByName(told(firsts.where("n = 1"), 2, **known)), _report_windows, place))
    # a window can stand in any number of spans: its first place is an aggregate, met by a join that can be split
    opening = windows.groupBy(h1.alias("_h1"), h2.alias("_h2")).agg(F.min(F.struct("id", "start")).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    repeats = windows.join(opening, (h1 == F.col("_h1")) & (h2 == F.col("_h2"))).where(F.struct("id", "start") != F.col("_first"))
    told_all = flags.unionByName(told(firsts.where("places > 1"), 2, **known)).unionByName(told(repeats, 3, id=id_, start=start))
    kinds = {f.name: f.dataType for f in docs.schema}
    schema = T.StructType([T.StructField(n, kinds[c]) for c, n in zip(kept, carried, strict=True)]
                          + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField(last, T.StringType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    return cogrouped(told_all, _remove(carried, want_text, to_arrow_schema(schema)), schema).toDF(*kept, "n_words", "n_removed", last)


def op9_substrings(spark: SparkSession, folder: str) -> DataFrame:
    """What each document loses to earlier windows, and the digest of what it keeps."""
    return dedup(table(spark, folder, "documents").select("doc_id", "text"), want_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM d)),
 later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
 gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS i FROM later),
 word AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM d),
 kept AS (SELECT k.doc_id, string_agg(k.word, ' ' ORDER BY k.i) AS t, count(*) AS n FROM word k ANTI JOIN gone g ON g.doc_id = k.doc_id AND g.i = k.i GROUP BY k.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
