"""Language-model scores from Brown classes: P(word | previous) = P(class | previous class) * P(word | class).

Counting and training read every text that is not held out.

1. Words are counted (one aggregate over all training texts).
2. Units are what gets a class: each word that makes up at least one in ``UNIT_SHARE`` tokens (so there are at most that many), and
   for all other words, known or not, ``BUCKETS`` groups by their last three bytes. So every word has a class, and a text needs
   no more than the frequent words to be read as units.
3. Bigrams of units are counted over the training texts, and kept as each unit's neighbours (one row a unit).
4. Exchange clustering: for every unit the gain in likelihood of each other class follows from its neighbours' classes and the
   class bigrams. In a round a part of the units (in turn) may move, all at once, to their best class; class bigrams are counted
   again over all neighbours, and a round that made the likelihood worse is taken back and makes the parts smaller. What the driver holds are classes of units and a square
   matrix of classes, both of fixed bounds.
5. Scores: transitions and everything about frequent words (one in ``FREQUENT_SHARE`` tokens, again a bound) are added up where the
   text is; for the rest, each document's distinct words are joined with their counts.

Smoothing: a transition is interpolated with the class's share (``PRIOR`` counts of it), an emission has ``ADD`` added to each of the
class's words and to one more, which stands for all words the class does not hold; each history's probabilities sum to 1.

Nulls and edge cases: a null text is empty and scores its end alone. A null id is learned from (not held out); rows that
share an id, a null one too, are documents of their own. Words are not cut; one longer than ``LONGEST`` bytes is never sent to all
tasks but joined. With nothing to learn from every class is equally likely and every word unknown. Columns other than id and
text are not read. An empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm.common import cut, numbered, table
from codestrata.llm.shingles import Words

CLASSES = 64              # besides the one of the end token
UNIT_SHARE = 1 << 16      # a word is a unit of its own from one in so many tokens
FREQUENT_SHARE = 1 << 20  # and known to all tasks from one in so many
LONGEST = 64              # bytes of a word known to all tasks
BUCKETS = 1024
ROUNDS = 12
PARTS = 4                 # of the units move at a time at first
ADD = 0.1
PRIOR = 2.0
SLICE_BYTES = 1 << 20     # of text read at a time
KEPT_PAIRS = 1 << 18      # bigrams a task adds up before it passes them on
GROUP_ROWS = 1 << 18      # bigrams turned into neighbours in one call


def slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of about ``size`` bytes; a row that is longer stays whole."""
    for batch in batches:
        rows, at = max(1, int(batch.num_rows * size / max(batch.nbytes, 1))), 0
        while at < batch.num_rows:
            yield batch.slice(at, rows)
            at += rows


# ---- words and units

def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, SLICE_BYTES):
        words = Words(batch.column("text"), lower=True)
        n = np.bincount(words.codes, minlength=len(words.kinds)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([words.kinds.cast(pa.string()), pa.array(n)], names=["word", "n"])


def tails(kinds: pa.Array) -> np.ndarray:
    """The bucket of each word: a hash of its last three bytes (fewer where it is shorter)."""
    ends = np.frombuffer(kinds.buffers()[1], np.int64)[kinds.offset:kinds.offset + len(kinds) + 1]
    data = np.frombuffer(kinds.buffers()[2] or b"", np.uint8)
    mixed = np.zeros(len(kinds), np.uint64)
    for back in (1, 2, 3):
        at = ends[1:] - back
        mixed = mixed * np.uint64(257) + np.where(at >= ends[:-1], data[np.maximum(at, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0)) if len(data) else mixed
    return ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % BUCKETS


@dataclass
class Lexicon:
    """The frequent words, most frequent first; the first ``own`` of them are units, then come the buckets and the end token."""

    words: pa.Array
    n: np.ndarray
    own: int

    @property
    def parts(self) -> tuple[pa.Array, np.ndarray, int]:
        """What is sent to tasks, plain values only."""
        return self.words, self.n, self.own

    @property
    def units(self) -> int:
        return self.own + BUCKETS + 1

    @property
    def end(self) -> int:
        return self.own + BUCKETS

    def read(self, kinds: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(unit, count) of each word; the count is -1 where it is not known here."""
        kinds = kinds.cast(pa.large_string())
        place = pc.fill_null(pc.index_in(kinds, value_set=self.words), -1).to_numpy().astype(np.int64)
        unit = np.where((place >= 0) & (place < self.own), place, self.own + tails(kinds))
        return unit, np.where(place >= 0, self.n[np.maximum(place, 0)], -1) if len(self.n) else np.full(len(kinds), -1, np.int64)


def lexicon(counts: DataFrame, total: int) -> Lexicon:
    """The frequent words of ``counts`` (word, n): at most ``FREQUENT_SHARE`` words of at most ``LONGEST`` bytes."""
    frequent = counts.where((F.col("n") >= total / FREQUENT_SHARE) & (F.octet_length("word") <= LONGEST)).orderBy(F.col("n").desc(), "word")
    rows = frequent.toArrow()
    n = rows.column("n").to_numpy().astype(np.int64)
    return Lexicon(rows.column("word").cast(pa.large_string()).combine_chunks(), n, int((n >= total / UNIT_SHARE).sum()))


def _sequence(words: Words, unit: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, text) for every token of every text, its end included: the unit before it and its own."""
    at = np.arange(len(words.counts)) + words.ends            # where each end stands once ends are put in
    right = np.full(len(words.codes) + len(words.counts), end, np.int64)
    inner = np.ones(len(right), bool)
    inner[at] = False
    right[inner] = unit[words.codes] if len(words.codes) else np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(words.counts)), words.counts + 1)
    return np.concatenate([[end], right[:-1]]) if len(right) else right, right, text


def _paired(sent):
    """(left, right, n): bigrams of units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon_ = Lexicon(*sent.value)
        width = lexicon_.units
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def passed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys // width), pa.array(keys % width), pa.array(n)], names=["left", "right", "n"])

        for batch in slices(batches, SLICE_BYTES):
            words = Words(batch.column("text"), lower=True)
            left, right, _ = _sequence(words, lexicon_.read(words.kinds)[0], lexicon_.end)
            new, count = np.unique(left * width + right, return_counts=True)
            keys, place = np.unique(np.concatenate([keys, new]), return_inverse=True)
            n = np.bincount(place, np.concatenate([n, count]), len(keys)).astype(np.int64)
            if len(keys) >= KEPT_PAIRS:
                yield passed()
                keys, n = keys[:0], n[:0]
        yield passed()

    return run


NEIGHBOURS = "unit long, next binary, next_n binary, previous binary, previous_n binary"


def _neighbours(rows: pa.Table) -> pa.Table:
    """One row a unit: the units after it and before it, with counts."""
    unit, other, n, after = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("unit", "other", "n", "after"))
    order = np.lexsort((other, ~after, unit))
    unit, other, n, after = unit[order], other[order].astype(np.int32), n[order], after[order]
    names, first = np.unique(unit, return_index=True)
    out = []
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(unit)], strict=True):
        middle = a + int(after[a:b].sum())
        out.append([other[a:middle].tobytes(), n[a:middle].tobytes(), other[middle:b].tobytes(), n[middle:b].tobytes()])
    return pa.table([pa.array(names), *[pa.array([o[i] for o in out], pa.binary()) for i in range(4)]], names=["unit", "next", "next_n", "previous", "previous_n"])


def neighbours(docs: DataFrame, lexicon_: Lexicon) -> DataFrame:
    """The neighbours of every unit in ``docs`` (text)."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicon_.parts)
    pairs = cut(docs.select("text").mapInArrow(_paired(sent), "left long, right long, n long").groupBy("left", "right").agg(F.sum("n").alias("n")))
    parts = max(1, 2 * pairs.count() // GROUP_ROWS)
    both = pairs.select(F.col("left").alias("unit"), F.col("right").alias("other"), "n", F.lit(True).alias("after")).unionByName(
        pairs.select(F.col("right").alias("unit"), F.col("left").alias("other"), "n", F.lit(False).alias("after")))
    return cut(both.groupBy(F.pmod("unit", F.lit(parts)).alias("part")).applyInArrow(_neighbours, NEIGHBOURS))


# ---- exchange clustering

def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(bigrams: np.ndarray) -> float:
    """What of the training likelihood depends on the classes."""
    return float(_phi(bigrams).sum() - _phi(bigrams.sum(axis=0)).sum() - _phi(bigrams.sum(axis=1)).sum())


def _by_class(batch: pa.RecordBatch, classes: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, float]]:
    """(unit, counts of the classes after it, before it, and of itself after itself)."""
    for unit, *raw in zip(*(batch.column(c).to_pylist() for c in ("unit", "next", "next_n", "previous", "previous_n")), strict=True):
        after, after_n, before, before_n = (np.frombuffer(raw[i], t) for i, t in enumerate((np.int32, np.int64, np.int32, np.int64)))
        yield (unit, np.bincount(classes[after], after_n, width), np.bincount(classes[before], before_n, width), float(after_n[after == unit].sum()))


def _class_bigrams(sent, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, sums = sent.value, np.zeros((width, width), np.int64)
        for batch in batches:
            for unit, after, _, _ in _by_class(batch, classes, width):
                sums[classes[unit]] += after.astype(np.int64)
        a, b = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(sums[a, b])], names=["a", "b", "n"])

    return run


def class_bigrams(rows: DataFrame, classes: np.ndarray, width: int) -> np.ndarray:
    """How often each class follows each, from the neighbours of all units."""
    sent = rows.sparkSession.sparkContext.broadcast(classes)
    found = rows.mapInArrow(_class_bigrams(sent, width), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    sums = np.zeros((width, width))
    for r in found:
        sums[r["a"], r["b"]] = r["n"]
    sent.destroy()
    return sums


def gains(bigrams: np.ndarray, own: int, after: np.ndarray, before: np.ndarray, itself: float) -> np.ndarray:
    """What moving a unit of class ``own`` to each class adds to the likelihood."""
    left, m = bigrams.copy(), np.arange(len(bigrams))
    sides = []  # tokens of each class without the unit's, as ones before and after another; the rest keep theirs in any move
    for axis, mine in ((1, after), (0, before)):
        sides.append((bigrams.sum(axis=axis), mine.sum()))
        sides[-1][0][own] -= sides[-1][1]
    left[own] -= after
    left[:, own] -= before
    left[own, own] += itself
    after, before = after.copy(), before.copy()
    after[own] -= itself
    before[own] -= itself

    def moved(there: np.ndarray) -> np.ndarray:
        """Change of the cells off the diagonal and the diagonal, when the unit joins each class."""
        return _phi(there) - _phi(left)

    rows, columns = moved(left + after[None, :]), moved(left + before[:, None])
    corner = left[m, m]
    joined = (rows.sum(axis=1) - rows[m, m]) + (columns.sum(axis=0) - columns[m, m]) + _phi(corner + after + before + itself) - _phi(corner)
    for side, more in sides:
        joined -= _phi(side + more) - _phi(side)
    return joined - joined[own]


def _proposals(sent, width: int, turn: int, parts: int):
    """(unit, class) of units in turn that do better elsewhere; the end token's class is its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, bigrams = sent.value
        for batch in batches:
            found = []
            for unit, after, before, itself in _by_class(batch, classes, width):
                if (unit * 2654435761 >> 16) % parts == turn and classes[unit] != width - 1:
                    gain = gains(bigrams, int(classes[unit]), after, before, itself)[:-1]
                    if gain.max() > 1e-6:
                        found.append((unit, int(gain.argmax())))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["unit", "class"])

    return run


def exchange(rows: DataFrame, units: int, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(class of each unit, class bigrams, likelihood by round). The last unit is the end token, alone in the last class."""
    width, context = classes + 1, rows.sparkSession.sparkContext
    now = (np.arange(units) % classes).astype(np.int32)
    now[-1] = classes
    bigrams = class_bigrams(rows, now, width)
    best, history, parts, idle = (now, bigrams), [likelihood(bigrams)], PARTS, 0
    for turn in range(rounds):
        now, bigrams = best
        sent = context.broadcast(best)
        moves = rows.mapInArrow(_proposals(sent, width, turn % parts, parts), "unit long, class long").toArrow()
        sent.destroy()
        idle = 0 if moves.num_rows else idle + 1
        if idle == parts:  # no part of the units moves
            break
        if idle:
            continue
        now = now.copy()
        now[moves.column("unit").to_numpy()] = moves.column("class").to_numpy()
        bigrams = class_bigrams(rows, now, width)
        history.append(likelihood(bigrams))
        if history[-1] > likelihood(best[1]):
            best = (now, bigrams)
        else:
            parts *= 2  # too many moved past each other: fewer at a time, from the best so far
    return *best, history


# ---- the model

@dataclass
class Model:
    """Counts of words, classes of units, and the tables that scores read."""

    counts: DataFrame             # (word, n) of all words
    lexicon: Lexicon
    classes: np.ndarray           # of units
    total: int                    # training tokens, ends included
    kinds: int                    # distinct tokens, the end included
    ends: int                     # training documents
    transitions: np.ndarray       # log10 by class before and class
    room: np.ndarray              # log10 of each class's tokens with what smoothing adds
    history: list[float]


def _unit_kinds(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon_ = Lexicon(*sent.value)
        n, kinds = np.zeros(lexicon_.units, np.int64), np.zeros(lexicon_.units, np.int64)
        for batch in batches:
            unit, _ = lexicon_.read(batch.column("word"))
            n += np.bincount(unit, batch.column("n").to_numpy(), lexicon_.units).astype(np.int64)
            kinds += np.bincount(unit, minlength=lexicon_.units)
        some = np.flatnonzero(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(kinds[some])], names=["unit", "n", "kinds"])

    return run


def train(docs: DataFrame, classes: int = CLASSES, rounds: int = ROUNDS) -> Model:
    """The model of ``docs`` (text)."""
    texts = docs.select("text")
    counts = cut(texts.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    ends = texts.count()
    tokens, different = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, kinds = tokens + ends, different + (ends > 0)
    known = lexicon(counts, total)
    assigned, bigrams, history = exchange(neighbours(texts, known), known.units, classes, rounds)
    sent = docs.sparkSession.sparkContext.broadcast(known.parts)
    held = counts.mapInArrow(_unit_kinds(sent), "unit long, n long, kinds long").groupBy("unit").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).toArrow()
    width = classes + 1
    of = assigned[held.column("unit").to_numpy()]
    size, words = (np.bincount(of, held.column(c).to_numpy(), width) for c in ("n", "kinds"))
    size[-1] = ends
    share = (size + 1) / (size.sum() + width)
    transitions = np.log10((bigrams + PRIOR * share[None, :]) / (bigrams.sum(axis=1, keepdims=True) + PRIOR))
    room = np.log10(size + ADD * (words + 1))
    room[-1] = 0.0  # the end token is all its class holds
    return Model(counts, known, assigned, total, kinds, ends, transitions, room, history)


# ---- scores

SCORED = "row long, n_tokens long, n_known long, base double, score double, rest array<struct<word: string, n: long>>"


def _scored(sent):
    """Per document what can be added up without other words' counts (for words not known here as if their count were
    such that ADD + count = 1), and those words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, classes, transitions, room, all_room, ends = sent.value
        lexicon_ = Lexicon(*parts)
        for batch in slices(batches, SLICE_BYTES):
            words = Words(batch.column("text"), lower=True)
            texts = len(words.counts)
            unit, count = lexicon_.read(words.kinds)
            left, right, text = _sequence(words, unit, lexicon_.end)
            score = np.bincount(text, transitions[classes[left], classes[right]], texts)
            # weight of each word: log10(count + ADD), less the room of its class or of all
            weight = np.where(count >= 0, np.log10(np.maximum(count, 0) + ADD), 0.0)
            codes, owner = words.codes, words.owner
            base = np.bincount(owner, weight[codes], texts) - (words.counts + 1) * all_room + np.log10(ends + ADD)
            score += np.bincount(owner, (weight - room[classes[unit]])[codes], texts)
            known = np.bincount(owner, (count > 0)[codes], texts).astype(np.int64) + (ends > 0)
            away = count[codes] < 0
            pairs, n = np.unique(owner[away] * max(len(count), 1) + codes[away], return_counts=True)
            holder, code = pairs // max(len(count), 1), pairs % max(len(count), 1)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(holder, minlength=texts))])
            rest = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(
                [words.kinds.take(pa.array(code)).cast(pa.string()), pa.array(n, pa.int64())], names=["word", "n"]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(words.counts + 1), pa.array(known), pa.array(base), pa.array(score), rest],
                                             names=["row", "n_tokens", "n_known", "base", "score", "rest"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(row, n_tokens, n_known, base_score, score, perplexity) for ``docs`` (row, text), rows all different."""
    all_room = float(np.log10(model.total + ADD * (model.kinds + 1)))
    sent = docs.sparkSession.sparkContext.broadcast((model.lexicon.parts, model.classes, model.transitions, model.room, all_room, model.ends))
    read = cut(docs.select("row", "text").mapInArrow(_scored(sent), SCORED))
    rest = read.select("row", F.explode("rest").alias("_w")).select("row", F.col("_w.word").alias("word"), F.col("_w.n").alias("times"))
    log = F.log10(F.coalesce(F.col("n"), F.lit(0)) + ADD)
    added = rest.join(model.counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * log).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("found"))
    got = read.drop("rest").join(added, "row", "left")
    more, found = F.coalesce("more", F.lit(0.0)), F.coalesce("found", F.lit(0))
    return got.select("row", "n_tokens", (F.col("n_known") + found).alias("n_known"), (F.col("base") + more).alias("base_score"),
                      (F.col("score") + more).alias("score")).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op12_brown(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's score under a class model of the documents not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rows, _ = numbered(docs, "row")
    marked = rows.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False)))
    model = train(marked.where(~F.col("held_out")))
    return score(marked, model).join(marked.select("row", "doc_id", "held_out"), "row").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
