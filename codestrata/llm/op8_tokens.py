"""Token ids in Parquet list columns.

Texts are encoded with a given vocabulary file, each document ends with one end id, and rows are written in ascending
``doc_id`` order: range partitions, sorted, one file each. Token lists are dictionary encoded; ids, starts and counts,
which rise or vary little, are delta encoded (format version 2). Row groups, pages and rows per page are set, so the
page index lets a reader take a range of documents, or only the counts, without the token pages.

Encoding speed: every word with its one leading space is encoded by the tokenizer once and kept in a bounded map; a batch
looks each of its different words up once, and new words go to the tokenizer many in one text. A byte-level vocabulary whose pattern never crosses from a non-space to a space gives the same ids for the pieces as for
the whole text; a piece ending in white space is not closed but joined to the next, so runs of white space stay whole.

Nulls and edge cases: a null text is encoded as an empty one (only the end id). Null ids come first and are kept;
repeated rows are written each, in any order among themselves. Columns other than id and text are not written. An empty
table gives no rows. A document's tokens are one list; its text is handled whole, in one task."""

from __future__ import annotations

import os
import re
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm.common import partitions, scratch, table

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
KEPT_PIECES = 600_000      # pieces of a kind a worker remembers
KEPT_LENGTH = 64           # longer pieces are not remembered
LINES = 400                # new words given to the tokenizer in one text
BATCH_BYTES = 4 << 20      # text encoded at a time

FILE_SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, tokens array<int>"
WRITE_OPTIONS = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(64 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#part": "true",
    "parquet.enable.dictionary#start_in_part": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}


# Lines of one word each, the first with or without a space before it, that hold no other white space and no control character.
_LINE = re.compile(r" ?[\w!-~]+(?:\n[\w!-~]+)*").fullmatch


# A gap after a gap: such texts are cut piece by piece.
_GAPS = [g + " " for g in map(chr, range(0x3001)) if g.isspace()]
_GAP = "[" + "".join(f"\\x{{{ord(gap[0]):x}}}" for gap in _GAPS) + "] "


def pieces(text: str) -> tuple[list[str], list[str]]:
    """The text cut before every space that follows a character that is not white space: pieces as they stand, then
    pieces that follow with one space before them (given without it). All of a text is in the second list but its
    first piece, unless some white space has a space after it."""
    parts = text.split(" ")
    if parts[0] and not any(gap in text for gap in _GAPS):
        return parts[:1], parts[1:]
    found, current = [], parts[0]
    for part in parts[1:]:
        if current and not current[-1].isspace():
            found.append(current)
            current = " " + part
        else:
            current += " " + part
    return [*found, current], []


class _Known:
    """What a worker remembers of a vocabulary: ids of pieces as they stand and of pieces after one space. The maps are
    bounded; what does not fit is encoded again."""

    def __init__(self, vocabulary: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.plain, self.spaced = {}, {}
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None

    def lookup(self, pieces: list[str], kept: dict[str, bytes], before: str) -> list[bytes]:
        """The ids of different pieces, with ``before`` before each."""
        ids = list(map(kept.get, pieces))
        if None in ids:
            missing = [at for at, found in enumerate(ids) if found is None]
            fresh = self.learn([before + pieces[at] for at in missing])
            for at, found in zip(missing, fresh, strict=True):
                ids[at] = found
            if len(kept) < KEPT_PIECES:  # a batch of a few megabytes may go over it
                kept.update({pieces[at]: ids[at] for at in missing if len(pieces[at]) <= KEPT_LENGTH})
        return ids

    def learn(self, texts: list[str]) -> list[bytes]:
        """The ids of short texts. Those of one word a line go to the tokenizer as lines of one text and are told apart by the
        line ends, which the pattern never joins with a word; that spares the tokenizer most of its work for a text. Lines
        that hold an added token, which is cut out before the pattern is applied, are encoded one by one like all others."""
        ids: list = [None] * len(texts)
        words = [at for at, text in enumerate(texts) if self.line is not None and _LINE(text)]
        groups = [words[at:at + LINES] for at in range(0, len(words), LINES)]
        joined = ["\n".join([texts[at] for at in group]) for group in groups]
        for group, text, got in zip(groups, joined, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            values = np.array(got.ids, np.uint32)
            ends, last = np.flatnonzero(values == self.line), np.cumsum([texts[at].count("\n") + 1 for at in group])
            if len(ends) + 1 != last[-1] or any(token in text for token in self.added):
                continue
            data, ends = values.tobytes(), 4 * ends[last[:-1] - 1]
            for at, low, high in zip(group, [0, *(ends + 4).tolist()], [*ends.tolist(), len(data)], strict=True):
                ids[at] = data[low:high]
        alone = [at for at, found in enumerate(ids) if found is None]
        for at, got in zip(alone, self.tokenizer.encode_batch_fast([texts[at] for at in alone], add_special_tokens=False), strict=True):
            ids[at] = np.array(got.ids, np.uint32).tobytes()
        return ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(counts, ids): how many ids each text has, and the ids of all texts, each with its end id. Pieces are numbered by
        their kinds, so a kind is looked up once however often it stands in the texts."""
        texts = pc.fill_null(texts, "")
        odd = pc.or_(pc.starts_with(texts, " "), pc.match_substring_regex(texts, _GAP))
        lists, apart = pc.split_pattern(texts.filter(pc.invert(odd)), " "), [pieces(text) for text in texts.filter(odd).to_pylist()]
        apart = [plain + [" " + piece for piece in spaced] for plain, spaced in apart]
        odd = odd.to_numpy(zero_copy_only=False)
        counts = np.zeros(len(texts), np.int64)
        counts[~odd], counts[odd] = pc.list_value_length(lists).to_numpy(), [len(found) for found in apart]
        even, flat = counts[~odd], pc.list_flatten(lists)
        first = np.zeros(len(flat), bool)
        first[np.cumsum(even) - even] = True
        plain = pa.concat_arrays([flat.filter(pa.array(first)), pa.array([p for found in apart for p in found], flat.type)]).dictionary_encode()
        spaced = flat.filter(pa.array(~first)).dictionary_encode()
        kinds = [np.array([END_ID], np.uint32).tobytes(), *self.lookup(plain.dictionary.to_numpy(zero_copy_only=False).tolist(), self.plain, ""),
                 *self.lookup(spaced.dictionary.to_numpy(zero_copy_only=False).tolist(), self.spaced, " ")]
        as_is = plain.indices.to_numpy().astype(np.int64) + 1
        codes = np.zeros(len(flat), np.int64)
        codes[first], codes[~first] = as_is[:len(even)], spaced.indices.to_numpy().astype(np.int64) + 1 + len(plain.dictionary)
        if len(apart):
            owner = np.concatenate([np.repeat(np.flatnonzero(~odd), even), np.repeat(np.flatnonzero(odd), counts[odd])])
            codes = np.concatenate([codes, as_is[len(even):]])[np.argsort(owner, kind="stable")]
        codes = np.insert(codes, np.cumsum(counts), 0)  # the end id
        size = np.fromiter(map(len, kinds), np.int64, len(kinds)) // 4
        n, start = size[codes], np.cumsum(size) - size
        to = np.concatenate([[0], np.cumsum(n)])
        ids = np.frombuffer(b"".join(kinds), np.uint32)[np.repeat(start[codes] - to[:-1], n) + np.arange(to[-1])]
        return np.diff(to[np.concatenate([[0], np.cumsum(counts + 1)])]), ids


def _known(vocabulary: str) -> _Known:
    """What is remembered stays with the worker process from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
    store = sys.modules.setdefault("_known_token_pieces", types.ModuleType("_known_token_pieces")).__dict__
    return store[vocabulary] if vocabulary in store else store.setdefault(vocabulary, _Known(vocabulary))


def encoder(vocabulary: str):
    """texts -> their ids as little-endian 32-bit integers, the end id included, for the named vocabulary file."""
    known = _known(vocabulary)

    def encode(texts: list[str | None]) -> list[bytes]:
        counts, ids = known.encode(pa.array(texts, pa.string()))
        return [part.tobytes() for part in np.split(ids, np.cumsum(counts)[:-1])] if len(texts) else []

    return encode


def _encode_partitions(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, start = _known(vocabulary), TaskContext.get().partitionId(), 0
        for rows in batches:
            step, at = max(1, int(rows.num_rows * BATCH_BYTES / max(rows.nbytes, 1))), 0
            while at < rows.num_rows:
                some = rows.slice(at, step)
                counts, ids = known.encode(some.column(1))
                ends = np.concatenate([[0], np.cumsum(counts)])
                tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(np.full(len(counts), part, np.int32)), pa.array(start + ends[:-1]), pa.array(counts), tokens],
                    names=["doc_id", "part", "start_in_part", "n_tokens", "tokens"])
                start, at = start + int(ends[-1]), at + step

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY) -> None:
    """Encodes and writes ``docs`` (doc_id, text) to Parquet files in ascending id order."""
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(
        partitions(docs.sparkSession), F.col("doc_id").asc()).sortWithinPartitions(F.col("doc_id").asc())
    encoded = ordered.mapInArrow(_encode_partitions(vocabulary), FILE_SCHEMA)
    encoded.write.options(**WRITE_OPTIONS).parquet(path)


def read_tokens(spark: SparkSession, path: str, where: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """Rows of the files with ``start``, the ids of all documents before. ``where`` (on doc_id, n_tokens) reaches the
    page index and ``columns`` the scan; starts come from the counts of each part (one row per part) and are right
    for any selection."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = F.expr("coalesce(sum(_n) over (order by part rows between unbounded preceding and 1 preceding), 0)")
    offsets = totals.select(F.col("part").alias("_part"), before.alias("_before"))
    wanted = files if where is None else files.where(where)
    kept = columns or ["doc_id", "n_tokens", "tokens"]
    return wanted.join(F.broadcast(offsets), F.col("part") == F.col("_part")).select(
        *kept, (F.col("_before") + F.col("start_in_part")).cast("long").alias("start"))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        lists = rows.column("tokens")
        offsets, data = lists.offsets.to_pylist(), memoryview(lists.values.to_numpy()).cast("B")
        crcs = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(offsets, offsets[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("start"), rows.column("n_tokens"),
                                          pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op8_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place, length and checksum, read back from the written files."""
    path = scratch(spark, "tokens")
    write_tokens(table(spark, folder, "documents").select("doc_id", "text"), path)
    return read_tokens(spark, path).mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")
