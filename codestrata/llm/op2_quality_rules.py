"""Quality rules as a bitmask ledger (DataFrame functions only).

Every rule is evaluated once per document; the ledger keeps one failure bit per rule next to the measurements. A policy
is a version, a mask of the rules it enforces and how many of them a document may fail; applying another version, or
asking what one rule costs, reads the bits and never the texts.

Nulls and edge cases: a null, empty or blank text has no words, all measures 0 and fails ``too_few_words``; any other
column may be null and is carried. Repeated rows are judged each for itself. Extra columns are kept by ``ledger``
unless they have the name of a measure, which replaces them. One row's text is handled inside one task, in time linear
in its length (n log n where windows repeat)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm.common import free, let, others, table, words

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_bangs"]

# Rule name and failing condition over the measures; the bit is the position. The first two are the base rules.
RULES: list[tuple[str, str]] = [
    ("too_few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbol_heavy", "10 * n_symbols > 3 * n_words"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    ("repeated_lines", "n_lines >= 4 and 10 * n_dup_lines > 5 * n_lines"),
    ("shouting", "2 * n_upper > word_chars"),
    ("exclaiming", "10 * n_bangs > 3 * n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE_MASK = BIT["too_few_words"] | BIT["repeated_windows"]

# version, mask of enforced rules, failures a document may have among them
POLICIES: list[tuple[str, int, int]] = [
    ("base", BASE_MASK, 0),
    ("v1", sum(BIT.values()), 0),
    ("v1-lenient", sum(BIT.values()) & ~BASE_MASK, 1),
]


def _repeat_words(tokens: Column) -> Column:
    """Words inside 8-word windows that occur twice or more in the text, the first occurrence included.

    Window hashes come from doubling (1, 2, 4, 8 words), each a pass over the array. Only a text whose window hashes
    are not all different goes on: its windows are sorted by hash, those equal to a neighbour are repeated, and the
    words they cover are counted from the sorted starts."""

    def doubled(hashes: Column, step: int) -> Column:
        return let(hashes, lambda h: F.zip_with(
            F.slice(h, 1, F.greatest(F.size(h) - step, F.lit(0))),
            F.slice(h, 1 + step, F.greatest(F.size(h) - step, F.lit(0))),
            lambda x, y: F.xxhash64(x, y)))

    hashes = F.transform(tokens, lambda w: F.xxhash64(w))
    windows = doubled(doubled(doubled(hashes, 1), 2), 4)

    def covered(starts: Column) -> Column:
        return let(starts, lambda p: F.lit(WINDOW).cast("long") + F.aggregate(
            F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda x, y: F.least(y - x, F.lit(WINDOW))),
            F.lit(0).cast("long"), lambda total, x: total + x))

    def repeated(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        starts = let(pairs, lambda s: F.sort_array(F.filter(
            F.transform(s, lambda x, i: F.when(
                F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)), x["i"])),
            lambda x: x.isNotNull())))
        return covered(starts)

    return F.when(F.size(tokens) > WINDOW, let(windows, lambda h: F.when(
        F.size(F.array_distinct(h)) < F.size(h), repeated(h)).otherwise(F.lit(0).cast("long")))).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with the measures (long each), read from the whole text once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    has_word = r"[^\x20\x09-\x0D]"
    per_row = let(words(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _repeat_words(w).alias("n_repeat_words")))
    lines = let(F.filter(F.split(text, "\n"), lambda line: line.rlike(has_word)), lambda kept: F.struct(
        F.size(kept).cast("long").alias("n_lines"),
        (F.size(kept) - F.size(F.array_distinct(kept))).cast("long").alias("n_dup_lines")))
    kept = others(docs, *MEASURES)
    w, per_line = free(docs, "_w", "_l")
    return docs.select(*kept, per_row.alias(w), lines.alias(per_line),
                       F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                       F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_upper"),
                       F.regexp_count(text, F.lit("!")).cast("long").alias("n_bangs")).select(
        *kept, f"{w}.n_words", f"{w}.word_chars", "n_symbols", f"{per_line}.n_lines", f"{per_line}.n_dup_lines", f"{w}.n_repeat_words", "n_upper", "n_bangs")


def ledger(docs: DataFrame) -> DataFrame:
    """The measures and ``fail_bits`` (long): every rule evaluated once."""
    bits = F.lit(0).cast("long")
    for name, failing in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(failing), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    return measure(docs).withColumn("fail_bits", bits)


def apply_policy(rows: DataFrame, version: str, name: str = "kept") -> DataFrame:
    """A verdict column from the stored bits: at most the policy's allowed number of enforced rules failed."""
    mask, allowed = next((m, a) for v, m, a in POLICIES if v == version)
    return rows.withColumn(name, F.bit_count(F.col("fail_bits").bitwiseAND(F.lit(mask))) <= allowed)


def ablations(rows: DataFrame) -> DataFrame:
    """(version, rule, kept, kept_without): for each policy and each rule it enforces, the documents kept with it and
    with that rule left out. The ledger is first reduced to one row per bit pattern (at most 2^rules)."""
    patterns = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("_docs"))
    cases = [F.struct(F.lit(version).alias("version"), F.lit(rule).alias("rule"), F.lit(mask).alias("mask"),
                      F.lit(mask & ~BIT[rule]).alias("without"), F.lit(allowed).alias("allowed"))
             for version, mask, allowed in POLICIES for rule, _ in RULES if mask & BIT[rule]]
    c = patterns.select("fail_bits", "_docs", F.explode(F.array(*cases)).alias("c"))

    def kept(mask: str) -> Column:
        return F.sum(F.when(F.bit_count(F.col("fail_bits").bitwiseAND(F.col(mask))) <= F.col("c.allowed"), F.col("_docs"))
                     .otherwise(F.lit(0))).cast("long")

    return c.groupBy("c.version", "c.rule").agg(kept("c.mask").alias("kept"), kept("c.without").alias("kept_without"))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's measures, failure bits and the verdict of policy ``v1``."""
    rows = apply_policy(ledger(table(spark, folder, "documents").select("doc_id", "text")), "v1")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (F.col("fail_bits").bitwiseAND(F.lit(BASE_MASK)) != 0).alias("base_failed"), "kept", "fail_bits")


SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 wins AS (SELECT doc_id, i, w[i:i + 7] AS win FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM docs)),
 starts AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM wins) WHERE n > 1),
 gaps AS (SELECT doc_id, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8) AS gap FROM starts),
 reps AS (SELECT doc_id, CAST(sum(least(gap, 8)) AS BIGINT) AS n_repeat_words FROM gaps GROUP BY doc_id),
 m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS BIGINT) AS n_lines,
  CAST(len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_kinds,
  coalesce(n_repeat_words, 0) AS n_repeat_words, len(regexp_extract_all(text, '[A-Z]')) AS n_upper, len(regexp_extract_all(text, '!')) AS n_bangs
  FROM docs d LEFT JOIN reps r ON r.doc_id = d.doc_id),
 l AS (SELECT *, n_lines - n_kinds AS n_dup_lines FROM m),
 b AS (SELECT *, CAST((CASE WHEN n_words < 20 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
  + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END) + (CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 8 ELSE 0 END)
  + (CASE WHEN n_lines >= 4 AND 10 * n_dup_lines > 5 * n_lines THEN 16 ELSE 0 END) + (CASE WHEN 2 * n_upper > word_chars THEN 32 ELSE 0 END)
  + (CASE WHEN 10 * n_bangs > 3 * n_words THEN 64 ELSE 0 END) AS BIGINT) AS fail_bits FROM l)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""
