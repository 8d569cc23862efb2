"""Scoring results against known truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.text import tokens
from codestrata.session import stored

MATCH_DAYS = 30
BLOCK_WORDS = 1_000_000  # words of a block of records, or of decisions, that meet in one task


def precision_recall(expected: DataFrame, predicted: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """tp / fp / fn with precision, recall and F1 per ``by`` group (1.0 on an empty denominator). Both sides are
    marked and summed per key: one shuffle instead of a full outer join."""
    marks = expected.select(*keys).distinct().withColumn("_e", F.lit(1)).withColumn("_p", F.lit(0)).unionByName(
        predicted.select(*keys).distinct().withColumn("_e", F.lit(0)).withColumn("_p", F.lit(1)))
    outcome = marks.groupBy(*keys).agg(F.max("_e").alias("_e"), F.max("_p").alias("_p"))
    counts = outcome.groupBy(*by).agg(F.count_if((F.col("_e") == 1) & (F.col("_p") == 1)).alias("tp"),
                                      F.count_if((F.col("_e") == 0) & (F.col("_p") == 1)).alias("fp"), F.count_if((F.col("_e") == 1) & (F.col("_p") == 0)).alias("fn"))
    return counts.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1.0)).withColumn(
        "recall", ratio(F.col("tp"), F.col("tp") + F.col("fn"), 1.0)).withColumn(
        "f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0.0))


def ratio(part: Column, whole: Column, empty: float) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(empty)


def routing_accuracy(routed: DataFrame) -> DataFrame:
    """Share of questions whose expected intent is among the routed ones, and whose only one it is."""
    hit = F.array_contains("intents", F.col("expected"))
    return routed.agg(F.count(F.lit(1)).alias("questions"), F.count_if(hit).alias("hits"),
                      F.avg(F.when(hit & (F.size("intents") == 1), 1.0).otherwise(0.0)).alias("exact"))


def _best_in_block(days: int):
    """A block of record sets and one of decision sets -> the best decision of each record set and day (``match_records``)."""

    def run(records, decisions):
        import numpy as np
        import pyarrow as pa

        def parts(column):
            lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            return lists.flatten(), sizes, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])

        ours, _, begins = parts(records.column("_w"))
        theirs, sizes, _ = parts(decisions.column("_w"))
        numbers = pa.concat_arrays([ours, theirs]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        mine, held = numbers[:len(ours)], numbers[len(ours):]
        # the decision sets that hold each word, one after the other
        holders = np.repeat(np.arange(len(sizes)), sizes)[np.argsort(held, kind="stable")]
        at = np.concatenate([[0], np.cumsum(np.bincount(held, minlength=int(numbers.max(initial=-1)) + 1))])
        found, counts, _ = parts(decisions.column("_found"))
        order = np.argsort(found.field("day").to_numpy(zero_copy_only=False), kind="stable")
        day, owner = found.field("day").to_numpy(zero_copy_only=False)[order], np.repeat(np.arange(len(counts)), counts)[order]
        ids = found.field("decision").take(pa.array(order))
        wanted, _, first = parts(records.column("_days"))
        wanted = wanted.to_numpy(zero_copy_only=False)
        out = []
        for i in range(records.num_rows):
            lists = [holders[at[w]:at[w + 1]] for w in mine[begins[i]:begins[i + 1]]]
            shared = np.bincount(np.concatenate(lists), minlength=len(sizes)) if lists else np.zeros(len(sizes), np.int64)
            for d in wanted[first[i]:first[i + 1]].tolist():
                low, high = np.searchsorted(day, [d - days, d + days + 1])
                near = shared[owner[low:high]]
                most = int(near.max(initial=0))
                if most:
                    equal = low + np.flatnonzero(near == most)
                    gaps = np.abs(day[equal] - d)
                    least = min(ids.take(pa.array(equal[gaps == gaps.min()])).to_pylist(), key=lambda x: (x is not None, x))
                    out.append((i, d, least, most, int(gaps.min())))
        rows, dates, chosen, most, gap = zip(*out) if out else ((),) * 5
        return pa.table({"_set": records.column("_set").take(pa.array(rows, pa.int64())), "_d": pa.array(dates, pa.int32()),
                         "decision": pa.array(chosen, ids.type), "shared": pa.array(most, pa.int64()), "_gap": pa.array(gap, pa.int32())})

    return run


def match_records(records: DataFrame, decisions: DataFrame, generic: tuple[str, ...] = (), days: int = MATCH_DAYS) -> DataFrame:
    """(record, temporal, decision, shared): for each written record the detected decision within the window
    that shares most topic words, the nearest on ties; ``temporal`` says whether any decision is in the window.

    Equal word sets of one date bucket, which is as wide as the window, count once. Sets of neighbouring buckets meet in
    blocks of bounded size; a task counts shared words in a word index of its block and gives one row for each record set
    and day, so the pairs themselves, which grow with the square of a busy bucket, are never rows."""
    topic = lambda c: F.array_sort(F.array_distinct(F.filter(tokens(c), lambda w: ~w.isin(*generic)) if generic else tokens(c)))
    day = lambda c: F.unix_date(F.to_date(c))
    # words hold letters and digits only, so a space keeps them apart
    named = lambda df: df.withColumn("_set", F.unhex(F.sha2(F.array_join("_w", " "), 256))).withColumn("_b", F.floor(F.col("_d") / (days + 1)))
    r = stored(named(records.select("record", day("date").alias("_d"), topic(F.col("title")).alias("_w"))))
    d = stored(named(decisions.select("decision", day("date").alias("_d"), topic(F.col("topic")).alias("_w"))))
    dated = "_d IS NOT NULL AND size(_w) > 0"
    sets = r.where(dated).groupBy("_set", "_b").agg(F.any_value("_w").alias("_w"), F.collect_set("_d").alias("_days")).withColumn(
        "_b", F.explode(F.array(*[F.col("_b") + k for k in (-1, 0, 1)])))
    have = d.where(dated).groupBy("_set", "_b", "_d").agg(F.any_value("_w").alias("_w"), F.min("decision").alias("decision")).groupBy("_set", "_b").agg(
        F.any_value("_w").alias("_w"), F.collect_list(F.struct(F.col("_d").alias("day"), "decision")).alias("_found"))
    sets, have = stored(sets), stored(have)
    # one row a bucket: the blocks on either side
    blocks = lambda df, name: df.groupBy("_b").agg(F.ceil(F.sum(F.size("_w")) / BLOCK_WORDS).alias(name))
    dealt = F.broadcast(blocks(sets, "_rows").join(blocks(have, "_columns"), "_b"))
    mine = lambda n: F.pmod(F.xxhash64("_set"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    left = sets.join(dealt, "_b").select("_b", mine("_rows").alias("_i"), every("_columns").alias("_j"), "_set", "_w", "_days")
    right = have.join(dealt, "_b").select("_b", every("_rows").alias("_i"), mine("_columns").alias("_j"), "_w", "_found")
    # few bytes, much work: the partitions are named, so that they are not put together by their size
    key, spark = ["_b", "_i", "_j"], records.sparkSession
    wide = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    left, right = left.repartition(wide, *key), right.repartition(wide, *key)
    kind = decisions.schema["decision"].dataType.simpleString()
    met = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_best_in_block(days), f"_set binary, _d int, decision {kind}, shared bigint, _gap int")
    best = met.groupBy("_set", "_d").agg(F.min_by(F.struct("decision", "shared"), F.struct(-F.col("shared"), F.col("_gap"), F.col("decision"))).alias("b"))
    around = r.select("_d").distinct().select("_d", F.explode(F.sequence(F.col("_d") - days, F.col("_d") + days)).alias("_day"))
    near = around.join(d.select(F.col("_d").alias("_day")).distinct(), "_day", "left_semi").select("_d").distinct().withColumn("temporal", F.lit(True))
    return r.select("record", "_d", "_set").join(near, "_d", "left").join(best, ["_set", "_d"], "left").select(
        "record", F.coalesce("temporal", F.lit(False)).alias("temporal"), F.col("b.decision").alias("decision"), F.coalesce("b.shared", F.lit(0)).cast("bigint").alias("shared"))


def parse_records(files: DataFrame) -> DataFrame:
    """(path, title, date, excerpt) of decision-record documents: title from the first heading without its
    number, date from the file name or a date field."""
    name = F.lower(F.substring_index("path", "/", -1))
    heading = F.regexp_extract("content", r"(?m)^#+\s*(.*?)\s*$", 1)
    title = F.trim(F.regexp_replace(F.when(heading == "", name).otherwise(heading), r"(?i)^(adr[-\s]*)?\d+[.:)\-\s]+", ""))
    dashed = F.regexp_replace(F.regexp_extract(name, r"^(\d{8})-", 1), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    named = F.regexp_extract(name, r"^(\d{4}-\d{2}-\d{2})", 1)
    field = F.regexp_extract("content", r"(?im)^\s*[-*]?\s*\**date\**\s*:\s*\**\s*(\d{4}-\d{2}-\d{2})", 1)
    filled = lambda c: F.nullif(c, F.lit(""))
    body = F.trim(F.regexp_replace(F.regexp_replace("content", r"(?s)\A[^\n]*(\n|\z)", ""), r"\s+", " "))
    return files.filter(~name.isin("readme.md", "index.md") & ~name.contains("template")).select(
        "path", title.alias("title"), F.coalesce(filled(dashed), filled(named), filled(field)).alias("date"), body.alias("excerpt"))


def rubric_scores(rows: DataFrame) -> DataFrame:
    """Mean accuracy, completeness and hallucination rate over scored table rows (``row`` text)."""
    cells = F.split(F.trim("row", F.lit("| ")), r"\s*\|\s*")
    parsed = rows.select(F.get(cells, F.lit(0)).try_cast("double").alias("a"), F.get(cells, F.lit(1)).try_cast("double").alias("c"),
                         F.lower(F.get(cells, F.lit(2))).startswith("y").alias("h"))
    scored = F.col("a").isNotNull() & F.col("c").isNotNull() & F.col("h").isNotNull()
    return parsed.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(scored).alias("scored"), F.avg(F.when(scored, F.col("a"))).alias("accuracy"),
                      F.avg(F.when(scored, F.col("c"))).alias("completeness"), F.avg(F.when(scored, F.col("h").cast("double"))).alias("hallucination_rate"))


def rule_rates(checks: DataFrame) -> DataFrame:
    """Violation rate per rule, null for rules that judged nothing."""
    return checks.withColumn("rate", F.when(F.col("checks") > 0, F.col("violations").cast("double") / F.col("checks")))


def lowest_health(trended: DataFrame) -> DataFrame:
    """The snapshot with the lowest health (first on ties)."""
    return trended.filter("health IS NOT NULL").agg(F.min(F.struct("health", "idx")).alias("m")).select(F.col("m.health").alias("health"), F.col("m.idx").alias("idx"))


def usage_by_purpose(calls: DataFrame) -> DataFrame:
    """Requests, failures, tokens and seconds per feature; a request with no calls and no failures was cached."""
    return calls.groupBy("purpose").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("calls").alias("calls"), F.sum("failures").alias("failures"), F.sum("tokens").alias("tokens"),
        F.round(F.sum("seconds"), 1).alias("seconds"), F.count_if((F.col("calls") == 0) & (F.col("failures") == 0)).alias("from_cache"))


def number_answered(answer: Column, expected: Column, tolerance: float = 0.051) -> Column:
    """Some number in the answer is within the tolerance of the expected one."""
    values = F.transform(F.regexp_extract_all(answer, F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)), lambda v: v.try_cast("double"))
    return F.exists(values, lambda v: F.abs(v - expected) < tolerance)


def set_score(got: Column, expected: Column) -> tuple[Column, Column]:
    """(precision, recall) of two arrays."""
    tp = F.size(F.array_intersect(got, expected)).cast("double")
    precision = F.when(F.size(got) > 0, tp / F.size(got)).otherwise(F.when(F.size(expected) == 0, 1.0).otherwise(0.0))
    return precision, F.when(F.size(expected) > 0, tp / F.size(expected)).otherwise(1.0)


def sensitivity(scored: DataFrame, weightings: list[tuple[float, float, float]], threshold: float, top_k: int) -> DataFrame:
    """(decision, weighting, jaccard): how much of each decision's evidence stays the same under other weights.
    ``scored`` has the three factors per pair; weightings are a short list, exploded beside each pair."""
    options = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for i, (a, b, c) in enumerate(weightings)])
    each = scored.select("decision", "hash", "time", "graph", "text", F.explode(options).alias("w")).withColumn(
        "r", F.col("w.a") * F.col("time") + F.col("w.b") * F.col("graph") + F.col("w.c") * F.col("text")).filter(F.col("r") >= threshold)
    order = Window.partitionBy("decision", "w.i").orderBy(F.desc("r"), "hash")
    kept = each.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= top_k)
    sets = kept.groupBy("decision", F.col("w.i").alias("weighting")).agg(F.collect_set("hash").alias("s"))
    base = sets.filter("weighting = 0").select("decision", F.col("s").alias("b"))
    union = F.size(F.array_union("s", "b"))
    return sets.filter("weighting > 0").join(base, "decision").select(
        "decision", "weighting", (F.size(F.array_intersect("s", "b")) / union).alias("jaccard"))
