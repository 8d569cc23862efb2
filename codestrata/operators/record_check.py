"""Drafted decision records held against their evidence.

A draft cites commits (its evidence items, and hashes in brackets in its texts), files and pull-request or issue numbers.
``citations`` gives one verdict row for each distinct citation, ``verdicts`` one row for each record.

Every lookup is an equi-join on the record and a key of fixed length: an abbreviated hash has at least seven characters and
so does a cited one, so whatever their lengths, two of them can only agree if their first seven do. No citation meets
evidence it cannot match, and a record that holds most of the citations is only a long key a join can split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.operators.relevance import confidence_cap, confidence_label
from codestrata.session import stored

# What counts as a citation in a record's text, and the fields a record has.
HASH_CITATION = r"\[([0-9a-f]{7,40})\]"
NUMBER_MENTION = r"(?U)(?<![\w&/])#(\d{1,7})\b"
PATH_MENTION = r"(?U)(?<![\w/.-])([\w.-]+(?:/[\w.-]+)*\.(?:py|js|jsx|ts|tsx|json|toml|txt|yml|yaml|ini|cfg|md))\b"
PRODUCT_NAME = r"^[A-Z][A-Za-z0-9]*\.js$"
TEXT_FIELDS = ("title", "context", "decision", "consequences", "alternatives", "inference")
REQUIRED_FIELDS = ("title", "context", "decision", "inference")
LEAST_HASH = 7
UNUSABLE_CONFIDENCE = 0.1
CONFIDENCE_DEFAULT = 0.5


def draft_text() -> Column:
    """All texts of a draft, joined by a space."""
    return F.concat_ws(" ", *[F.coalesce(F.col(f), F.lit("")) for f in TEXT_FIELDS])


def normal_hash(cited: Column) -> Column:
    """A cited hash without white space and brackets around it, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(cited, r"^\s+|\s+$", ""), r"^[\[\]]+|[\[\]]+$", ""))


def cited_commits(hashes: DataFrame, items: DataFrame, evidence: DataFrame) -> DataFrame:
    """``hashes`` is (record_id, cited), those in the texts. (record_id, cited, in_items, in_text, place, match): each distinct commit citation, the first evidence commit it
    names (null: none) and its first place among the items."""
    every = items.select("record_id", F.coalesce("commit", F.lit("")).alias("cited"), F.col("ord").alias("place"), F.lit(True).alias("in_items")).unionByName(
        hashes.select("record_id", "cited", F.lit(None).cast("long").alias("place"), F.lit(False).alias("in_items")))
    normal = normal_hash(F.col("cited"))
    # dealt by the key the evidence is met by, in which the groups before and after the join lie
    keyed = every.withColumn("_normal", normal).withColumn("_key", F.when(F.length("_normal") >= LEAST_HASH, F.left("_normal", F.lit(LEAST_HASH))))
    distinct = keyed.repartition("record_id", "_key").groupBy("record_id", "_key", "cited").agg(
        F.max("in_items").alias("in_items"), F.max(~F.col("in_items")).alias("in_text"), F.min("place").alias("place"), F.first("_normal").alias("_normal"))
    known = evidence.select(F.col("record_id").alias("_record"), F.left("hash", F.lit(LEAST_HASH)).alias("_known"), "hash", "short", "pos")
    agrees = F.col("hash").startswith(F.col("_normal")) | F.col("_normal").startswith(F.col("short"))
    joined = distinct.join(known, (F.col("record_id") == F.col("_record")) & (F.col("_key") == F.col("_known")) & agrees, "left")
    return joined.groupBy("record_id", "_key", "cited", "in_items", "in_text", "place").agg(F.min_by("short", "pos").alias("match")).drop("_key")


def citations(drafts: DataFrame, items: DataFrame, evidence: DataFrame, payloads: DataFrame, attached: DataFrame) -> DataFrame:
    """(record_id, kind, cited, in_items, in_text, place, match, supported): a row for each distinct commit, path and number.

    ``drafts``: record_id and the text fields; ``items``: record_id, ord, commit; ``evidence``: record_id, pos, hash, short (seven
    characters or more); ``payloads``: record_id, payload (the evidence as text, one row a record); ``attached``: record_id, number
    of the pull requests and issues that belong to the evidence. A path is supported if the payload holds it, in any case, or
    if it is the name of a product; a null text or payload is empty."""
    def in_text(rows: DataFrame, kind: str, match: Column, supported: Column) -> DataFrame:
        return rows.select("record_id", F.lit(kind).alias("kind"), "cited", F.lit(False).alias("in_items"), F.lit(True).alias("in_text"),
                           F.lit(None).cast("long").alias("place"), match.alias("match"), supported.alias("supported"))

    # a draft's texts are read once, with the payload beside them, before citations become rows
    texts = drafts.select("record_id", draft_text().alias("_text")).join(
        payloads.select("record_id", F.lower("payload").alias("_payload")), "record_id", "left")
    each = lambda pattern: F.array_distinct(F.regexp_extract_all("_text", F.lit(pattern), F.lit(1)))
    found = stored(texts.select(
        "record_id", each(HASH_CITATION).alias("hashes"),
        F.transform(each(PATH_MENTION), lambda path: F.struct(
            path.alias("cited"), (F.coalesce(F.contains("_payload", F.lower(path)), F.lit(False)) | path.rlike(PRODUCT_NAME)).alias("supported"))).alias("paths"),
        F.array_distinct(F.transform(each(NUMBER_MENTION), lambda n: n.cast("long"))).alias("numbers")))
    commits = cited_commits(found.select("record_id", F.explode("hashes").alias("cited")), items, evidence).select(
        "record_id", F.lit("commit").alias("kind"), "cited", "in_items", "in_text", "place", "match", F.col("match").isNotNull().alias("supported"))
    paths = in_text(found.select("record_id", F.inline("paths")), "path", F.lit(None).cast("string"), F.col("supported"))
    numbers = found.select("record_id", F.explode("numbers").alias("number"))
    linked = attached.select("record_id", F.col("number").cast("long").alias("number")).distinct().withColumn("_linked", F.lit(True))
    held = numbers.join(linked, ["record_id", "number"], "left").withColumn("cited", F.concat(F.lit("#"), F.col("number").cast("string")))
    return commits.unionByName(paths).unionByName(in_text(held, "number", F.lit(None).cast("string"), F.coalesce("_linked", F.lit(False))))


def verdicts(drafts: DataFrame, cited: DataFrame, scores: DataFrame) -> DataFrame:
    """A row for each draft: what it lacks, which citations hold, whether it can be used and how sure it may be.

    ``drafts`` has ``confidence`` (the claimed one) besides its texts; ``cited`` are its ``citations``; ``scores`` has record_id, relevance
    (mean over the evidence besides the decision commit), others (their number) and rationale. ``cited_commits`` lists evidence
    commits in order of the items that name them; the other lists are in order of their texts. A draft that lacks a required
    text or whose items name no evidence falls back to the lowest confidence."""
    listed = F.col("kind") == "commit"
    # a commit only a text cites, and a path, says nothing more once it is supported
    telling = cited.filter(~F.col("supported") | (listed & F.col("in_items")) | (F.col("kind") == "number"))
    by_record = telling.groupBy("record_id").agg(
        F.collect_list(F.when(listed & F.col("in_items") & F.col("supported"), F.struct("place", "match"))).alias("_items"),
        F.sort_array(F.collect_list(F.when(listed & ~F.col("supported"), F.col("cited")))).alias("invalid"),
        F.sort_array(F.collect_list(F.when(~listed & ~F.col("supported"), F.col("cited")))).alias("unsupported"),
        F.sort_array(F.collect_list(F.when((F.col("kind") == "number") & F.col("supported"), F.col("cited")))).alias("numbers"))
    none = F.array().cast("array<string>")
    held = drafts.join(by_record, "record_id", "left").join(scores, "record_id", "left").select(
        "record_id",
        F.array_compact(F.array(*[F.when(~F.coalesce(F.col(f), F.lit("")).rlike(r"\S"), F.lit(f)) for f in REQUIRED_FIELDS])).alias("missing"),
        F.coalesce(F.array_distinct(F.transform(F.sort_array("_items"), lambda x: x["match"])), none).alias("cited_commits"),
        *[F.coalesce(c, none).alias(c) for c in ("invalid", "unsupported", "numbers")],
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(CONFIDENCE_DEFAULT)))).alias("_claimed"),
        F.col("relevance"), F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("rationale", F.lit(False)).alias("rationale"))
    usable = (F.size("missing") == 0) & (F.size("cited_commits") > 0)
    cap = F.round(confidence_cap(F.col("relevance"), F.col("others"), F.col("rationale"), F.size("unsupported") > 0), 2)
    return (held.withColumn("usable", usable).withColumn("cap", cap)
            .withColumn("confidence", F.when(F.col("usable"), F.round(F.least("_claimed", "cap"), 2)).otherwise(F.lit(UNUSABLE_CONFIDENCE)))
            .withColumn("label", confidence_label(F.col("confidence")))
            .select("record_id", "missing", "cited_commits", "invalid", "unsupported", "numbers", "usable", "cap", "confidence", "label"))
