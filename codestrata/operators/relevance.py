"""Which commits are evidence for a decision: time, touched files and text, combined.

Documents are (doc, token) rows rather than arrays: a commit message and each touched path are tokenised where
they are, so no document is ever assembled in one place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions import paths, text
from codestrata.session import dealt

# Weights of time, files and text; threshold; evidence kept; the window around a decision.
TIME_WEIGHT, FILE_WEIGHT, TEXT_WEIGHT = 0.3, 0.45, 0.25
THRESHOLD = 0.35
TOP_K = 12
WINDOW_DAYS = 30
WINDOW_COMMITS = 40
PATHS_PER_COMMIT, PATHS_PER_DECISION = 50, 30
FREQUENT_TOKENS = 100_000  # sent to every task


def term_counts(rows: DataFrame, doc: str, columns: list[Column]) -> DataFrame:
    """(doc, token, n) from text columns."""
    pieces = F.concat(*[text.tokens(c) for c in columns])
    # texts are dealt by document, as their terms take several times the room
    return dealt(rows, doc).select(F.col(doc), F.explode(pieces).alias("token")).groupBy(doc, "token").agg(F.count(F.lit(1)).alias("n"))


def merge_counts(parts: list[DataFrame], doc: str) -> DataFrame:
    """Adds term counts of several sources of one document."""
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy(doc, "token").agg(F.sum("n").alias("n"))


def commit_terms(commits: DataFrame, touched: DataFrame, messages: list[Column], per_commit: int = PATHS_PER_COMMIT, path: Column | None = None) -> DataFrame:
    """Terms of a commit: its message and its first touched paths (``file_ord`` order). Messages and paths are dealt by commit
    once, in which the rank and the counts follow. ``path`` gives a path's text if ``touched`` holds keys."""
    said = commits.select("hash", F.lit(None).alias("file_ord"), F.lit(None).alias("path"), F.array(*messages).alias("_said"))
    rows = touched.select("hash", "file_ord", "path", F.lit(None).cast("array<string>").alias("_said"))
    both = rows.unionByName(said.select("hash", F.col("file_ord").cast(rows.schema["file_ord"].dataType), F.col("path").cast(rows.schema["path"].dataType), "_said"))
    place = F.sum(F.when(F.col("_said").isNull(), 1).otherwise(0)).over(
        Window.partitionBy("hash").orderBy("file_ord").rowsBetween(Window.unboundedPreceding, 0))
    first = both.withColumn("_n", place).filter(F.col("_said").isNotNull() | (F.col("_n") <= per_commit))
    pieces = F.flatten(F.transform(F.coalesce("_said", F.array(F.col("path") if path is None else path)), text.tokens))
    return first.select("hash", F.explode(pieces).alias("token")).groupBy("hash", "token").agg(F.count(F.lit(1)).alias("n"))


def inverse_frequency(terms: DataFrame, n_docs: DataFrame) -> DataFrame:
    """token -> ln((1 + N) / (1 + df)) + 1. ``n_docs`` is one row (n_docs): documents without terms count too."""
    df = terms.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.join(F.broadcast(n_docs)).select(
        "token", (F.log((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def vectors(terms: DataFrame, idf: DataFrame, n_docs: DataFrame, doc: str) -> DataFrame:
    """Unit-length (doc, token, weight) with (1 + ln n) * idf; terms never seen get the highest idf."""
    raw = terms.join(idf, "token", "left").join(F.broadcast(n_docs)).select(
        doc, "token", ((1.0 + F.log(F.col("n").cast("double"))) * F.coalesce("idf", F.log(1.0 + F.col("n_docs")) + 1.0)).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc)))  # over one document's terms
    return raw.select(doc, "token", (F.col("w") / norm).alias("w"))


def weights(terms: DataFrame, idf: DataFrame, n_docs: DataFrame, doc: str, frequent: int = FREQUENT_TOKENS) -> DataFrame:
    """(doc, token, w): ``vectors`` before they have unit length, of terms that all have an ``idf``. Most terms are of the most
    frequent tokens, which every task knows; only terms of other tokens are dealt by token. ``terms`` and ``idf`` are stored."""
    top = F.broadcast(idf.orderBy("idf", "token").limit(frequent))
    met = terms.join(top, "token", "left")
    rare = met.filter("idf IS NULL").drop("idf").join(idf.join(top.select("token"), "token", "left_anti"), "token", "left")
    raw = met.filter("idf IS NOT NULL").unionByName(rare).join(F.broadcast(n_docs))
    return raw.select(doc, "token", ((1.0 + F.log(F.col("n").cast("double"))) * F.coalesce("idf", F.log(1.0 + F.col("n_docs")) + 1.0)).alias("w"))


def length() -> Column:
    """Euclidean length of the weights ``w`` of a group."""
    return F.sqrt(F.sum(F.col("w") * F.col("w")))


def similarities(queries: DataFrame, terms: DataFrame, idf: DataFrame, n_docs: DataFrame, query: str, doc: str) -> DataFrame:
    """``cosines`` of few queries (unit vectors) with all documents, from their stored ``terms``: a document's length and products
    are sums, so its vector is never put together."""
    asked = F.broadcast(queries.select(query, "token", F.col("w").alias("_q")))
    here = terms.join(F.broadcast(queries.select("token").distinct()), "token", "left_semi")
    dots = weights(here, idf.join(F.broadcast(queries.select("token").distinct()), "token", "left_semi"), n_docs, doc).join(asked, "token").groupBy(
        query, doc).agg(F.sum(F.col("w") * F.col("_q")).alias("_dot"))
    lengths = weights(terms, idf, n_docs, doc).groupBy(doc).agg(length().alias("_length"))
    return dots.join(lengths, doc).select(query, doc, (F.col("_dot") / F.col("_length")).alias("similarity"))


def cosines(queries: DataFrame, documents: DataFrame, query: str, doc: str) -> DataFrame:
    """(query, doc, similarity) for pairs sharing a term. Meant for few queries: their vectors are the small
    side, and the products are summed map-side."""
    q = queries.select(query, "token", F.col("w").alias("_q"))
    return documents.join(q, "token").groupBy(query, doc).agg(F.sum(F.col("w") * F.col("_q")).alias("similarity"))


def focus_files(decisions: DataFrame, usage: DataFrame, imports: DataFrame, path: Column | None = None) -> DataFrame:
    """(decision, path, weight): a decision's own files without manifests and lock files, and the modules using
    its packages, weigh 1; what they import or are imported by weighs 0.5.

    ``decisions`` is (decision, path), ``usage`` is (decision, path). ``path`` gives a path's text if they hold keys."""
    own = decisions.filter(~paths.is_dependency_file(F.col("path") if path is None else path)).select("decision", "path")
    core = own.unionByName(usage.select("decision", "path")).distinct()
    ends = imports.select(F.col("from").alias("path"), F.col("to").alias("other")).unionByName(
        imports.select(F.col("to").alias("path"), F.col("from").alias("other")))
    near = core.join(ends, "path").select("decision", F.col("other").alias("path"))
    weighted = core.withColumn("weight", F.lit(1.0)).unionByName(near.withColumn("weight", F.lit(0.5)))
    return weighted.groupBy("decision", "path").agg(F.max("weight").alias("weight"))


def band_pairs(decisions: DataFrame, commits: DataFrame, steps: int = WINDOW_COMMITS, days: int = WINDOW_DAYS) -> DataFrame:
    """(decision, hash, steps, days) for usable commits near each decision. ``decisions`` is (decision, sha, idx,
    date), ``commits`` is (hash, idx, date, usable).

    Positions are cut into buckets as wide as the band, a decision looks into its own bucket and the two beside
    it: an equi-join whose output is at most 2 * steps rows per decision."""
    width = steps + 1
    left = decisions.select("decision", "sha", F.col("idx").alias("_i"), F.to_date("date").alias("_d"), F.explode(F.array(
        *[F.floor(F.col("idx") / width) + k for k in (-1, 0, 1)])).alias("_bucket"))
    right = commits.filter("usable").select("hash", F.col("idx").alias("_j"), F.to_date("date").alias("_e"),
                                            F.floor(F.col("idx") / width).alias("_bucket"))
    near = left.join(right, "_bucket").withColumn("steps", F.abs(F.col("_i") - F.col("_j"))).withColumn(
        "days", F.coalesce(F.abs(F.datediff("_d", "_e")), F.lit(days)).cast("double"))
    return near.filter((F.col("steps") <= steps) & (F.col("days") <= days) & (F.col("hash") != F.col("sha"))).select(
        "decision", "hash", "steps", "days")


def time_proximity(days: Column, steps: Column) -> Column:
    return 0.5 * F.exp(-days / 7.0) + 0.5 * F.exp(-steps / 10.0)


def file_proximity(pairs: DataFrame, touched: DataFrame, focus: DataFrame) -> DataFrame:
    """(decision, hash, graph): focus weight a commit hits over the smaller of both file counts, at most 1. The
    band pairs are joined first, so a path everyone touches only meets the commits near each decision."""
    sizes = touched.groupBy("hash").agg(F.count(F.lit(1)).alias("n_files"))
    focus_size = focus.groupBy("decision").agg(F.count(F.lit(1)).alias("n_focus"))
    hits = pairs.select("decision", "hash").join(touched.select("hash", "path"), "hash").join(
        focus, ["decision", "path"]).groupBy("decision", "hash").agg(F.sum("weight").alias("hit"))
    return hits.join(sizes, "hash").join(focus_size, "decision").select(
        "decision", "hash", F.least(F.lit(1.0), F.col("hit") / F.least("n_files", "n_focus")).alias("graph"))


def text_similarity(pairs: DataFrame, commit_vectors: DataFrame, decision_vectors: DataFrame) -> DataFrame:
    """(decision, hash, text) for the band pairs only."""
    q = decision_vectors.select("decision", "token", F.col("w").alias("_q"))
    return pairs.select("decision", "hash").join(commit_vectors, "hash").join(q, ["decision", "token"]).groupBy(
        "decision", "hash").agg(F.sum(F.col("w") * F.col("_q")).alias("text"))


def score_pairs(pairs: DataFrame, graph: DataFrame, similarity: DataFrame,
                weights: tuple = (TIME_WEIGHT, FILE_WEIGHT, TEXT_WEIGHT)) -> DataFrame:
    """All considered pairs with their factors and relevance."""
    t, g, x = weights
    joined = pairs.join(graph, ["decision", "hash"], "left").join(similarity, ["decision", "hash"], "left")
    zero = F.lit(0.0)
    return joined.select(
        "decision", "hash", "steps", time_proximity(F.col("days"), F.col("steps")).alias("time"),
        F.coalesce("graph", zero).alias("graph"), F.coalesce("text", zero).alias("text"),
    ).withColumn("relevance", t * F.col("time") + g * F.col("graph") + x * F.col("text"))


def evidence(scored: DataFrame, decisions: DataFrame, commits: DataFrame, threshold: float = THRESHOLD, top_k: int = TOP_K) -> DataFrame:
    """The decision commit first (relevance 1), then the best commits above the threshold. Groups hold at most
    the band's rows, and the rank is a top-k."""
    near = scored.filter(F.col("relevance") >= threshold).join(commits.select("hash", "idx"), "hash").select(
        "decision", "hash", "idx", *[F.round(c, 3).alias(c) for c in ("relevance", "time", "graph", "text")])
    order = Window.partitionBy("decision").orderBy(F.desc("relevance"), "idx")
    best = near.withColumn("rank", F.row_number().over(order) + 1).filter(F.col("rank") <= top_k)
    one = F.lit(1.0)
    anchor = decisions.select("decision", F.col("sha").alias("hash"), "idx", *[one.alias(c) for c in ("relevance", "time", "graph", "text")],
                              F.lit(1).alias("rank"))
    return anchor.unionByName(best)


def jaccard(a: Column, b: Column) -> Column:
    """|A n B| / |A u B|, 1 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def confidence_cap(relevances: Column, n: Column, rationale: Column, unsupported: Column) -> Column:
    """Upper bound on confidence from the evidence besides the decision commit."""
    cap = (0.3 + 0.35 * F.coalesce(relevances, F.lit(0.0)) + 0.05 * F.least(n, F.lit(6)) + F.when(rationale, 0.15).otherwise(0.0)
           - F.when(unsupported, 0.1).otherwise(0.0))
    return F.greatest(F.lit(0.1), F.least(F.lit(0.95), cap))


def confidence_label(value: Column) -> Column:
    return F.when(value >= 0.7, "High").when(value >= 0.45, "Medium").otherwise("Low")
