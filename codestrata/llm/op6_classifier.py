"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics are column expressions over the whole text. A small forest is grown on a bounded sample of labelled rows;
every path prefix of its trees is a conjunction of comparisons, a rule. A logistic regression with a lasso penalty
weighs the rules (most get 0), and the remaining ones are compiled into one column expression, so scoring is a
projection inside the scan's stage.

Training rows have ``crc32(doc_id as text) mod 5 <> 0``; at most about ``SAMPLE_ROWS`` of them are used, taken by a hash
of the id. Labels, language, source and id are never statistics.

Nulls and edge cases: a null, empty or blank text has all statistics 0 and gets a score like any other. Null labels
are not trained on; ids labelled more than once count once for each label row. With labels of fewer than two kinds the score is the smoothed share of
label 1 for every text. A null id has a null remainder and is held out. Extra columns are ignored. An empty table gives
no rows."""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm.common import cut, let, table, words

SAMPLE_ROWS = 20_000
FOLDS, HELD_OUT = 5, 0
TREES, DEPTH, SEED = 16, 3, 5
LASSO = 0.001
POSITIVE = 0.3

STATISTICS = ["log_words", "symbols_per_word", "bangs_per_word", "upper_share", "distinct_share", "echo_share", "word_length", "digit_share",
              "stops_per_word", "longest_word"]
# A rule: comparisons that all hold, each (statistic, "<=" or ">", threshold).
Rule = tuple[tuple[str, str, float], ...]


def statistics(text: Column) -> Column:
    """A struct of the statistics (double each)."""
    text = F.coalesce(text, F.lit(""))

    def over(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern))

    def of(w: Column) -> Column:
        n, chars = F.size(w), F.char_length(F.array_join(w, ""))
        echoes = F.size(F.filter(F.transform(w, lambda x, i: (i > 0) & (x == F.get(w, i - 1))), lambda x: x))
        return F.struct(
            F.log1p(n.cast("double")).alias("log_words"),
            over(count(r"[#*$%&|<>]"), n).alias("symbols_per_word"),
            over(count("!"), n).alias("bangs_per_word"),
            over(count("[A-Z]"), chars).alias("upper_share"),
            over(F.size(F.array_distinct(w)), n).alias("distinct_share"),
            over(echoes, n).alias("echo_share"),
            over(chars, n).alias("word_length"),
            over(count("[0-9]"), chars).alias("digit_share"),
            over(count(r"[.,;:?]"), n).alias("stops_per_word"),
            F.coalesce(F.array_max(F.transform(w, lambda x: F.char_length(x))), F.lit(0)).cast("double").alias("longest_word"))

    return let(words(text), of)


def rules_of(debug: str) -> list[Rule]:
    """Every path prefix of the trees in a forest's description, as a rule."""
    path: list[tuple[int, tuple[str, str, float]]] = []
    found: dict[Rule, None] = {}
    for line in debug.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            if re.match(r"\s*Tree \d+", line):
                path = []
            continue
        depth = len(m[1])
        while path and path[-1][0] >= depth:
            path.pop()
        path.append((depth, (STATISTICS[int(m[2])], m[3], float(m[4]))))
        found[tuple(sorted({c for _, c in path}))] = None
    return list(found)


def holds(rule: Rule) -> Column:
    """Whether a rule's comparisons all hold, over columns named as the statistics."""
    met = F.lit(True)
    for name, sign, threshold in rule:
        met = met & (F.col(name) <= threshold if sign == "<=" else F.col(name) > threshold)
    return met


class Ensemble:
    """Weighted rules; ``score`` is their compiled expression."""

    def __init__(self, intercept: float, weights: list[tuple[Rule, float]]):
        self.intercept, self.weights = intercept, weights

    def score(self) -> Column:
        total = F.lit(float(self.intercept))
        for rule, weight in self.weights:
            total = total + F.when(holds(rule), F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


class Constant(Ensemble):
    def __init__(self, share: float):
        super().__init__(0.0, [])
        self.share = share

    def score(self) -> Column:
        return F.lit(float(self.share))


def fit(rows: DataFrame) -> Ensemble:
    """From rows of statistics and ``quality`` (0 or 1), already bounded."""
    counts = {r["quality"]: r["count"] for r in rows.groupBy("quality").count().collect()}
    if len(counts) < 2:
        return Constant((counts.get(1, 0) + 1) / (sum(counts.values()) + 2))
    table_ = VectorAssembler(inputCols=STATISTICS, outputCol="features").transform(rows).withColumn("label", F.col("quality").cast("double"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, minInstancesPerNode=5, featureSubsetStrategy="0.5").fit(table_.select("features", "label"))
    rules = rules_of(forest.toDebugString)
    if not rules:
        return Constant((counts.get(1, 0) + 1) / (sum(counts.values()) + 2))
    names = [f"r{i}" for i in range(len(rules))]
    marked = cut(rows.select(F.col("quality").cast("double").alias("label"), *[holds(r).cast("double").alias(n) for n, r in zip(names, rules, strict=True)]))
    inputs = VectorAssembler(inputCols=names, outputCol="features").transform(marked).select("features", "label")
    model = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=60).fit(inputs)
    weights = [(r, w) for r, w in zip(rules, model.coefficients.toArray().tolist(), strict=True) if abs(w) > 1e-9]
    return Ensemble(model.intercept, weights)


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text), learnt from ``labels``."""
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS, F.lit(HELD_OUT))
    stats = cut(docs.select("doc_id", (fold == HELD_OUT).alias("held_out"), statistics(F.col("text")).alias("s")).select("doc_id", "held_out", "s.*"))
    known = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").alias("_id"), "quality")
    usable = stats.where("not held_out").join(known, F.col("doc_id") == F.col("_id"))
    # a bounded sample by a hash of the id: the share that leaves about sample_rows of the label rows
    n = known.count()
    share = min(1.0, sample_rows / max(n, 1))
    picked = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else usable
    train = cut(picked.select("doc_id", "quality", *STATISTICS).orderBy("doc_id", "quality").coalesce(4))
    score = fit(train).score()
    return stats.select("doc_id", "held_out", score.alias("score")).withColumn("predicted", F.when(F.col("score") >= POSITIVE, 1).otherwise(0))


def op6_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's quality score."""
    return classify(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels").select("doc_id", "quality"))
