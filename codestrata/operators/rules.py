"""Rule evaluation: which edges a rule judges, which of them violate it, and the scores on top.

Edges are (edge, caller_module, caller_class, caller_name, callee_module, callee_class, callee_name); import
edges leave the class and name columns null. ``by`` adds leading keys such as a snapshot index, so every
snapshot is scored in the same job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDGE_COLUMNS = ["edge", "caller_module", "caller_class", "caller_name",
                "callee_module", "callee_class", "callee_name"]
KEY_COLUMNS = ["rule_name"] + EDGE_COLUMNS[1:]


def import_edges(imports: DataFrame, by: tuple = ()) -> DataFrame:
    """(from, to) pairs in the edge shape."""
    null = F.lit(None).cast("string")
    return imports.select(*by, F.lit("imports").alias("edge"), F.col("from").alias("caller_module"),
                          null.alias("caller_class"), null.alias("caller_name"), F.col("to").alias("callee_module"),
                          null.alias("callee_class"), null.alias("callee_name"))


def call_edges(calls: DataFrame, by: tuple = ()) -> DataFrame:
    return calls.select(*by, F.lit("calls").alias("edge"), *EDGE_COLUMNS[1:])


def judged_edges(edges: DataFrame, layers: DataFrame, rules: DataFrame, by: tuple = ()) -> DataFrame:
    """Every (rule, edge) a disallowed rule judges: the edge leaves the rule's from-layer and lands in any
    tagged module. ``violates`` is true when it lands in the forbidden layer.

    ``layers`` is (path, layer_type). It is reduced to one row per module first: a repeated path must not
    multiply edges, and past the aggregate Catalyst sees ``layer_type`` as a value, so it does not copy the
    classification regexes onto every edge row as an inferred filter. Untagged modules are dropped before the
    joins; a hot module on the edge side is split by AQE's skew join."""
    tagged = layers.groupBy("path").agg(F.max("layer_type").alias("layer_type")).filter("layer_type IS NOT NULL")
    source = tagged.select(F.col("path").alias("caller_module"), F.col("layer_type").alias("_from"))
    target = tagged.select(F.col("path").alias("callee_module"), F.col("layer_type").alias("_to"))
    banned = rules.filter(~F.col("allowed")).select("rule_name", "severity", F.col("edge"),
                                                    F.col("rule_from").alias("_from"), "rule_to")
    return (
        edges.join(source, "caller_module")
        .join(target, "callee_module")
        .join(F.broadcast(banned), ["edge", "_from"])
        .withColumn("violates", F.col("_to") == F.col("rule_to"))
        .select(*by, "rule_name", "severity", *EDGE_COLUMNS, "violates")
    )


def violations(judged: DataFrame) -> DataFrame:
    return judged.filter("violates").drop("violates")


def rule_checks(judged: DataFrame, rules: DataFrame) -> DataFrame:
    """Checks and violations per disallowed rule; rules that judged nothing stay with zeros."""
    counted = judged.groupBy("rule_name").agg(
        F.count(F.lit(1)).alias("_checks"), F.count_if("violates").alias("_violations"))
    return (
        rules.filter(~F.col("allowed"))
        .join(counted, "rule_name", "left")
        .select("rule_name", "edge", "severity",
                F.coalesce("_checks", F.lit(0)).cast("bigint").alias("checks"),
                F.coalesce("_violations", F.lit(0)).cast("bigint").alias("violations"))
    )


def health(judged: DataFrame, rules: DataFrame, by: tuple = ()) -> DataFrame:
    """Normalised and legacy health (null / 100 when nothing applies), unrounded.

    normalised = 100 (1 - sum(sev * min(1, violations/checks)) / sum(sev)) over rules with checks > 0 and
    severity > 0; legacy = 100 - 100 sum(severity of violations) / number of disallowed rules, clamped."""
    per_rule = judged.groupBy(*by, "rule_name", "severity").agg(
        F.count(F.lit(1)).alias("checks"), F.count_if("violates").alias("bad"))
    n_rules = rules.filter(~F.col("allowed")).agg(F.count(F.lit(1)).alias("n_rules"))
    rate = F.col("severity") * F.least(F.lit(1.0), F.col("bad").cast("double") / F.col("checks"))
    total = per_rule.groupBy(*by).agg(
        F.sum("checks").alias("checks"), F.sum("bad").alias("n_violations"),
        F.sum(F.col("severity") * F.col("bad")).alias("weighted_violations"),
        F.sum(rate).alias("_rate"), F.sum("severity").alias("_severity"))
    return total.join(F.broadcast(n_rules)).select(
        *by, "checks",
        F.coalesce("n_violations", F.lit(0)).cast("bigint").alias("n_violations"),
        F.coalesce("weighted_violations", F.lit(0)).cast("bigint").alias("weighted_violations"),
        F.when(F.col("_severity") > 0, 100.0 * (1.0 - F.col("_rate") / F.col("_severity"))).alias("health"),
        F.when(F.col("n_rules") == 0, F.lit(100.0)).otherwise(
            F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - 100.0 * F.coalesce("weighted_violations", F.lit(0))
                                           .cast("double") / F.col("n_rules")))).alias("health_legacy"),
    )


def qualified(module: Column, class_name: Column, name: Column) -> Column:
    """``module::Class.name`` or ``module::name``."""
    return F.concat(module, F.lit("::"), F.coalesce(F.concat(class_name, F.lit(".")), F.lit("")), name)


def format_violations(found: DataFrame) -> DataFrame:
    """Import violations read module -> module, call violations function -> function."""
    plain = (F.col("edge") == "imports") | F.col("caller_name").isNull()
    return found.withColumn(
        "caller", F.when(plain, F.col("caller_module")).otherwise(
            qualified(F.col("caller_module"), F.col("caller_class"), F.col("caller_name")))
    ).withColumn(
        "callee", F.when(plain, F.col("callee_module")).otherwise(
            qualified(F.col("callee_module"), F.col("callee_class"), F.col("callee_name"))))


def violation_order() -> list[Column]:
    """The seven key columns with nulls read as empty text."""
    return [F.coalesce(F.col(c), F.lit("")) for c in KEY_COLUMNS]


def severity_label(severity: Column) -> Column:
    return F.when(severity >= 3, "high").when(severity == 2, "medium").otherwise("low")


def key_hash(columns: list[str] = KEY_COLUMNS) -> Column:
    """Compact join key for the seven-column identity."""
    return F.sha1(F.concat_ws("\x1f", *[F.coalesce(F.col(c), F.lit("")) for c in columns]))


def first_seen(found: DataFrame, idx: str = "idx") -> DataFrame:
    """First snapshot in which each violation key appears."""
    return found.groupBy(*KEY_COLUMNS).agg(F.min(idx).alias("first_idx"))


def prioritize(found: DataFrame, imports: DataFrame, seen: DataFrame | None, last_idx: Column | int | None) -> DataFrame:
    """Rule groups ranked by sum(severity * (1 + ln(1 + fan-in)) * recency).

    Fan-in counts the modules importing the violated target; recency is 1 + 0.5 * first/last snapshot, 1 when
    the violation is in no snapshot. Fan-in is aggregated before it is joined, and violations collapse to
    (rule, target, first snapshot) counts before scoring, so nothing is collected per group."""
    fan_in = imports.groupBy(F.col("to").alias("callee_module")).agg(F.count(F.lit(1)).alias("fan_in"))
    if seen is not None:
        marked = found.withColumn("_key", key_hash()).join(
            seen.withColumn("_key", key_hash()).select("_key", "first_idx"), "_key", "left").drop("_key")
    else:
        marked = found.withColumn("first_idx", F.lit(None).cast("bigint"))
    cells = marked.groupBy("rule_name", "severity", "edge", "callee_module", "first_idx").agg(F.count(F.lit(1)).alias("n"))
    last = F.greatest(last_idx if isinstance(last_idx, Column) else F.lit(last_idx or 1), F.lit(1)).cast("double")
    recency = F.when(F.col("first_idx").isNotNull(), 1.0 + 0.5 * F.col("first_idx") / last).otherwise(1.0)
    fan = F.coalesce("fan_in", F.lit(0)).cast("double")
    groups = (
        cells.join(fan_in, "callee_module", "left")
        .groupBy("rule_name", "severity", "edge")
        .agg(F.sum(F.col("n") * F.col("severity") * (1.0 + F.log1p(fan)) * recency).alias("score"),
             F.sum("n").alias("occurrences"), F.max(fan).cast("bigint").alias("max_fan_in"),
             F.min("first_idx").alias("introduced_idx"))
    )
    # At most one row per rule (50), so a global window is bounded.
    ranked = groups.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "rule_name")).cast("bigint")) \
                   .withColumn("_top", F.max("score").over(Window.partitionBy()))
    rounded = F.round("score", 2)
    return ranked.withColumn(
        "priority", F.when(rounded >= 0.66 * F.col("_top"), "High").when(rounded >= 0.33 * F.col("_top"), "Medium")
        .otherwise("Low")).drop("_top")
