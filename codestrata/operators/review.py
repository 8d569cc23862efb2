"""Reviewing a range: what it newly breaks, which findings hold up, which issues a run would raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions import text
from codestrata.operators.rules import KEY_COLUMNS, key_hash, severity_label

# Accepted labels, weights and limits of findings.
SEVERITY_WEIGHT = {"critical": 4, "high": 3, "medium": 2, "low": 1}
CATEGORIES = ("bug", "security", "error-handling", "concurrency", "resource", "performance", "architecture")
MIN_CONFIDENCE = 0.5
LINE_TOLERANCE = 2
MAX_ISSUES = 10
MAX_FILES = 12
BATCH_CHARS = 8_000
MAX_FILE_DIFF_CHARS = 200_000
EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"


def severity_weight(severity: Column) -> Column:
    return F.coalesce(*[F.when(severity == s, w) for s, w in SEVERITY_WEIGHT.items()])


# --- architecture -------------------------------------------------------------------------------------------


def introduced_violations(head: DataFrame, base: DataFrame) -> DataFrame:
    """Head violations whose seven-column key is not at base."""
    known = base.select(key_hash().alias("_key")).distinct()
    return head.withColumn("_key", key_hash()).join(known, "_key", "left_anti").drop("_key")


def resolved_pairs(head: DataFrame, base: DataFrame) -> DataFrame:
    """Distinct (rule, module) of base violations that are gone at head."""
    now = head.select(key_hash().alias("_key")).distinct()
    gone = base.withColumn("_key", key_hash()).join(now, "_key", "left_anti")
    return gone.select("rule_name", F.col("caller_module").alias("module")).distinct()


def architecture_findings(introduced: DataFrame, rules: DataFrame) -> DataFrame:
    """One finding per (rule, caller module). Its edges are counted, and the first one in key order stands for
    the group, so a module with any number of violations costs one aggregate row."""
    first = F.min(F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in KEY_COLUMNS[4:]])).alias("_first")
    groups = introduced.groupBy("rule_name", F.col("caller_module").alias("file")).agg(
        F.count(F.lit(1)).alias("n_edges"), F.max("severity").alias("rule_severity"), F.max("edge").alias("edge"), first)
    named = groups.join(F.broadcast(rules.select("rule_name", "rule_from", "rule_to")), "rule_name")
    what = F.when(F.col("edge") == "imports", "imports").otherwise("calls into")
    return named.select(
        F.lit("architecture").alias("kind"), F.lit("architecture").alias("category"), severity_label(F.col("rule_severity")).alias("severity"),
        F.lit(1.0).alias("confidence"), "file", "rule_name", "n_edges", F.col("_first.callee_module").alias("first_callee"),
        F.concat(F.lit("New "), "rule_from", F.lit(" → "), "rule_to", F.lit(" dependency breaks rule '"), "rule_name", F.lit("'")).alias("title"),
        F.concat(F.lit("`"), "file", F.lit("` ("), "rule_from", F.lit(" layer) "), what, F.lit(" the "), "rule_to", F.lit(" layer "),
                 F.col("n_edges").cast("string"), F.lit(" time(s), which the rule '"), "rule_name", F.lit("' forbids.")).alias("explanation"),
        text.fingerprint(F.lit("arch"), F.col("rule_name"), F.col("file")).alias("fingerprint"))


def locate(lines: DataFrame, needles: DataFrame, keys: list[str]) -> DataFrame:
    """First line that contains a needle and is no comment: (keys, needle, line_no, line). ``lines`` is
    (keys, line_no, line), ``needles`` (keys, needle)."""
    hit = lines.join(needles, keys).filter(F.col("line").contains(F.col("needle")) & ~F.ltrim("line").rlike(r"^(#|//|\*)"))
    return hit.groupBy(*keys, "needle").agg(F.min(F.struct("line_no", "line")).alias("_f")).select(
        *keys, "needle", F.col("_f.line_no").alias("line_no"), F.trim("_f.line").alias("line"))


# --- findings -----------------------------------------------------------------------------------------------


def validate(findings: DataFrame, added: DataFrame, windows: DataFrame) -> DataFrame:
    """Adds ``reason``: why a finding is not grounded in the diff, the first failing check, null when it is.

    ``findings`` has an ``id`` and text fields; ``added`` is (file, line_no) of the diff's added lines;
    ``windows`` is (file, line_no, window) with the normalised text around a line. A finding looks at the five
    lines around its own, an equi-join on exact line numbers rather than a range join."""
    line, confidence = F.col("line").try_cast("bigint"), F.col("confidence").try_cast("double")
    f = findings.withColumn("_line", line)
    in_diff = added.select("file").distinct().withColumn("_in", F.lit(True))
    around = f.select("id", "file", F.explode(F.sequence(F.col("_line") - LINE_TOLERANCE, F.col("_line") + LINE_TOLERANCE)).alias("line_no"))
    near = around.join(added.select("file", "line_no").distinct(), ["file", "line_no"], "left_semi").select("id").distinct().withColumn("_near", F.lit(True))
    shown = windows.select("file", F.col("line_no").alias("_line"), "window")
    j = f.join(in_diff, "file", "left").join(near, "id", "left").join(shown, ["file", "_line"], "left")
    severity, category = F.lower(F.trim("severity")), F.lower(F.trim("category"))
    quote = text.normalize_space(F.col("quote"))
    place = F.concat(F.lit("line "), F.col("_line").cast("string"), F.lit(" of "), F.col("file"))
    reason = (
        F.when(F.col("_in").isNull(), F.concat(F.lit("file '"), "file", F.lit("' is not in the reviewed diff")))
        .when(F.col("_line").isNull(), "line is not a number")
        .when(F.col("_near").isNull(), F.concat(place, F.lit(" is not an added line")))
        .when(~severity.isin(*SEVERITY_WEIGHT), F.concat(F.lit("severity '"), severity, F.lit("' is not one of " + ", ".join(SEVERITY_WEIGHT))))
        .when(~category.isin(*CATEGORIES), F.concat(F.lit("category '"), category, F.lit("' is not one of " + ", ".join(CATEGORIES))))
        .when(confidence.isNull(), "confidence is not a number")
        .when(confidence < MIN_CONFIDENCE, F.concat(F.lit("confidence "), F.col("confidence").cast("string"), F.lit(f" is below {MIN_CONFIDENCE}")))
        .when((F.length(quote) < 4) | ~F.contains(F.coalesce("window", F.lit("")), quote), F.concat(F.lit("quote does not match "), place))
        .when(text.normalize_space(F.col("title")) == "", "title is empty"))
    return j.withColumn("reason", reason).drop("_line", "_in", "_near", "window")


def code_fingerprint(category: Column, file: Column, quote: Column) -> Column:
    return text.fingerprint(F.lit("code"), category, file, text.normalize_space(quote))


def line_windows(lines: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line_no, window): the normalised text from the line before to the second line after each wanted
    line, four joined rows per wanted line."""
    need = wanted.select(*keys, "line_no").distinct().withColumn("_at", F.explode(F.array(*[F.lit(d) for d in (-1, 0, 1, 2)])))
    got = need.withColumn("_no", F.col("line_no") + F.col("_at")).join(lines.select(*keys, F.col("line_no").alias("_no"), "line"), [*keys, "_no"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_no", "line"))), lambda x: x["line"]), " ")
    return got.groupBy(*keys, "line_no").agg(text.normalize_space(joined).alias("window"))


def drop_near_rule_findings(findings: DataFrame, architecture: DataFrame) -> DataFrame:
    """Drops reviewed findings of category architecture within two lines of a rule finding in the same file. The
    band becomes an equi-join: every rule finding covers five exact lines."""
    covered = architecture.filter("line IS NOT NULL").select("file", F.explode(F.sequence(
        F.col("line") - LINE_TOLERANCE, F.col("line") + LINE_TOLERANCE)).alias("line")).distinct().withColumn("category", F.lit("architecture"))
    return findings.join(covered, ["file", "line", "category"], "left_anti")


def rank_findings(findings: DataFrame) -> DataFrame:
    """One finding per fingerprint (architecture first, then input order ``ord``), ordered by weight times
    confidence. Dedupe is a min_by; the final order is a distributed sort numbered without one big window."""
    from codestrata.session import global_index

    row = F.struct(*[c for c in findings.columns if c != "fingerprint"])
    first = findings.groupBy("fingerprint").agg(F.min_by(row, F.struct((F.col("kind") != "architecture").alias("a"), F.col("ord"))).alias("r"))
    scored = first.select("fingerprint", "r.*").withColumn("score", F.round(severity_weight(F.col("severity")) * F.col("confidence"), 2))
    order = [F.desc("score"), (F.col("kind") != "architecture").asc(), F.col("file"), F.coalesce("line", F.lit(0)), F.col("ord")]
    return global_index(scored, order, "rank").withColumn("rank", F.col("rank") + 1)


# --- issues -------------------------------------------------------------------------------------------------


def plan_issues(findings: DataFrame, issues: DataFrame, min_severity: str = "medium", max_issues: int = MAX_ISSUES,
                selected: DataFrame | None = None) -> DataFrame:
    """(fingerprint, action, reason) for ranked findings (``rank`` is their order).

    Precedence: already open, closed before, below the threshold, not selected, over the limit, create. The
    first issue of a fingerprint counts. Which creatable findings fall under the limit needs only the
    ``max_issues`` best ranks, a top-k, not a running count over everything."""
    known = issues.groupBy("fingerprint").agg(F.min_by(F.struct("state", "number"), "number").alias("_issue"))
    j = findings.join(known, "fingerprint", "left")
    if selected is not None:
        j = j.join(selected.select("fingerprint").distinct().withColumn("_chosen", F.lit(True)), "fingerprint", "left")
    else:
        j = j.withColumn("_chosen", F.lit(True))
    below = severity_weight(F.col("severity")) < SEVERITY_WEIGHT.get(min_severity, 2)
    number = F.col("_issue.number").cast("string")
    blocked = (
        F.when(F.col("_issue.state") == "open", F.concat(F.lit("already open as #"), number))
        .when(F.col("_issue").isNotNull(), F.concat(F.lit("closed as #"), number, F.lit("; not re-raised")))
        .when(below, f"below the {min_severity} threshold")
        .when(F.col("_chosen").isNull(), "not selected"))
    judged = j.select("fingerprint", "rank", blocked.alias("_blocked"))
    chosen = judged.filter("_blocked IS NULL").orderBy("rank", "fingerprint").limit(max_issues).select(
        "fingerprint", "rank").withColumn("_create", F.lit(True))
    planned = judged.join(F.broadcast(chosen), ["fingerprint", "rank"], "left")
    return planned.select(
        "fingerprint", F.when(F.col("_create"), "create").otherwise("skip").alias("action"),
        F.when(F.col("_create"), "").otherwise(F.coalesce("_blocked", F.lit(f"over the {max_issues}-issue limit for one run"))).alias("reason"))


def resolvable_issues(issues: DataFrame, findings: DataFrame, violating: DataFrame, files: DataFrame) -> DataFrame:
    """Open issues absent from this review that are verifiably gone: an architecture issue whose (rule, module)
    no longer violates, a code issue whose masked quote is no longer in its masked file. Unknown kinds and
    missing information resolve nothing."""
    open_now = issues.filter("state = 'open'").join(findings.select("fingerprint").distinct(), "fingerprint", "left_anti")
    arch = open_now.filter("kind = 'architecture'").join(
        violating.select(F.col("rule_name").alias("rule"), "module").distinct(), ["rule", "module"], "left_anti")
    arch = arch.select("number", F.lit("the rule violation no longer exists").alias("reason"))
    code = open_now.filter("kind = 'code' AND file IS NOT NULL AND quote IS NOT NULL AND quote <> ''").join(
        files.select("file", text.normalize_space(text.mask_secrets(F.col("content"))).alias("_text")), "file", "left")
    gone = code.filter(F.col("_text").isNull() | ~F.contains("_text", text.normalize_space(text.mask_secrets(F.col("quote")))))
    return arch.unionByName(gone.select("number", F.lit("the flagged code is no longer in the file").alias("reason")))


def decode_issues(raw: DataFrame, marker: str = "codestrata:meta", limit: int | None = None) -> DataFrame:
    """Issues carrying a base64 JSON marker with a fingerprint; pull requests are not issues. ``raw`` is
    (number, state, title, body, is_pull_request)."""
    encoded = F.regexp_extract("body", rf"<!-- {marker}=([A-Za-z0-9+/=]+) -->", 1)
    meta = F.from_json(F.try_to_binary(encoded, F.lit("base64")).cast("string"),
                       "fp string, kind string, rule string, module string, file string, quote string")
    found = raw.filter(~F.col("is_pull_request") & (encoded != "")).withColumn("m", meta).filter("m.fp IS NOT NULL AND m.fp <> ''")
    out = found.select("number", "state", "title", F.col("m.fp").alias("fingerprint"), "m.kind", "m.rule", "m.module", "m.file", "m.quote")
    return out if limit is None else out.orderBy("number").limit(limit)


def encode_meta(meta: Column, marker: str = "codestrata:meta") -> Column:
    """The hidden marker that ties an issue to its finding."""
    return F.concat(F.lit(f"<!-- {marker}="), F.regexp_replace(F.base64(F.encode(F.to_json(meta), "UTF-8")), r"\s", ""), F.lit(" -->"))


def review_order(files: DataFrame, limit: int = MAX_FILES) -> DataFrame:
    """Changed files in review order: tests last, most added lines first; the first ``limit`` are reviewed."""
    return files.orderBy("is_test", F.desc("n_added"), "path").limit(limit)


def skip_reasons(files: DataFrame) -> Column:
    """Why a diff file is left out, '' when it is reviewed."""
    from codestrata.functions.paths import review_skip_reason

    return (F.when(F.col("status") == "deleted", "deleted").when(F.col("binary"), "binary").when(F.col("n_added") == 0, "no added lines")
            .when(review_skip_reason(F.col("path")) != "", review_skip_reason(F.col("path")))
            .when(F.col("n_chars") > MAX_FILE_DIFF_CHARS, "diff too large (likely generated)").otherwise(""))


def next_fit(sizes: Column, budget: int = BATCH_CHARS) -> Column:
    """Batch number of each size when consecutive items share a batch until the budget would overflow: one fold
    over an ordered array (one file's hunks, or one review's dozen files)."""
    return F.aggregate(
        sizes, F.struct(F.lit(0).alias("b"), F.lit(0).cast("bigint").alias("used"), F.array().cast("array<int>").alias("out")),
        lambda acc, s: F.when((acc["used"] > 0) & (acc["used"] + s > budget), F.struct(
            (acc["b"] + 1).alias("b"), s.cast("bigint").alias("used"), F.concat(acc["out"], F.array(acc["b"] + 1)).alias("out"))).otherwise(F.struct(
                acc["b"].alias("b"), (acc["used"] + s).cast("bigint").alias("used"), F.concat(acc["out"], F.array(acc["b"])).alias("out"))),
        lambda acc: acc["out"])
