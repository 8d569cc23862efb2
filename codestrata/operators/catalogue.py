"""The fifteen read-only questions, as functions from parameters to DataFrames.

A ``Model`` names the relations of one analysis. Every tool is a fixed, parameterised query; callers choose a name
and arguments, never a query. Lists keep the limits a reader sees, totals are exact."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.operators import decisions, graph, history, rules, source_text, temporal


@dataclass
class Model:
    """modules(path, language, layer_type), classes(module_path, name), functions(module_path, class_name, name,
    signature), imports(from, to), calls(...), commits(hash, short, date, author, subject), touched(hash, path, added,
    deleted), presence(from, to, idx), trend(idx, health, ...), sources(path, content), decisions(id, sha, kind,
    subject, date, packages, commit_subject), records(id, title, confidence), rules table; ``order`` puts commits
    oldest first."""

    modules: DataFrame
    classes: DataFrame
    functions: DataFrame
    imports: DataFrame
    calls: DataFrame
    commits: DataFrame
    touched: DataFrame
    presence: DataFrame
    trend: DataFrame
    sources: DataFrame
    decisions: DataFrame
    records: DataFrame
    rules: DataFrame
    order: tuple[str, ...] = ("date", "hash")


def _overview(m: Model) -> dict[str, DataFrame]:
    shown = graph.module_overview(m.modules, m.classes, m.functions).orderBy("path").limit(60)
    groups = m.modules.groupBy(graph.group_key(F.col("path"), F.col("layer_type")).alias("group")).agg(F.count(F.lit(1)).alias("modules"))
    return {"modules": shown, "groups": groups, "languages": m.modules.groupBy("language").agg(F.count(F.lit(1)).alias("modules")),
            "most_imported": graph.most_imported(m.imports), "most_called": graph.most_called(m.calls)}


def _search(m: Model, query: str) -> dict[str, DataFrame]:
    return {"modules": graph.search(m.modules, "path", query, [F.length("path"), "path"], 15),
            "classes": graph.search(m.classes, "name", query, ["module_path", "name"], 15),
            "functions": graph.search(m.functions, "name", query, ["module_path", "name", "class_name"], 20)}


def _module(m: Model, path: str) -> dict[str, DataFrame]:
    return {"candidates": graph.resolve_module(m.modules, path),
            "members": m.functions.filter(F.col("module_path") == path).orderBy("class_name", "name"),
            "imports": m.imports.filter(F.col("from") == path).orderBy("to"), "imported_by": m.imports.filter(F.col("to") == path).orderBy("from"),
            "calls_into": graph.module_calls(m.calls, path, "caller"), "called_from": graph.module_calls(m.calls, path, "callee")}


def _function(m: Model, name: str, module_path: str | None = None) -> dict[str, DataFrame]:
    bare = name.rstrip("()")
    if "::" in bare:
        part, bare = bare.split("::", 1)
        module_path = module_path or part
    owner = None
    if "." in bare:
        owner, bare = bare.rsplit(".", 1)
        owner = owner.rsplit(".", 1)[-1]
    found = graph.function_matches(m.functions, bare, owner, module_path)
    return {"matches": found, "partners": graph.call_partners(found, m.calls),
            "suggestions": graph.search(m.functions, "name", bare, [F.length("name"), "module_path", "name"], 10)}


def _impact(m: Model, path: str) -> dict[str, DataFrame]:
    reached = graph.reverse_reach(m.imports, path).orderBy("distance", "module").limit(60)
    return {"dependents": reached, "external_call_sites": graph.external_call_sites(m.calls, path)}


def _health(m: Model) -> dict[str, DataFrame]:
    edges = rules.import_edges(m.imports).unionByName(rules.call_edges(m.calls))
    judged = rules.judged_edges(edges, m.modules.select("path", "layer_type"), m.rules)
    return {"score": rules.health(judged, m.rules), "checks": rules.rule_checks(judged, m.rules),
            "violations": rules.format_violations(rules.violations(judged)).orderBy(*rules.violation_order()),
            "layers": m.modules.groupBy("layer_type").agg(F.count(F.lit(1)).alias("modules"))}


def _file_history(m: Model, path: str) -> dict[str, DataFrame]:
    known = not m.modules.filter(F.col("path") == path).isEmpty()
    found = history.commits_touching(m.commits, m.touched, path) if known else history.commits_naming(m.commits, m.touched, path)
    newest = [F.desc(c) for c in m.order]
    return {"commits": found.orderBy(*newest).limit(12), "authors": history.file_authors(found), "total": found.agg(F.count(F.lit(1)).alias("commits")),
            "introduced": found.orderBy(*m.order).limit(1)}


def _commit(m: Model, commit: str) -> dict[str, DataFrame]:
    found = history.commit_by_prefix(m.commits, commit)
    return {"commit": found, "files": history.commit_files(found, m.touched),
            "decisions": m.decisions.join(found.select(F.col("hash").alias("sha")), "sha", "left_semi").orderBy("id")}


def _contributors(m: Model, path: str | None = None) -> dict[str, DataFrame]:
    scope = m.commits if path is None else history.commits_touching(m.commits, m.touched, path)
    return {"contributors": history.contributors_by_name(scope)}


def _trend(m: Model) -> dict[str, DataFrame]:
    moved = temporal.trend(m.trend)
    return {"snapshots": moved.orderBy("idx"), "largest_moves": temporal.largest_moves(moved)}


def _compare(m: Model, from_snapshot: int = 0, to_snapshot: int | None = None) -> dict[str, DataFrame]:
    count = m.trend.agg(F.max("idx") + 1).first()[0] or 0
    a = temporal.clamp(from_snapshot, count)
    b = temporal.clamp(count - 1 if to_snapshot is None else to_snapshot, count)
    ends = m.presence.select(F.explode(F.array("from", "to")).alias("path"), "idx")
    return {"dependencies": temporal.compare(m.presence, ["from", "to"], F.lit(a), F.lit(b)), "modules": temporal.compare(ends, ["path"], F.lit(a), F.lit(b))}


def _list_decisions(m: Model) -> dict[str, DataFrame]:
    return {"decisions": m.decisions.join(m.records.select("id", "title", "confidence"), "id", "left").orderBy("date", "id")}


def _explain(m: Model, decision: str) -> dict[str, DataFrame]:
    best = decisions.best_match(m.decisions, decision)
    return {"decision": best, "record": m.records.join(F.broadcast(best.select("id")), "id", "left_semi")}


def _read(m: Model, path: str, start_line: int = 1, end_line: int | None = None) -> dict[str, DataFrame]:
    return {"lines": source_text.read_lines(m.sources, path, start_line, end_line)}


def _search_text(m: Model, query: str) -> dict[str, DataFrame]:
    hits = source_text.search_lines(m.sources, query)
    return {"summary": source_text.search_summary(hits), "matches": source_text.first_hits(hits)}


TOOLS: dict[str, Callable[..., dict[str, DataFrame]]] = {
    "get_repository_overview": _overview, "search_entities": _search, "get_module_details": _module, "get_function_details": _function,
    "get_change_impact": _impact, "get_architecture_health": _health, "read_source": _read, "search_source_text": _search_text,
    "get_file_history": _file_history, "get_commit": _commit, "get_contributors": _contributors, "get_drift_trend": _trend,
    "compare_snapshots": _compare, "list_decisions": _list_decisions, "explain_decision": _explain,
}


def ask(model: Model, tool: str, **arguments) -> dict[str, DataFrame]:
    """Runs one tool by name; unknown tools and arguments are errors, never free-form queries."""
    if tool not in TOOLS:
        raise KeyError(f"unknown tool {tool!r}; one of {', '.join(sorted(TOOLS))}")
    return TOOLS[tool](model, **arguments)
