"""The rules document: layers (which modules belong where), ignored modules, and dependency rules.

The document is small by definition (at most 20,000 characters, 20 layers of 60 patterns, 50 rules), so it is
validated on the driver and becomes either generated column expressions or a broadcast-sized table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from codestrata.session import literal_table

MAX_DOCUMENT_CHARS = 20_000
MAX_LAYERS, MAX_PATTERNS, MAX_RULES = 20, 60, 50
PATTERN_KINDS = ("file", "dir", "glob")
LAYER_NAME = re.compile(r"^[a-z][a-z_]{0,29}$")
RULE_NAME = re.compile(r"^[A-Za-z0-9_.-]{1,60}$")

# The default layered rules document.
DEFAULT_RULES_TEXT = """\
pattern: layered
layers:
  controller:
    - {file: controller.py}
    - {file: "*_controller.py"}
    - {file: "*.controller.ts"}
    - {file: "*.controller.js"}
    - {dir: controllers}
    - {dir: controller}
    - {dir: routes}
    - {dir: routers}
    - {dir: views}
    - {dir: handlers}
    - {dir: endpoints}
    - {dir: entrypoints}
  service:
    - {file: service.py}
    - {file: "*_service.py"}
    - {file: "*.service.ts"}
    - {file: "*.service.js"}
    - {dir: services}
    - {dir: service}
    - {dir: service_layer}
    - {dir: usecases}
    - {dir: use_cases}
    - {dir: application}
  database:
    - {file: database.py}
    - {file: "*_repository.py"}
    - {file: "*.repository.ts"}
    - {file: "*.repository.js"}
    - {dir: repositories}
    - {dir: repository}
    - {dir: dao}
    - {dir: db}
    - {dir: database}
    - {dir: adapters}
    - {dir: infrastructure}
  model:
    - {file: "*.entity.ts"}
    - {file: "*.model.js"}
    - {dir: models}
    - {dir: entities}
    - {dir: domain}
ignore:
  - {dir: test}
  - {dir: tests}
  - {dir: __tests__}
  - {dir: spec}
  - {dir: e2e}
  - {file: "test_*.py"}
  - {file: "*_test.py"}
  - {file: conftest.py}
  - {file: "*.test.*"}
  - {file: "*.spec.*"}
rules:
  - {name: no-controller-to-db, from_layer: controller, to_layer: database, allowed: false, severity: 3}
  - {name: no-controller-imports-db, edge: imports, from_layer: controller, to_layer: database, allowed: false, severity: 2}
  - {name: no-service-imports-controller, edge: imports, from_layer: service, to_layer: controller, allowed: false, severity: 2}
  - {name: no-db-imports-service, edge: imports, from_layer: database, to_layer: service, allowed: false, severity: 2}
  - {name: no-db-imports-controller, edge: imports, from_layer: database, to_layer: controller, allowed: false, severity: 2}
  - {name: controller-to-service-allowed, from_layer: controller, to_layer: service, allowed: true, severity: 0}
  - {name: service-to-db-allowed, from_layer: service, to_layer: database, allowed: true, severity: 0}
"""

RULE_SCHEMA = ("rule_name string, edge string, rule_from string, rule_to string, allowed boolean, "
               "severity int, rule_ord int")


class RulesError(ValueError):
    """The rules document is invalid; the message says what to fix."""


def _require(condition, message: str) -> None:
    if not condition:
        raise RulesError(message)


def _patterns(where: str, entries) -> list[tuple[str, str]]:
    _require(isinstance(entries, list), f"{where} must be a list of patterns")
    out = []
    for entry in entries:
        _require(isinstance(entry, dict) and set(entry) <= set(PATTERN_KINDS) or not isinstance(entry, dict),
                 f"{where}: unknown pattern kind")
        given = [(k, v) for k, v in entry.items() if v] if isinstance(entry, dict) else []
        _require(len(given) == 1, f"{where}: each layer pattern needs exactly one of file:, dir: or glob:")
        kind, pattern = given[0]
        _require(isinstance(pattern, str) and len(pattern) <= 200, f"{where}: a pattern is text of at most 200 characters")
        out.append((kind, pattern))
    return out


def _rule(entry, layers: dict) -> dict:
    _require(isinstance(entry, dict), "each rule must be a mapping")
    name = entry.get("name")
    _require(isinstance(name, str) and RULE_NAME.match(name), f"rule name {name!r} is missing or has other characters")
    for side in ("from_layer", "to_layer"):
        layer = entry.get(side)
        _require(isinstance(layer, str) and LAYER_NAME.match(layer), f"rule '{name}': {side} is not a layer name")
        _require(not layers or layer in layers, f"rule '{name}' uses layer '{layer}', which the layers section doesn't define")
    _require(isinstance(entry.get("allowed"), bool), f"rule '{name}': allowed must be true or false")
    severity = entry.get("severity")
    _require(isinstance(severity, int) and not isinstance(severity, bool) and 0 <= severity <= 10,
             f"rule '{name}': severity must be between 0 and 10")
    edge = entry.get("edge", "calls")
    _require(edge in ("calls", "imports"), f"rule '{name}': edge must be 'calls' or 'imports'")
    return {"name": name, "from_layer": entry["from_layer"], "to_layer": entry["to_layer"],
            "allowed": entry["allowed"], "severity": severity, "edge": edge}


def parse_rules(text: str) -> dict:
    """YAML text -> {"pattern", "layers": {name: [(kind, pattern)]}, "ignore": [...], "rules": [...]}."""
    import yaml

    _require(len(text) <= MAX_DOCUMENT_CHARS, f"Rules YAML is too long (max {MAX_DOCUMENT_CHARS} characters).")
    try:
        raw = yaml.safe_load(text)
    except yaml.YAMLError as exc:
        raise RulesError(f"Rules YAML could not be parsed: {exc}") from None
    _require(isinstance(raw, dict), "Rules YAML must be a mapping with a 'rules' list.")
    layers = {}
    _require(len(raw.get("layers") or {}) <= MAX_LAYERS, f"at most {MAX_LAYERS} layers")
    for name, entries in (raw.get("layers") or {}).items():
        _require(isinstance(name, str) and LAYER_NAME.match(name),
                 f"layer name '{name}' must be lowercase letters/underscores (max 30)")
        layers[name] = _patterns(f"layer '{name}'", entries)
        _require(len(layers[name]) <= MAX_PATTERNS, f"layer '{name}' has more than {MAX_PATTERNS} patterns")
    ignore = _patterns("ignore", raw.get("ignore") or [])
    _require(len(ignore) <= MAX_PATTERNS, f"ignore has more than {MAX_PATTERNS} patterns")
    entries = raw.get("rules")
    _require(isinstance(entries, list) and 1 <= len(entries) <= MAX_RULES, f"rules must list 1 to {MAX_RULES} rules")
    rules = [_rule(e, layers) for e in entries]
    names = [r["name"] for r in rules]
    duplicates = sorted({n for n in names if names.count(n) > 1})
    _require(not duplicates, f"duplicate rule names: {', '.join(duplicates)}")
    return {"pattern": raw.get("pattern", "custom"), "layers": layers, "ignore": ignore, "rules": rules}


def default_rules() -> dict:
    return parse_rules(DEFAULT_RULES_TEXT)


def rules_table(spark: SparkSession, document: dict) -> DataFrame:
    """One row per rule (at most 50, so joins may broadcast it)."""
    rows = [(r["name"], r["edge"], r["from_layer"], r["to_layer"], r["allowed"], r["severity"], i)
            for i, r in enumerate(document["rules"])]
    return literal_table(spark, rows, RULE_SCHEMA)
