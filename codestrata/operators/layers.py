"""Layer classification as one generated expression: no join, no UDF, evaluated where the path is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codestrata.functions import paths
from codestrata.functions.patterns import alternatives


# What a wildcard ranges over inside one folder or file name.
_NAME_CHAR = "[^/]"


def _of_kind(patterns: list[tuple[str, str]], kind: str) -> list[str]:
    return [p for k, p in patterns if k == kind]


def _whole_path(patterns: list[tuple[str, str]]) -> list[str]:
    """Regular expressions over the full path for each kind of pattern present."""
    globs, files, dirs = (_of_kind(patterns, k) for k in ("glob", "file", "dir"))
    out = []
    if globs:
        out.append("^" + alternatives(globs) + "\\z")
    if files:
        out.append("(?:^|/)" + alternatives(files, _NAME_CHAR) + "\\z")
    if dirs:
        out.append("(?:^|/)" + alternatives(dirs, _NAME_CHAR) + "/")
    return out


def is_ignored(path: Column, ignore: list[tuple[str, str]]) -> Column:
    """The path, its file name or any of its folders matches an ignore pattern: one regex for the list."""
    if not ignore:
        return F.lit(False)
    return path.rlike("(?is)" + "|".join(_whole_path(ignore)))


def _first_layer(value: Column, layers: dict, kind: str, prefix: str, any_char: str) -> Column:
    """The first declared layer with a pattern of this kind matching ``value``."""
    chain = None
    for layer, patterns in layers.items():
        chosen = _of_kind(patterns, kind)
        if chosen:
            hit = value.rlike(f"(?is){prefix}{alternatives(chosen, any_char)}\\z")
            chain = F.when(hit, layer) if chain is None else chain.when(hit, layer)
    return F.lit(None).cast("string") if chain is None else chain


def classify(path: Column, document: dict) -> Column:
    """Full-path globs first, then file names, then the innermost matching folder; null when ignored,
    unmatched, or the document declares no layers."""
    layers = document.get("layers") or {}
    if not layers:
        return F.lit(None).cast("string")
    layer = F.coalesce(_first_layer(path, layers, "glob", "^", "."),
                       _first_layer(path, layers, "file", "(?:^|/)", _NAME_CHAR))
    dirs = [p for patterns in layers.values() for p in _of_kind(patterns, "dir")]
    if dirs:
        # The greedy prefix makes the captured folder the last one any layer claims.
        innermost = F.regexp_extract(path, f"(?is)^(?:.*/)?({alternatives(dirs, _NAME_CHAR)})/", 1)
        layer = F.coalesce(layer, _first_layer(innermost, layers, "dir", "^", _NAME_CHAR))
    return F.when(~is_ignored(path, document.get("ignore") or []), layer)


def default_layer(path: Column) -> Column:
    """The layer a parser assigns by file name alone, kept when a document has no layers section."""
    name = paths.basename(path)
    return (F.when(name == "controller.py", "controller").when(name == "service.py", "service")
            .when(name == "database.py", "database"))
