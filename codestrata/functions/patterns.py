"""Shell-style wildcards (``*``, ``?``, ``[seq]``, ``[!seq]``) as regular expressions for ``rlike``.

``*`` crosses ``/``; a pattern always has to match the whole value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPECIAL = set("\\.^$+{}()|")


def wildcard_body(pattern: str, any_char: str = ".") -> str:
    """The unanchored regular expression of one wildcard; ``any_char`` is what ``*`` and ``?`` range over."""
    out, rest = [], pattern
    while rest:
        head, rest = rest[0], rest[1:]
        if head == "*":
            out.append(any_char + "*")
        elif head == "?":
            out.append(any_char)
        elif head == "[":
            end = rest.find("]", 2 if rest.startswith("!") else 1)
            if end < 0:
                out.append("\\[")
                continue
            body, rest = rest[:end], rest[end + 1:]
            negate = body.startswith("!")
            body = (body[1:] if negate else body).replace("\\", "\\\\").replace("[", "\\[").replace("^", "\\^")
            body = body.replace("&&", "&\\&")
            out.append(f"[{'^' if negate else ''}{body}]")
        else:
            out.append("\\" + head if head in _SPECIAL or head == "]" else head)
    return "".join(out)


def wildcard_regex(pattern: str, ignore_case: bool = False) -> str:
    """Anchored Java regular expression equivalent to a shell wildcard."""
    return ("(?is)" if ignore_case else "(?s)") + "^" + wildcard_body(pattern) + "\\z"


def alternatives(patterns: list[str], any_char: str = ".") -> str:
    return "(?:" + "|".join(wildcard_body(p, any_char) for p in patterns) + ")"


def matches(value: Column, pattern: str, ignore_case: bool = False) -> Column:
    """``value`` matches the wildcard. Plain equality when the pattern has no wildcard in it, so that the
    comparison stays a hash-free codegen'd equality instead of a regex."""
    if not any(c in pattern for c in "*?["):
        return (F.lower(value) == pattern.lower()) if ignore_case else (value == pattern)
    return value.rlike(wildcard_regex(pattern, ignore_case))


def matches_any(value: Column, patterns: list[str], ignore_case: bool = False) -> Column:
    """One alternation for all patterns, so a long list costs one regex pass per value."""
    if not patterns:
        return F.lit(False)
    return value.rlike(("(?is)" if ignore_case else "(?s)") + "^" + alternatives(patterns) + "\\z")
