"""What one JavaScript or TypeScript file declares, imports, re-exports and calls, unresolved.

As for Python, only a short per-file scan runs in Python workers: tokens, bracket pairs, and the statements at the
top of the file. Facts have the same row type as ``python_source`` plus ``reexport`` (owner=specifier, name=imported
or '*' or null for all, detail=exported name) and ``default`` (name)."""

from __future__ import annotations

import re
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.session import spread
from codestrata.sources.python_source import FACTS, emitted

# The helpers travel with the task, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<text>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)"""
    r"""|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<mark>=>|\.\.\.|\?\.|\S)""", re.S)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\])*\]|[^/\\\n\[])+/[a-z]*")
_NO_CALL = {"if", "for", "while", "switch", "catch", "return", "typeof", "await", "function", "super", "import", "new", "in", "of", "delete", "void", "throw", "case"}
_MODIFIERS = {"public", "private", "protected", "readonly", "override", "static", "async", "get", "set", "abstract", "declare", "*"}


class _File:
    """Tokens of one file with bracket partners; positions below are token indices."""

    def __init__(self, source: str):
        self.source, self.t, self.kind, self.span, self.pair, self.first = source, [], [], [], {}, []
        at, stop, fresh, opened, match = 0, len(source), True, [], _TOKEN.match
        tokens, kinds, spans, first = self.t, self.kind, self.span, self.first
        while at < stop:
            m = None
            if source[at] == "/" and source[at:at + 2] not in ("//", "/*"):
                divides = tokens and (kinds[-1] in ("name", "number", "text") and tokens[-1] not in _NO_CALL or tokens[-1] in ")]}")
                m = None if divides else _REGEX.match(source, at)
            kind, m = ("text", m) if m else (None, match(source, at))
            kind, token, at = kind or m.lastgroup, m.group(), m.end()
            if kind == "skip":
                fresh = fresh or "\n" in token
                continue
            tokens.append(token)
            kinds.append(kind)
            spans.append(m.span())
            first.append(fresh)
            fresh = False
            if token in ("(", "[", "{"):
                opened.append(len(tokens) - 1)
            elif token in (")", "]", "}") and opened:
                self.pair[opened[-1]] = len(tokens) - 1
                self.pair[len(tokens) - 1] = opened.pop()

    def at(self, i):
        return self.t[i] if 0 <= i < len(self.t) else ""

    def skip(self, i):
        """Index after token ``i``, or after the group it opens."""
        return self.pair.get(i, i) + 1 if self.at(i) in ("(", "[", "{") else i + 1

    def text(self, i, j):
        return self.source[self.span[i][0]:self.span[j][1]]

    def starts(self, i):
        """Token ``i`` begins a statement."""
        return i == 0 or self.at(i - 1) in (";", "}") or (self.first[i] and (self.kind[i - 1] != "mark" or self.at(i - 1) in ")]"))

    def end(self, i, stop):
        """Where an expression from ``i`` ends: a comma, semicolon or new statement at its own depth."""
        start = i
        while i < stop and self.at(i) not in (",", ";", ")", "]", "}") and not (i > start and self.starts(i) and self.kind[i] != "mark" and self.at(i - 1) != "=>"):
            i = self.skip(i)
        return min(i, stop)

    def find(self, i, stop, mark):
        """Next ``mark`` before ``stop`` outside groups, or -1 (a semicolon ends the search)."""
        while i < stop and self.at(i) not in (mark, ";"):
            i = self.skip(i)
        return i if i < stop and self.at(i) == mark else -1

    def required(self, i):
        """Specifier when ``i`` starts ``require('x')``, else None."""
        ok = self.at(i) == "require" and self.at(i + 1) == "(" and i + 2 < len(self.t) and self.kind[i + 2] == "text"
        return self.t[i + 2][1:-1] if ok else None

    def typed(self, i):
        """``: Name`` at ``i`` when the whole annotation is one plain name."""
        plain = self.at(i) == ":" and i + 1 < len(self.t) and self.kind[i + 1] == "name" and self.at(i + 2) not in ("<", "[", "|", "&", ".")
        return self.t[i + 1] if plain else None

    def made(self, i):
        return self.t[i + 1] if self.at(i) == "new" and self.kind[i + 1] == "name" and self.at(i + 2) != "." else None


def _calls(f: _File, i: int, stop: int):
    """(kind, receiver, name) of the calls between two positions; nested functions and classes are not entered."""
    while i < stop:
        word, after = f.at(i), i + 1
        if word == "function" or word == "class":
            body = f.find(i + 1, stop, "{")
            i = f.skip(body) if body > 0 else i + 1
            continue
        if word == "=>":
            i = f.skip(i + 1) if f.at(i + 1) == "{" else f.end(i + 1, stop)
            continue
        if f.kind[i] == "name" and f.at(after) == "<":  # type arguments before a call
            j = after + 1
            while j < stop and (f.kind[j] == "name" or f.at(j) in (",", ".", "[", "]", "|")):
                j += 1
            after = j + 1 if f.at(j) == ">" and f.at(j + 1) == "(" else after
        if f.kind[i] == "name" and f.at(after) == "(" and word not in _NO_CALL:
            follows, dots = f.at(f.skip(after)), (".", "?.")
            if follows == "=>" or (follows == "{" and f.at(i - 1) in ("{", ",", "async", "get", "set", "*")):
                i = f.skip(after) if follows == "=>" else f.skip(f.skip(after))
                continue
            owner = f.at(i - 2)
            if f.at(i - 1) not in dots:
                if f.at(i - 1) != "new":
                    yield "plain", None, word
            elif f.at(i - 3) not in dots and owner == "this":
                yield "this", None, word
            elif f.at(i - 3) not in dots and f.kind[i - 2] == "name" and owner != "super":
                yield "attr", owner, word
            elif f.at(i - 3) in dots and f.at(i - 4) == "this" and f.at(i - 5) not in dots and f.kind[i - 2] == "name":
                yield "field", owner, word
        i += 1


def _function(f: _File, owner, name, params, body, stop):
    """A function fact and its calls; ``params`` is its parenthesis or its single bare parameter."""
    shown = f.text(params, f.pair[params]) if f.at(params) == "(" and params in f.pair else f"({f.at(params)})"
    yield "function", owner, name, name + shown, None, None
    inside = (body + 1, f.pair.get(body, stop)) if f.at(body) == "{" else (body, f.end(body, stop))
    for kind, obj, target in _calls(f, *inside):
        yield "call", owner, name, kind, obj, target


def _class(f: _File, name, body):
    yield "class", None, name, None, None, None
    i, stop = body + 1, f.pair.get(body, len(f.t))
    while i < stop:
        if f.at(i) == "@":
            i = f.skip(i + 2) if f.at(i + 2) == "(" else i + 2
            continue
        if f.at(i) in _MODIFIERS and f.at(i + 1) not in ("(", "=", ":", ";"):
            i += 1
            continue
        if f.kind[i] != "name":
            i = f.skip(i)
            continue
        member, j = f.at(i), i + 1
        if f.at(j) == "(":
            block = f.find(f.skip(j), stop, "{")
            if block > 0:
                yield from _function(f, name, member, j, block, stop)
                if member == "constructor":
                    yield from (("field", name, a, c, None, None) for a, c in _constructor_fields(f, j, block))
            i = f.skip(block) if block > 0 else f.skip(j)
            continue
        j += f.at(j) in ("?", "!")
        value = f.find(j, f.end(j, stop), "=")
        cls = f.typed(j) or (f.made(value + 1) if value > 0 else None)
        if cls:
            yield "field", name, member, cls, None, None
        i = max(f.end(j, stop), j)
        i += f.at(i) in (";", ",")


def _constructor_fields(f: _File, params, block):
    i = params + 1
    while i < f.pair.get(params, i):
        kept = f.at(i) in ("public", "private", "protected", "readonly")
        while f.at(i) in _MODIFIERS:
            i += 1
        cls = f.typed(i + 1 + (f.at(i + 1) == "?"))
        if kept and cls:
            yield f.at(i), cls
        i = f.end(i, f.pair[params]) + 1
    for k in range(block + 1, f.pair.get(block, block) - 4):
        if f.at(k) == "this" and f.starts(k) | (k == block + 1) and f.at(k + 1) == "." and f.at(k + 3) == "=" and f.made(k + 4):
            yield f.at(k + 2), f.made(k + 4)


def _names(f: _File, brace):
    """(name, alias) pairs of ``{ a, b as c, d: e }``."""
    i = brace + 1
    while i < f.pair.get(brace, i):
        i += f.at(i) == "type" and f.kind[i + 1] == "name" and f.at(i + 1) != "as"
        renamed = f.at(i + 1) in ("as", ":") and f.kind[i + 2] == "name"
        if f.kind[i] == "name" and (renamed or f.at(i + 1) in (",", "}", "=")):
            yield f.at(i), f.at(i + 2) if renamed else f.at(i)
        i = f.end(i, f.pair[brace]) + 1


def _import(f: _File, i):
    """Facts of an import statement and the position after it."""
    end = i + 1
    while end < len(f.t) and f.kind[end] != "text" and f.at(end) not in (";", "("):
        end = f.skip(end)
    if end >= len(f.t) or f.kind[end] != "text":
        return [], end
    spec, out, j = f.t[end][1:-1], [], i + 1
    while j < end:
        if f.at(j) == "{":
            out += [(spec, a, b) for a, b in _names(f, j)]
        elif f.at(j) == "*":
            out.append((spec, "*", f.at(j + 2)))
            j += 2
        elif f.kind[j] == "name" and f.at(j) not in ("from", "type"):
            out.append((spec, "default", f.at(j)))
        j = f.skip(j)
    return [("import", s, a, b, None, None) for s, a, b in out or [(spec, None, None)]], end + 1


def _declarators(f: _File, i):
    """Functions and requires of ``const a = ..., b = ...`` and the position after it."""
    facts, more = [], True
    while more:
        target, j = i, f.skip(i)
        eq = f.find(j, f.end(j, len(f.t)), "=") if f.at(j) == ":" else (j if f.at(j) == "=" else -1)
        value = eq + 1
        end = f.end(value if eq > 0 else j, len(f.t))
        spec = f.required(value) if eq > 0 else None
        if spec is not None:
            member = f.at(value + 5) if f.at(value + 4) in (".", "?.") else None
            if f.at(target) == "{":
                facts += [("import", spec, None, None, None, None)] + [("import", spec, a, b, None, None) for a, b in _names(f, target)]
            elif f.kind[target] == "name":
                facts.append(("import", spec, member or "*", f.at(target), None, None))
        elif eq > 0 and f.kind[target] == "name":
            v = value + (f.at(value) == "async")
            if f.at(v) == "function":
                p = f.find(v, len(f.t), "(")
                facts += list(_function(f, None, f.at(target), p, f.find(f.skip(p), len(f.t), "{"), len(f.t)))
                end = f.end(f.skip(f.find(f.skip(p), len(f.t), "{")), len(f.t))
            else:
                arrow = f.find(v, f.end(v, len(f.t)) + 1, "=>")
                if arrow > 0 and (f.at(v) == "(" or f.kind[v] == "name" and arrow == v + 1):
                    facts += list(_function(f, None, f.at(target), v, arrow + 1, len(f.t)))
                    end = f.skip(arrow + 1) if f.at(arrow + 1) == "{" else f.end(arrow + 1, len(f.t))
        more = f.at(end) == "," and end + 1 < len(f.t)
        i = end + 1 if more else end
    return facts, i


def _export(f: _File, i):
    """Facts of an export that names another module or a default, and where its declaration starts."""
    if f.at(i + 1) in ("*", "{"):
        j = f.skip(i + 1) if f.at(i + 1) == "{" else i + 2
        alias = f.at(j + 1) if f.at(j) == "as" else None
        j += 2 * (alias is not None)
        if f.at(j) != "from" or j + 1 >= len(f.t) or f.kind[j + 1] != "text":
            return [], j
        spec = f.t[j + 1][1:-1]
        if f.at(i + 1) == "{":
            named = [("reexport", spec, a, b, None, None) for a, b in _names(f, i + 1)]
        else:
            named = [("reexport", spec, "*" if alias else None, alias, None, None)]
        return [("import", spec, None, None, None, None), *named], j + 2
    if f.at(i + 1) != "default":
        return [], i + 1
    j = i + 2 + (f.at(i + 2) == "async") + (f.at(i + 2) == "abstract")
    named = j + 1 + (f.at(j + 1) == "*") if f.at(j) in ("function", "class") else j
    plain = f.at(j) in ("function", "class") or f.at(j + 1) in (";", "") or f.starts(j + 1)
    return [("default", None, f.at(named), None, None, None)] if plain and named < len(f.t) and f.kind[named] == "name" else [], i + 2


def _commonjs(f: _File, i):
    """``module.exports = ...``, ``module.exports.x = require(...)`` and ``exports.x = require(...)``."""
    j = i + 3 if f.text(i, min(i + 2, len(f.t) - 1)) == "module.exports" else i + 1
    name = f.at(j + 1) if f.at(j) == "." else None
    value = j + (3 if name else 1)
    if f.at(value - 1) != "=" or (j == i + 1 and not name):
        return []
    if name:
        return [("reexport", f.required(value), "*", name, None, None)] if f.required(value) else []
    if f.required(value):
        return [("reexport", f.required(value), None, None, None, None)]
    if f.at(value) == "{":
        inside = range(value + 1, f.pair.get(value, value))
        return [("reexport", f.required(k + 2), "*", f.at(k).strip("\"'"), None, None) for k in inside if f.at(k + 1) == ":" and f.required(k + 2)]
    single = value < len(f.t) and f.kind[value] == "name" and f.at(value) not in _NO_CALL and (f.at(value + 1) in (";", "") or f.starts(value + 1))
    return [("default", None, f.at(value), None, None, None)] if single else []


def _facts(source: str):
    f, i = _File(source), 0
    while i < len(f.t):
        if not f.starts(i):
            i = f.skip(i)
            continue
        if f.at(i) == "export":
            found, i = _export(f, i)
            yield from found
            if f.at(i) in (";", ""):
                continue
        i += f.at(i) in ("async", "abstract", "declare") and f.at(i + 1) in ("function", "class")
        word = f.at(i)
        if word == "import" and f.at(i + 1) not in ("(", "."):
            found, i = _import(f, i)
            yield from found
        elif word == "function" and (f.kind[i + 1] == "name" or f.at(i + 1) == "*"):
            name = i + 1 + (f.at(i + 1) == "*")
            params = f.find(name, len(f.t), "(")
            block = f.find(f.skip(params), len(f.t), "{")
            if block > 0:
                yield from _function(f, None, f.at(name), params, block, len(f.t))
            i = f.skip(block) if block > 0 else f.skip(params)
        elif word == "class" and i + 1 < len(f.t) and f.kind[i + 1] == "name":
            block = f.find(i + 1, len(f.t), "{")
            if block > 0:
                yield from _class(f, f.at(i + 1), block)
            i = f.skip(block) if block > 0 else i + 1
        elif word in ("const", "let", "var"):
            found, i = _declarators(f, i + 1)
            yield from found
        else:
            if word in ("module", "exports"):
                yield from _commonjs(f, i)
            elif f.required(i):
                yield "import", f.required(i), None, None, None, None
            i = f.skip(i)


def facts(files: DataFrame) -> DataFrame:
    """Facts of every JavaScript / TypeScript file in (path, content); declaration files carry no code."""
    kept = files.filter(F.col("path").rlike(r"\.(js|jsx|ts|tsx)$") & ~F.col("path").endswith(".d.ts"))
    return spread(kept.select("path", "content")).mapInArrow(emitted(lambda _, content: _facts(content)), FACTS)
