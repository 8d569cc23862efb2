"""What one Python file declares, imports and calls, unresolved.

The only per-file Python is a short walk over the standard ``ast``; it emits flat facts, and everything that
needs a second file (names, aliases, re-exports, call targets) is a join in ``operators.resolve_python``."""

from __future__ import annotations

import ast
import re
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.session import spread

# The helpers travel with the task, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# One wide row type for all facts:
#   class     (name=class)
#   function  (owner=class or null, name, detail=signature)
#   import    (owner=module stem, name=imported name or null, detail=local alias or null)
#   call      (owner=caller class, name=caller, detail=call kind, obj=receiver, target=called name)
#   field     (owner=class, name=attribute, detail=class of the attribute)
FILES_AT_ONCE = 256  # files whose facts a worker holds
FACTS = "path string, fact string, ord int, owner string, name string, detail string, obj string, target string"
_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)


def _dotted(node):
    """``a.b.c`` as text when the expression is only names and attributes."""
    if isinstance(node, ast.Name):
        return node.id
    head = _dotted(node.value) if isinstance(node, ast.Attribute) else None
    return f"{head}.{node.attr}" if head else None


def _calls(nodes):
    """(kind, receiver, name) of the calls below ``nodes``; nested definitions only lend their decorators."""
    todo = list(nodes)
    while todo:
        node = todo.pop()
        if isinstance(node, (*_FUNCTION, ast.ClassDef)):
            todo.extend(node.decorator_list)
            continue
        todo.extend(ast.iter_child_nodes(node))
        called = node.func if isinstance(node, ast.Call) else None
        if isinstance(called, ast.Name):
            yield "plain", None, called.id
        elif isinstance(called, ast.Attribute):
            receiver = _dotted(called.value)
            if receiver == "self":
                yield "self", None, called.attr
            elif receiver and receiver.startswith("self.") and receiver.count(".") == 1:
                yield "field", receiver[5:], called.attr
            elif receiver:
                yield "attr", receiver, called.attr


def _name_of(node):
    return node.id if isinstance(node, ast.Name) else None


def _fields(init):
    """attribute -> class, where the constructor says so."""
    args = init.args.posonlyargs + init.args.args + init.args.kwonlyargs
    typed = {a.arg: _name_of(a.annotation) for a in args if _name_of(a.annotation)}
    for stmt in init.body:
        if not isinstance(stmt, (ast.Assign, ast.AnnAssign)):
            continue
        target = stmt.target if isinstance(stmt, ast.AnnAssign) else stmt.targets[0]
        if not (isinstance(target, ast.Attribute) and _name_of(target.value) == "self"):
            continue
        declared = _name_of(stmt.annotation) if isinstance(stmt, ast.AnnAssign) else None
        given = stmt.value
        made = _name_of(given.func) if isinstance(given, ast.Call) else typed.get(_name_of(given))
        if declared or made:
            yield target.attr, declared or made


def _signature(source_lines, node):
    """``name(parameters)`` as written, whitespace collapsed."""
    text = "\n".join(source_lines[node.lineno - 1:(node.body[0].lineno if node.body else node.lineno) + 1])
    start = re.search(rf"\bdef\s+{node.name}\s*(?=\()", text)
    depth, end = 0, start.end() if start else 0
    for end in range(end, len(text)):
        depth += (text[end] == "(") - (text[end] == ")")
        if depth == 0:
            break
    return node.name + text[start.end():end + 1] if start else f"{node.name}({ast.unparse(node.args)})"


def _stem(node, path):
    """Absolute module name of a ``from`` import; leading dots climb from the file's own package."""
    if not node.level:
        return node.module
    package = re.sub(r"\.py$", "", path).replace("/", ".").rpartition(".")[0]
    base = package.rsplit(".", node.level - 1)[0]
    return (f"{base}.{node.module}" if base else node.module) if node.module else (base or None)


def _facts(path: str, source: str):
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return
    lines = source.splitlines()

    def function(node, owner):
        yield "function", owner, node.name, _signature(lines, node), None, None
        for kind, obj, target in _calls(node.body):
            yield "call", owner, node.name, kind, obj, target

    for node in tree.body:
        if isinstance(node, _FUNCTION):
            yield from function(node, None)
        elif isinstance(node, ast.ClassDef):
            yield "class", None, node.name, None, None, None
            for member in (m for m in node.body if isinstance(m, _FUNCTION)):
                yield from function(member, node.name)
                if member.name == "__init__":
                    for attr, cls in _fields(member):
                        yield "field", node.name, attr, cls, None, None
        elif isinstance(node, ast.Import):
            for item in node.names:
                yield "import", item.name, None, item.asname or item.name, None, None
        elif isinstance(node, ast.ImportFrom) and _stem(node, path):
            for item in node.names:
                star = item.name == "*"
                yield "import", _stem(node, path), None if star else item.name, None if star else item.asname or item.name, None, None


def emitted(parse):
    """Arrow batches of (path, content) -> facts, for ``parse(path, content)``; a few files' facts are held at a time."""

    def batches(parts):
        import pyarrow as pa

        names = [field.split()[0] for field in FACTS.split(", ")]
        types = [pa.int32() if name == "ord" else pa.string() for name in names]
        for part in parts:
            for start in range(0, part.num_rows, FILES_AT_ONCE):
                some = part.slice(start, FILES_AT_ONCE)
                rows = [(path, fact[0], i, *fact[1:]) for path, content in zip(some.column(0).to_pylist(), some.column(1).to_pylist())
                        for i, fact in enumerate(parse(path, content or ""))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return batches


def facts(files: DataFrame) -> DataFrame:
    """Facts of every Python file in (path, content). Each file is one row; Arrow batches stream through."""
    return spread(files.filter(F.col("path").endswith(".py")).select("path", "content")).mapInArrow(emitted(_facts), FACTS)
