"""Source text derived from the tables, parsed and resolved; the twins state the edges directly.

A customer is a package (``__init__`` re-exporting from ``impl``), an order is a module using one customer's
package in one of nine import forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.operators import resolve_python, resolve_script
from codestrata.plans.registry import query
from codestrata.session import stored
from codestrata.sources import python_source

PKG = "CONCAT('app/seg', CAST({c} % 5 AS STRING), '/c', CAST({c} AS STRING), '/')"


def package_sources(t):
    """Two files per customer: the implementation and a package file re-exporting part of it."""
    impl = """class Repo{k}:
    def __init__(self, db):
        self.db = db
    def save(self, x):
        return self.check(x) or unknown.call(x)
    def check(self, x):
        return x

def load_{k}(a, b=1):
    return Repo{k}(a)
"""
    init = "from .impl import load_{k}, Repo{k} as Store\n"
    c = t.table("customer").select(F.col("c_custkey").cast("string").alias("k"), F.expr(PKG.format(c="c_custkey")).alias("dir"))
    fill = lambda text: F.replace(F.lit(text), F.lit("{k}"), F.col("k"))
    files = F.array(F.struct(F.concat("dir", F.lit("impl.py")).alias("path"), fill(impl).alias("content")),
                    F.struct(F.concat("dir", F.lit("__init__.py")).alias("path"), fill(init).alias("content")))
    return c.select(F.explode(files).alias("f")).select("f.path", "f.content")


FORMS = [
    "from app.{s}.c{c} import load_{c}\n\ndef run(x):\n    load_{c}(1)\n    def inner():\n        hidden()\n",
    "import app.{s}.c{c}.impl as m\n\ndef run():\n    m.load_{c}(2)\n    return [m.Repo{c}(i) for i in x]\n",
    "from app.{s}.c{c} import impl\n\nasync def run():\n    impl.load_{c}()\n",
    "import app.{s}.c{c}.impl\n\ndef run():\n    app.{s}.c{c}.impl.load_{c}()\n",
    "from app.{s}.c{c} import Store\n\ndef run():\n    Store.save(1)\n    Store.missing(1)\n",
    "from app.{s}.c{c} import Store\n\nclass Job:\n    def __init__(self, repo: Store):\n        self.repo = repo\n    def run(self):\n        self.repo.save(1)\n        self.other.save(1)\n",
    "from {s}.c{c}.impl import load_{c} as go\n\ndef run():\n    go()\n",
    "from impl import load_{c}\n\ndef run():\n    load_{c}()\n",
    "from app.{s}.c{c}.impl import *\n\ndef run():\n    load_{c}()\n",
]


def order_sources(t):
    """One module per order."""
    o = t.table("orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("c"), F.format_string("seg%d", F.col("o_custkey") % 5).alias("s"))
    form = F.get(F.array(*[F.lit(f) for f in FORMS]), (F.col("o_orderkey") % len(FORMS)).cast("int"))
    content = F.replace(F.replace(form, F.lit("{c}"), F.col("c")), F.lit("{s}"), F.col("s"))
    return o.select(F.format_string("jobs/o%d.py", "o_orderkey").alias("path"), content.alias("content"))


def parsed(t):
    """Facts of every derived file, written once: six joins below read them."""
    files = package_sources(t).unionByName(order_sources(t))
    facts = stored(python_source.facts(files))
    index = stored(resolve_python.module_index(files.select("path")))
    return facts, index


PY_SQL = f"""WITH c AS (SELECT c_custkey AS k, {PKG.format(c='c_custkey')} AS dir FROM customer),
 o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 9 AS f, CONCAT('jobs/o', CAST(o_orderkey AS STRING), '.py') AS path, {PKG.format(c='o_custkey')} AS dir FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer))"""


@query("python_functions", PY_SQL + """ SELECT dir || 'impl.py' AS module_path, NULL AS class_name, 'load_' || k AS name, 'load_' || k || '(a, b=1)' AS signature FROM c
 UNION ALL SELECT dir || 'impl.py', 'Repo' || k, n, n || p FROM c, (VALUES ('__init__', '(self, db)'), ('save', '(self, x)'), ('check', '(self, x)')) v(n, p)
 UNION ALL SELECT path, CASE WHEN f = 5 THEN 'Job' END, 'run', CASE f WHEN 0 THEN 'run(x)' WHEN 5 THEN 'run(self)' ELSE 'run()' END FROM (SELECT o_orderkey % 9 AS f, CONCAT('jobs/o', CAST(o_orderkey AS STRING), '.py') AS path FROM orders)
 UNION ALL SELECT CONCAT('jobs/o', CAST(o_orderkey AS STRING), '.py'), 'Job', '__init__', '__init__(self, repo: Store)' FROM orders WHERE o_orderkey % 9 = 5""")
def python_functions(t):
    """Functions and methods with signatures, from source text."""
    facts = python_source.facts(package_sources(t).unionByName(order_sources(t)))
    return facts.filter("fact = 'function'").select(F.col("path").alias("module_path"), F.col("owner").alias("class_name"), "name", F.col("detail").alias("signature"))


@query("python_imports", PY_SQL + """ SELECT dir || '__init__.py' AS "from", dir || 'impl.py' AS "to" FROM c
 UNION ALL SELECT path, dir || '__init__.py' FROM o WHERE f IN (0, 2, 4, 5) UNION ALL SELECT path, dir || 'impl.py' FROM o WHERE f IN (1, 2, 3, 6, 8)""")
def python_imports(t):
    """Import edges: packages, submodules, aliases by unique suffix, wildcards."""
    return resolve_python.import_edges(*parsed(t))


@query("python_calls", PY_SQL + """ SELECT dir || 'impl.py' AS caller_module, 'Repo' || k AS caller_class, 'save' AS caller_name, dir || 'impl.py' AS callee_module, 'Repo' || k AS callee_class, 'check' AS callee_name FROM c
 UNION ALL SELECT dir || 'impl.py', NULL, 'load_' || k, dir || 'impl.py', 'Repo' || k, '__init__' FROM c
 UNION ALL SELECT path, NULL, 'run', dir || 'impl.py', NULL, 'load_' || c FROM o WHERE f IN (0, 1, 2, 3, 6)
 UNION ALL SELECT path, NULL, 'run', dir || 'impl.py', 'Repo' || c, '__init__' FROM o WHERE f = 1
 UNION ALL SELECT path, NULL, 'run', dir || 'impl.py', 'Repo' || c, 'save' FROM o WHERE f = 4
 UNION ALL SELECT path, 'Job', 'run', dir || 'impl.py', 'Repo' || c, 'save' FROM o WHERE f = 5""")
def python_calls(t):
    """Resolved calls: re-exports, module attributes, dotted receivers, class methods, injected fields."""
    facts, index = parsed(t)
    return resolve_python.call_edges(facts, index, resolve_python.name_table(facts, index))


# --- JavaScript / TypeScript: a customer is a folder with a service and a barrel, an order a module using it ----

WEB = "CONCAT('web', CAST({c} % 5 AS STRING), '/src/c', CAST({c} AS STRING), '/')"
SCRIPT_FORMS = [
    "import {{ load{c} }} from '@/c{c}/svc';\nexport function run(x: string) {{ load{c}('a'); const f = () => hidden(); return [x]; }}\n",
    "const {{ go }} = require('../src/c{c}');\nfunction run() {{ return go(1); }}\nmodule.exports = {{ run }};\n",
    "import * as m from '../src/c{c}/index.js';\nexport const run = async (x) => m.load{c}(2);\n",
    "import {{ Repo{c} }} from '../src/c{c}';\nexport class Job {{\n  constructor(private readonly repo: Repo{c}, plain: Repo{c}) {{}}\n  run() {{ this.repo.save(1); this.plain.save(1); }}\n}}\n",
    "import Repo from '@/c{c}/svc.js';\nexport function run() {{ return Repo.save(1); }}\n",
    "import express from 'express';\nexport function run() {{ express.get(); }}\n",
    "import {{ Repo{c} as R }} from '@/c{c}';\nexport function run() {{ R.make(); const y = {{}}; y.save(); }}\n",
    "import './../src/c{c}/svc';\n",
]


def script_sources(t):
    svc = ("export function load{k}(a: string) {{ return helper(a); }} // load(x)\nfunction helper(a) {{ return /[(]/.test(a); }}\n"
           "export class Repo{k} {{\n  save(x) {{ return this.check(x); }}\n  check(x) {{ return `${{x}}`; }}\n  static make() {{ return 1; }}\n}}\n")
    barrel = "export * from './svc';\nexport {{ load{k} as go }} from './svc';\n"
    plain = lambda text: text.replace("{{", "{").replace("}}", "}")
    c = t.table("customer").select(F.col("c_custkey").cast("string").alias("k"), F.expr(WEB.format(c="c_custkey")).alias("dir"))
    fill = lambda text, mark: F.replace(F.lit(plain(text)), F.lit(mark), F.col(mark.strip("{}")))
    own = c.select(F.explode(F.array(F.struct(F.concat("dir", F.lit("svc.ts")).alias("path"), fill(svc, "{k}").alias("content")),
                                     F.struct(F.concat("dir", F.lit("index.js")).alias("path"), fill(barrel, "{k}").alias("content")))).alias("f")).select("f.*")
    o = t.table("orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("c"), (F.col("o_orderkey") % 8).cast("int").alias("form"))
    content = F.replace(F.get(F.array(*[F.lit(plain(f)) for f in SCRIPT_FORMS]), F.col("form")), F.lit("{c}"), F.col("c"))
    path = F.expr("CONCAT('web', CAST(CAST(c AS BIGINT) % 5 AS STRING), '/jobs/o', CAST(o_orderkey AS STRING), CASE WHEN form = 1 THEN '.js' ELSE '.ts' END)")
    return own.unionByName(o.select(path.alias("path"), content.alias("content")))


def script_configs(t):
    """One configuration chain per region: tsconfig.json extends base.json, which declares the alias."""
    r = t.table("region").select(F.format_string("web%d/", "r_regionkey").alias("dir"))
    pairs = F.array(F.struct(F.concat("dir", F.lit("tsconfig.json")).alias("path"), F.lit('{ // strict\n "extends": "./base", "compilerOptions": {"strict": true,},}').alias("content")),
                    F.struct(F.concat("dir", F.lit("base.json")).alias("path"), F.lit('{"compilerOptions": {"paths": {"@/*": ["src/*"],}} /* end */}').alias("content")))
    return r.select(F.explode(pairs).alias("f")).select("f.*")


JS_SQL = f"""WITH c AS (SELECT c_custkey AS k, {WEB.format(c='c_custkey')} AS dir FROM customer),
 o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 8 AS f, CONCAT('web', CAST(o_custkey % 5 AS STRING), '/jobs/o', CAST(o_orderkey AS STRING), CASE WHEN o_orderkey % 8 = 1 THEN '.js' ELSE '.ts' END) AS path,
  {WEB.format(c='o_custkey')} AS dir FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer))"""


@query("script_configs", """SELECT 'web' || r_regionkey AS dir, '@/*' AS pattern, 'src/*' AS target, 'web' || r_regionkey AS paths_base FROM region""")
def script_config_table(t):
    """Path aliases in effect per folder, inherited ones included."""
    configs = resolve_script.path_configs(script_configs(t))
    return configs.select("dir", F.explode("patterns").alias("e"), "paths_base").select("dir", F.col("e.key").alias("pattern"), F.array_join("e.value", ",").alias("target"), "paths_base")


@query("script_imports", JS_SQL + """ SELECT dir || 'index.js' AS "from", dir || 'svc.ts' AS "to" FROM c
 UNION ALL SELECT path, dir || 'svc.ts' FROM o WHERE f IN (0, 4, 7) UNION ALL SELECT path, dir || 'index.js' FROM o WHERE f IN (1, 2, 3, 6)""")
def script_imports(t):
    """Import edges of JavaScript and TypeScript: relative, aliased, index files, .js naming .ts."""
    return resolve_script.resolve_imports(script_sources(t), script_configs(t))


@query("script_calls", JS_SQL + """ SELECT dir || 'svc.ts' AS caller_module, NULL AS caller_class, 'load' || k AS caller_name, dir || 'svc.ts' AS callee_module, NULL AS callee_class, 'helper' AS callee_name FROM c
 UNION ALL SELECT dir || 'svc.ts', 'Repo' || k, 'save', dir || 'svc.ts', 'Repo' || k, 'check' FROM c
 UNION ALL SELECT path, NULL, 'run', dir || 'svc.ts', NULL, 'load' || c FROM o WHERE f IN (0, 1, 2)
 UNION ALL SELECT path, 'Job', 'run', dir || 'svc.ts', 'Repo' || c, 'save' FROM o WHERE f = 3
 UNION ALL SELECT path, NULL, 'run', dir || 'svc.ts', 'Repo' || c, 'save' FROM o WHERE f = 4
 UNION ALL SELECT path, NULL, 'run', dir || 'svc.ts', 'Repo' || c, 'make' FROM o WHERE f = 6""")
def script_calls(t):
    """Resolved calls through barrels, aliases, namespaces, injected fields and static methods."""
    return resolve_script.resolve(script_sources(t), script_configs(t))[2]
