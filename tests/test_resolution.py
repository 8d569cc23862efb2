"""Name resolution across files: what must resolve and what must not."""

import pytest

from codestrata.operators import resolve_python, resolve_script
from codestrata.session import cut_lineage
from codestrata.sources import python_source


def table(spark, files):
    return spark.createDataFrame(sorted(files.items()), "path string, content string")


def python_edges(spark, files):
    df = table(spark, files)
    facts = cut_lineage(python_source.facts(df))
    index = resolve_python.module_index(df.select("path"))
    calls = resolve_python.call_edges(facts, index, resolve_python.name_table(facts, index))
    imports = {tuple(r) for r in resolve_python.import_edges(facts, index).select("from", "to").collect()}
    return imports, {(r["caller_module"], r["caller_name"], r["callee_module"], r["callee_class"], r["callee_name"]) for r in calls.collect()}


def script_edges(spark, files):
    config = {p: c for p, c in files.items() if p.endswith(".json")}
    source = table(spark, {p: c for p, c in files.items() if p not in config})
    _facts, imports, calls = resolve_script.resolve(source, table(spark, config) if config else None)
    return ({tuple(r) for r in imports.select("from", "to").collect()},
            {(r["caller_module"], r["caller_name"], r["callee_module"], r["callee_name"]) for r in calls.collect()})


def test_python_forms(spark):
    files = {
        "app/__init__.py": "from .users import get_user\n",
        "app/users.py": "def get_user(x):\n    return x\nclass Users:\n    def __init__(self):\n        pass\n    @staticmethod\n    def find(x):\n        return x\n",
        "app/db/__init__.py": "",
        "app/db/store.py": "class Store:\n    def save(self): pass\n",
        "main.py": ("from app import get_user, users\nimport app.db.store\nimport app.users as u\n"
                    "def a():\n    get_user(1)\n    users.get_user(2)\n    u.Users.find(1)\n    u.Users()\n    unknown.get_user()\n"
                    "def b(other):\n    app.db.store.Store.save(other)\n    other.save()\n    local = Store()\n"),
        "svc.py": ("from app.db.store import Store\nclass Service:\n    def __init__(self, store: Store, plain):\n        self.store = store\n        self.plain = plain\n"
                   "    def run(self):\n        self.store.save()\n        self.plain.save()\n        self.run()\n"),
    }
    imports, calls = python_edges(spark, files)
    assert imports == {("app/__init__.py", "app/users.py"), ("main.py", "app/__init__.py"), ("main.py", "app/users.py"), ("main.py", "app/db/store.py"), ("svc.py", "app/db/store.py")}
    assert calls == {("main.py", "a", "app/users.py", None, "get_user"), ("main.py", "a", "app/users.py", "Users", "find"), ("main.py", "a", "app/users.py", "Users", "__init__"),
                     ("main.py", "b", "app/db/store.py", "Store", "save"), ("svc.py", "run", "app/db/store.py", "Store", "save"), ("svc.py", "run", "svc.py", "Service", "run")}


def test_python_suffixes_must_be_unique(spark):
    files = {"backend/app/core.py": "def f(): pass\n", "one/util.py": "def g(): pass\n", "two/util.py": "def g(): pass\n",
             "run.py": "from app.core import f\nfrom util import g\ndef main():\n    f()\n    g()\n", "broken.py": "def (:\n"}
    imports, calls = python_edges(spark, files)
    assert imports == {("run.py", "backend/app/core.py")}
    assert calls == {("run.py", "main", "backend/app/core.py", None, "f")}


def test_python_relative_imports_climb(spark):
    files = {"pkg/a/x.py": "from ..b.y import g\nfrom . import z\ndef f():\n    g()\n    z.h()\n", "pkg/b/y.py": "def g(): pass\n", "pkg/a/z.py": "def h(): pass\n"}
    imports, calls = python_edges(spark, files)
    assert imports == {("pkg/a/x.py", "pkg/b/y.py"), ("pkg/a/x.py", "pkg/a/z.py")}
    assert calls == {("pkg/a/x.py", "f", "pkg/b/y.py", None, "g"), ("pkg/a/x.py", "f", "pkg/a/z.py", None, "h")}


SCRIPT_CASES = {
    "destructured require": (
        {"src/db/users.js": "function findUser(id) { return id; }\nmodule.exports = { findUser };\n",
         "src/api/h.js": "const { findUser, findUser: lookup } = require('../db/users');\nfunction a(id) { return findUser(id); }\nfunction b(id) { return lookup(id); }\n"},
        {("src/api/h.js", "src/db/users.js")},
        {("src/api/h.js", "a", "src/db/users.js", "findUser"), ("src/api/h.js", "b", "src/db/users.js", "findUser")}),
    "unknown receivers": (
        {"a.js": "function f() {}\nmodule.exports = { f };\n",
         "b.js": "const a = require('./a');\nfunction g(other) { const x = {}; x.f(); other.f(); return a.missing(); }\nfunction h() { return a.f(); }\n"},
        {("b.js", "a.js")}, {("b.js", "h", "a.js", "f")}),
    "namespace and default": (
        {"src/u.ts": "export function findUser(id: string) { return id; }\n",
         "src/o.ts": "class Orders { find(id: string) { return id; } static create() { return 1; } }\nexport default new Orders();\n",
         "src/h.ts": "import * as users from './u';\nimport orders from './o';\nexport function show(id: string) { users.findUser(id); return orders.find(id); }\n"},
        {("src/h.ts", "src/u.ts"), ("src/h.ts", "src/o.ts")},
        {("src/h.ts", "show", "src/u.ts", "findUser"), ("src/h.ts", "show", "src/o.ts", "find")}),
    "barrels": (
        {"s/user.js": "const createUser = async (body) => body;\nmodule.exports = { createUser };\n", "s/index.js": "module.exports.userService = require('./user');\n",
         "c.js": "const { userService } = require('./s');\nconst create = async (req) => userService.createUser(req.body);\n",
         "lib/index.ts": "export * from './math';\nexport { default as fmt } from './fmt';\n", "lib/math.ts": "export function add(a: number) { return a; }\n",
         "lib/fmt.ts": "export default function format(x: string) { return x; }\n", "app.ts": "import { add, fmt } from './lib';\nexport function run() { add(1); fmt('x'); }\n"},
        {("c.js", "s/index.js"), ("lib/index.ts", "lib/math.ts"), ("lib/index.ts", "lib/fmt.ts"), ("app.ts", "lib/index.ts")},
        {("c.js", "create", "s/user.js", "createUser"), ("app.ts", "run", "lib/math.ts", "add"), ("app.ts", "run", "lib/fmt.ts", "format")}),
    "re-exports bind nothing locally": (
        {"math.ts": "export function add() { return 1; }\n", "index.ts": "export { add } from './math';\nexport function run() { return add(); }\n"},
        {("index.ts", "math.ts")}, set()),
    "aliases and baseUrl": (
        {"tsconfig.base.json": '{\n  // shared\n  "compilerOptions": {"baseUrl": "src", "paths": {"@/*": ["*"],},},\n}\n',
         "tsconfig.json": '{"extends": "./tsconfig.base.json", "compilerOptions": {"strict": true}}', "src/services/user.ts": "export function getUser() { return 1; }\n",
         "src/a.ts": "import { getUser } from '@/services/user';\nimport { helper } from 'services/user';\nimport express from 'express';\nexport function show() { return getUser(); }\n"},
        {("src/a.ts", "src/services/user.ts")}, {("src/a.ts", "show", "src/services/user.ts", "getUser")}),
    "both families": (
        {"legacy/db.js": "function query() {}\nmodule.exports = { query };\n", "util.ts": "export function slug(s: string) { return s; }\n",
         "app.ts": "import { query } from './legacy/db';\nimport { slug } from './util.js';\nexport function run() { query(); return slug('a'); }\n"},
        {("app.ts", "legacy/db.js"), ("app.ts", "util.ts")}, {("app.ts", "run", "legacy/db.js", "query"), ("app.ts", "run", "util.ts", "slug")}),
    "injected fields": (
        {"user.service.ts": "export class UserService { findAll() { return []; } }\nexport interface Repo { save(): void; }\n",
         "user.controller.ts": ("import { UserService, Repo } from './user.service';\nexport class C {\n  private repo: Repo;\n  constructor(private readonly users: UserService, plain: UserService) {}\n"
                                "  list() { this.repo.save(); this.plain.findAll(); return this.users.findAll(); }\n}\n"),
         "mailer.js": "class Mailer { send() {} }\nmodule.exports = { Mailer };\n",
         "notify.js": "const { Mailer } = require('./mailer');\nclass N { constructor() { this.mailer = new Mailer(); } run() { return this.mailer.send(); } }\n"},
        {("user.controller.ts", "user.service.ts"), ("notify.js", "mailer.js")},
        {("user.controller.ts", "list", "user.service.ts", "findAll"), ("notify.js", "run", "mailer.js", "send")}),
    "nested scopes keep their calls": (
        {"a.js": "function f() {}\nfunction g() { function inner() { f(); } const h = () => f(); items.map((x) => f(x)); }\nfunction k() { if (f()) { return /f(/.test('f()'); } }\n"},
        set(), {("a.js", "k", "a.js", "f")}),
}


@pytest.mark.parametrize("case", sorted(SCRIPT_CASES))
def test_script_forms(spark, case):
    files, imports, calls = SCRIPT_CASES[case]
    assert script_edges(spark, files) == (imports, calls)
