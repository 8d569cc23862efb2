"""Dependency manifests and source-level package usage as rows, with regular expressions Spark runs itself.

Input is (key columns..., path, content); output has one row per (key columns..., package)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions import paths

# Distribution names whose import name differs.
IMPORT_NAMES = {
    "pyjwt": "jwt", "python-jose": "jose", "beautifulsoup4": "bs4", "python-dotenv": "dotenv",
    "psycopg2-binary": "psycopg2", "psycopg-binary": "psycopg", "scikit-learn": "sklearn", "pyyaml": "yaml",
    "pillow": "PIL", "opencv-python": "cv2", "mysqlclient": "MySQLdb", "pymysql": "pymysql",
    "python-multipart": "multipart", "attrs": "attr", "protobuf": "google", "msgpack-python": "msgpack",
    "typing-extensions": "typing_extensions", "email-validator": "email_validator", "aioredis": "aioredis",
    "kafka-python": "kafka", "confluent-kafka": "confluent_kafka", "aio-pika": "aio_pika",
    "strawberry-graphql": "strawberry", "tortoise-orm": "tortoise", "django-rest-framework": "rest_framework",
    "djangorestframework": "rest_framework", "elasticsearch-dsl": "elasticsearch_dsl", "sentry-sdk": "sentry_sdk",
}
# What names an import in each language.
PYTHON_IMPORT = r"(?m)^\s*(?:from\s+([A-Za-z_][\w.]*)\s+import\b|import\s+([A-Za-z_][\w.]*(?:\s*,\s*[A-Za-z_][\w.]*)*))"
SCRIPT_IMPORT = r"""(?m)(?:\bfrom\s+|\brequire\s*\(\s*|\bimport\s*\(\s*|^\s*import\s+)['"]([^'"]+)['"]"""
SCRIPT_FILE = r"\.(js|jsx|ts|tsx|mjs|cjs)$"

_QUOTES = "\"' \t\r\n"
_PACKAGE_JSON = "dependencies map<string,string>, peerDependencies map<string,string>, devDependencies map<string,string>"


def normalize(name: Column) -> Column:
    return F.translate(F.lower(F.trim(name, F.lit(_QUOTES))), "_", "-")


def requirement_name(spec: Column) -> Column:
    """Package named by one requirement specifier; null for options, URLs and blanks."""
    bare = F.trim(spec, F.lit(_QUOTES))
    # fixed values: what ends a name, and what is no package
    name = normalize(F.regexp_extract(bare, r"^([^<>=!~;\[\s@(]*)", 1))
    return F.when(~bare.rlike(r"^(-|#|git\+|http)") & (bare != "") & (name != ""), name)


def _section(content: Column, header: str) -> Column:
    """Body of one TOML section (empty when absent)."""
    return F.regexp_extract(content, rf"(?ms)^\[{header}\]\s*$(.*?)(?=^\[|\z)", 1)


def _keys(section: Column) -> Column:
    return F.regexp_extract_all(section, F.lit(r'(?m)^\s*"?([A-Za-z0-9_.@/-]+)"?\s*='), F.lit(1))


# How a raw entry becomes a package name, applied after the entries are exploded into rows, where the
# expressions are compiled; inside array lambdas they would be interpreted per element.
_LINE, _SPEC, _KEY, _NPM = range(4)


def _entries(raw: Column, dev, form: int) -> Column:
    dev = dev if isinstance(dev, Column) else F.lit(dev)
    return F.transform(F.coalesce(raw, F.array().cast("array<string>")),
                       lambda r: F.struct(r.alias("raw"), dev.alias("dev"), F.lit(form).alias("form")))


def _quoted(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit("\"[^\"]+\"|'[^']+'"), F.lit(0))


def _requirements(content: Column, name: Column) -> Column:
    return _entries(F.split(content, r"\r?\n|\r"), name.rlike("dev|test|lint|doc"), _LINE)


def _package_json(content: Column) -> Column:
    doc = F.from_json(content, _PACKAGE_JSON)
    return F.concat(_entries(F.map_keys(doc["dependencies"]), False, _NPM), _entries(F.map_keys(doc["peerDependencies"]), False, _NPM),
                    _entries(F.map_keys(doc["devDependencies"]), True, _NPM))


def _pyproject(content: Column) -> Column:
    project = _section(content, "project")
    # Quote-aware: items such as "sqlalchemy[asyncio]" hold brackets themselves.
    items = F.regexp_extract(project, r"""(?m)^\s*dependencies\s*=\s*\[((?:[^\]"']|"[^"]*"|'[^']*')*)""", 1)
    poetry = F.filter(_keys(_section(content, r"tool\.poetry\.dependencies")), lambda k: F.lower(k) != "python")
    groups = F.flatten(F.transform(
        F.regexp_extract_all(content, F.lit(r"(?ms)^\[tool\.poetry\.(?:dev-dependencies|group\.[\w-]+\.dependencies)\]\s*$(.*?)(?=^\[|\z)"), F.lit(1)), _keys))
    return F.concat(_entries(_quoted(items), False, _SPEC), _entries(_quoted(_section(content, r"project\.optional-dependencies")), True, _SPEC),
                    _entries(poetry, False, _KEY), _entries(groups, True, _KEY))


def _pipfile(content: Column) -> Column:
    return F.concat(_entries(_keys(_section(content, "packages")), False, _KEY), _entries(_keys(_section(content, "dev-packages")), True, _KEY))


def manifest_packages(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, package, dev, ecosystem). A package declared both ways is not a development one."""
    name, content = paths.basename(F.col("path")), F.coalesce("content", F.lit(""))
    found = (
        F.when(name == "package.json", _package_json(content))
        .when(name.startswith("requirements"), _requirements(content, name))
        .when(name == "pyproject.toml", _pyproject(content))
        .when(name == "Pipfile", _pipfile(content))
    )
    rows = files.filter(paths.is_manifest(F.col("path"))).select(*keys, "path", F.explode(found).alias("p"))
    raw, form = F.col("p.raw"), F.col("p.form")
    package = (F.when(form == _LINE, requirement_name(F.substring_index(raw, "#", 1))).when(form == _SPEC, requirement_name(raw))
               .when(form == _KEY, normalize(raw)).otherwise(F.lower(raw)))
    named = rows.select(*keys, "path", package.alias("package"), F.col("p.dev").alias("dev")).filter("package IS NOT NULL")
    return named.groupBy(*keys, "path", "package").agg(F.min("dev").alias("dev")).withColumn(
        "ecosystem", F.when(paths.basename(F.col("path")) == "package.json", "npm").otherwise("pypi"))


def external_imports(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, package): top-level external packages each source file imports. Relative specifiers are
    dropped, an npm scope stays part of the name."""
    path, content = F.col("path"), F.col("content")
    from_module = F.regexp_extract_all(content, F.lit(PYTHON_IMPORT), F.lit(1))
    plain = F.flatten(F.transform(F.regexp_extract_all(content, F.lit(PYTHON_IMPORT), F.lit(2)), lambda m: F.split(m, ",")))
    python = F.transform(F.concat(from_module, plain), lambda m: F.substring_index(F.trim(m), ".", 1))
    specs = F.filter(F.regexp_extract_all(content, F.lit(SCRIPT_IMPORT), F.lit(1)), lambda s: ~s.rlike(r"^[./]"))
    script = F.transform(specs, lambda s: F.when(s.startswith("@"), F.substring_index(s, "/", 2)).otherwise(F.substring_index(s, "/", 1)))
    names = F.when(path.endswith(".py"), python).when(path.rlike(SCRIPT_FILE), script)
    return files.select(*keys, "path", F.explode(F.array_distinct(names)).alias("package")).filter("package <> ''")


def import_name(package: Column, ecosystem: Column) -> Column:
    """What a distribution is imported as."""
    known = F.create_map(*[F.lit(x) for pair in IMPORT_NAMES.items() for x in pair])
    lowered = F.lower(package)
    return F.when(ecosystem == "npm", package).otherwise(F.coalesce(known[lowered], F.translate(lowered, "-", "_")))


def modules_using(packages: DataFrame, usage: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path): modules importing any of the packages, under the import or the distribution name."""
    names = packages.select(*keys, F.explode(F.array_distinct(F.array(
        import_name(F.col("package"), F.col("ecosystem")), F.col("package")))).alias("package"))
    return names.join(usage.select("path", "package"), "package").select(*keys, "path").distinct()
