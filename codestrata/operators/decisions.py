"""Decision points: commits where an architectural choice became visible.

Detectors of manifests, infrastructure, folders and renames, and the ranking; ``detection`` pins them and unites them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions import paths, text
from codestrata.functions.patterns import matches, matches_any
from codestrata.session import dealt, stored

MAX_DECISIONS = 8
MAX_PER_KIND = 3
STRUCTURE_MIN_MODULES = 3
RESTRUCTURE_MIN_RENAMES = 5
UNCURATED_CAP = 1.2
LISTED_PACKAGES = 12  # length of the ``packages`` field, no other limit

# Weight of each kind in the ranking.
KIND_WEIGHT = {
    "dependency_replace": 1.0, "dependency_change": 0.8, "initial_stack": 0.7, "structure": 0.7,
    "restructure": 0.6, "infrastructure": 0.55, "violation_introduced": 0.5, "violation_resolved": 0.45,
}
# Curated packages by category.
CATEGORIES = {
    "web framework": ["flask", "django", "fastapi", "starlette", "tornado", "sanic", "bottle", "pyramid", "falcon",
                      "litestar", "express", "koa", "fastify", "@hapi/hapi", "hapi", "@nestjs/core", "next", "nuxt",
                      "@remix-run/node", "hono"],
    "frontend framework": ["react", "vue", "@angular/core", "svelte", "solid-js", "preact", "jquery"],
    "ORM / data access": ["sqlalchemy", "sqlmodel", "peewee", "tortoise-orm", "pony", "django-orm", "mongoengine",
                          "beanie", "odmantic", "mongoose", "sequelize", "typeorm", "prisma", "@prisma/client",
                          "knex", "objection", "@mikro-orm/core", "drizzle-orm"],
    "database driver": ["psycopg2", "psycopg2-binary", "psycopg", "asyncpg", "pymysql", "mysqlclient",
                        "pymongo", "motor", "sqlite3", "pg", "mysql", "mysql2", "mongodb", "better-sqlite3",
                        "cassandra-driver", "neo4j", "elasticsearch"],
    "cache": ["redis", "aioredis", "ioredis", "pymemcache", "memcached", "node-cache"],
    "message queue / jobs": ["celery", "rq", "dramatiq", "kafka-python", "confluent-kafka", "aiokafka", "pika",
                             "aio-pika", "kombu", "bull", "bullmq", "amqplib", "kafkajs", "agenda"],
    "migrations": ["alembic", "yoyo-migrations", "flyway", "umzug", "db-migrate"],
    "validation / schemas": ["pydantic", "marshmallow", "cerberus", "attrs", "joi", "yup", "zod", "class-validator",
                             "ajv"],
    "auth / security": ["pyjwt", "python-jose", "passlib", "authlib", "bcrypt", "argon2-cffi", "jsonwebtoken",
                        "passport", "bcryptjs", "next-auth", "helmet"],
    "HTTP client": ["requests", "httpx", "aiohttp", "urllib3", "axios", "node-fetch", "got", "superagent"],
    "testing": ["pytest", "nose", "hypothesis", "jest", "mocha", "vitest", "jasmine", "chai", "cypress",
                "playwright", "@playwright/test", "supertest"],
    "build tooling": ["webpack", "vite", "rollup", "parcel", "esbuild", "babel", "@babel/core", "typescript",
                      "ts-node", "setuptools", "poetry", "hatchling"],
    "API style": ["graphene", "strawberry-graphql", "ariadne", "graphql", "apollo-server", "@apollo/server",
                  "grpcio", "@grpc/grpc-js", "djangorestframework", "socket.io", "ws", "channels"],
    "server / runtime": ["gunicorn", "uvicorn", "hypercorn", "waitress", "pm2", "nodemon"],
    "observability": ["sentry-sdk", "@sentry/node", "prometheus-client", "opentelemetry-api", "winston", "pino",
                      "structlog", "loguru"],
    "cloud SDK": ["boto3", "aws-sdk", "@aws-sdk/client-s3", "google-cloud-storage", "azure-storage-blob"],
    "configuration": ["python-dotenv", "dotenv", "pydantic-settings", "dynaconf", "python-decouple", "config",
                      "convict", "envalid"],
}
# Packages that say little about the architecture.
LOW_SIGNAL = (
    r"^(@types/|eslint|prettier|flake8|black$|pylint|mypy$|isort$|ruff$|pre-commit$|stylelint|husky$|lint-staged$|types-)"
)
# File patterns that introduce infrastructure.
INFRA_PATTERNS = {
    "Dockerfile": "Docker containerization", "docker-compose*.yml": "Docker Compose services",
    "docker-compose*.yaml": "Docker Compose services", ".github/workflows/*": "GitHub Actions CI",
    ".gitlab-ci.yml": "GitLab CI", "Jenkinsfile": "Jenkins CI", ".travis.yml": "Travis CI",
    ".circleci/config.yml": "CircleCI", "alembic.ini": "Alembic database migrations",
    "*/migrations/*.py": "database migrations", "tsconfig.json": "TypeScript",
    "webpack.config.*": "webpack bundling", "vite.config.*": "Vite bundling", "k8s/*": "Kubernetes deployment",
    "kubernetes/*": "Kubernetes deployment", "helm/*": "Helm charts", "serverless.yml": "Serverless deployment",
    "terraform/*": "Terraform infrastructure", "*.tf": "Terraform infrastructure",
}
# Folders of build output or documents.
NON_ARCHITECTURAL = ("dist", "build", "out", "coverage", "docs", "doc", "site", "public", "static", "assets", "vendor",
                     "examples", "example", "node_modules", "__pycache__")
NESTED_ROOTS = ("src", "lib", "app", "packages")

COLUMNS = ["sha", "kind", "subject", "significance", "n_files", "packages"]


# --- packages -----------------------------------------------------------------------------------------------


def category(package: Column) -> Column:
    chain = None
    for name, members in CATEGORIES.items():
        hit = package.isin(*members)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain


def package_weight(package: Column, dev: Column, known: Column | None = None) -> Column:
    """1.5 curated or 0.6 other, times 0.4 for development-only, times 0.2 for low-signal packages. ``known`` is the category, if it
    stands in a column."""
    known = category(package) if known is None else known
    return (F.when(known.isNotNull(), 1.5).otherwise(0.6) * F.when(dev, 0.4).otherwise(1.0)
            * F.when(package.rlike(LOW_SIGNAL), 0.2).otherwise(1.0))


def describe(package: Column, known: Column | None = None) -> Column:
    return F.coalesce(F.concat(package, F.lit(" ("), category(package) if known is None else known, F.lit(")")), package)


def version_changes(versions: DataFrame) -> DataFrame:
    """(sha, manifest, package, side, dev, ecosystem, initial) for packages added to or removed from a manifest by a commit.

    ``versions`` is (sha, manifest, package, dev, ecosystem, after): the packages of a manifest as the commit leaves it, and
    those it had before. ``initial`` marks manifests that had no packages before. Rows are dealt by commit once; what
    follows here and in ``dependency_decisions`` is grouped where they are."""
    keys = ["sha", "manifest", "package"]
    both = versions.repartition("sha").groupBy(*keys).agg(
        F.max("after").alias("_a"), (~F.min("after")).alias("_b"), F.max("dev").alias("dev"), F.max("ecosystem").alias("ecosystem"))
    had = F.max("_b").over(Window.partitionBy("sha", "manifest"))
    return both.withColumn("initial", ~had).filter(F.col("_a") != F.col("_b")).select(
        *keys, F.when(F.col("_a"), "added").otherwise("removed").alias("side"), "dev", "ecosystem", "initial")


def manifest_changes(after: DataFrame, before: DataFrame) -> DataFrame:
    """``version_changes`` of the packages after and before commits. ``before`` is keyed by the commit whose parent version it
    is."""
    columns = ["sha", "manifest", "package", "dev", "ecosystem"]
    return version_changes(after.select(*columns, F.lit(True).alias("after")).unionByName(before.select(*columns, F.lit(False).alias("after"))))


def _curated_first(prefix: list) -> list:
    return prefix + [F.col("category").isNull(), F.col("low"), F.col("package")]


def dependency_decisions(changes: DataFrame, sides: bool = False) -> DataFrame:
    """One decision per commit and kind from manifest changes; with ``sides`` also the changed packages, arrays ``added`` and ``removed``.

    A manifest's changed packages are one array a side, curated ones first, beside their sums and counts; they are sorted
    there, not as rows."""
    known = F.col("category")
    facts = changes.withColumn("category", category(F.col("package"))).withColumn("low", F.col("package").rlike(LOW_SIGNAL)) \
        .withColumn("weight", package_weight(F.col("package"), F.col("dev"), known)).withColumn("notable", known.isNotNull() & ~F.col("dev"))
    manifest = ["sha", "manifest"]
    item = F.struct(known.isNull().alias("other"), "low", "package", describe(F.col("package"), known).alias("shown"), "weight", "notable")

    def total(side, keep):
        return F.sum(F.when((F.col("side") == side) & keep, F.col("weight")).otherwise(0.0))

    lists = [F.sort_array(F.collect_list(F.when(F.col("side") == s, item))).alias(s) for s in ("added", "removed")]
    sums = facts.groupBy(*manifest).agg(
        F.max("initial").alias("initial"), F.count_if(F.col("side") == "added").alias("n_added"),
        F.count_if(F.col("side") == "removed").alias("n_removed"),
        (total("added", known.isNotNull()) + F.least(total("added", known.isNull()), F.lit(UNCURATED_CAP))).alias("w_added"),
        (total("removed", known.isNotNull()) + F.least(total("removed", known.isNull()), F.lit(UNCURATED_CAP))).alias("w_removed"),
        F.collect_set(F.when(F.col("side") == "added", known)).alias("c_added"),
        F.collect_set(F.when(F.col("side") == "removed", known)).alias("c_removed"), *lists)
    rows = sums.filter(~F.col("initial") | (F.col("n_added") > 0))

    def shown(column, limit):
        first = column if limit is None else F.slice(column, 1, limit)
        return F.array_join(F.transform(first, lambda x: x["shown"]), ", ")

    # for a first manifest the notable packages lead; without any, the first five stand in
    notable = F.filter("added", lambda x: x["notable"])
    stack = F.when(F.size(notable) > 0, notable).otherwise(F.slice("added", 1, 5))
    rows = rows.withColumn("stack", stack)
    stack6 = F.slice("stack", 1, 6)
    replace = (F.col("n_added") > 0) & (F.col("n_removed") > 0) & (
        F.arrays_overlap("c_added", "c_removed") | ((F.col("n_added") == 1) & (F.col("n_removed") == 1)))
    more = F.when(F.col("n_added") > 4, F.format_string(" (and %d more)", F.col("n_added") - 4)).otherwise("")
    dropped = F.when(F.col("n_removed") > 0, F.concat(F.lit("; drop "), shown("removed", 3))).otherwise("")
    names = lambda c: F.transform(c, lambda x: x["package"])
    return rows.select(
        *manifest, *([names(side).alias(side) for side in ("added", "removed")] if sides else []),
        F.when(F.col("initial"), "initial_stack").when(replace, "dependency_replace").otherwise("dependency_change").alias("kind"),
        F.when(F.col("initial"), F.concat(F.lit("Initial technology stack: "), F.array_join(F.transform(stack6, lambda x: x["shown"]), ", ")))
        .when(replace, F.concat(F.lit("Replace "), shown("removed", None), F.lit(" with "), shown("added", None)))
        .when(F.col("n_added") > 0, F.concat(F.lit("Adopt "), shown("added", 4), more, dropped))
        .otherwise(F.concat(F.lit("Drop "), shown("removed", 4))).alias("subject"),
        F.round(F.when(F.col("initial"), F.aggregate(stack6, F.lit(0.0), lambda acc, x: acc + x["weight"]) / 2.0)
                .otherwise(F.col("w_added") + 0.8 * F.col("w_removed")), 3).alias("significance"),
        F.slice(F.when(F.col("initial"), names("stack")).otherwise(F.concat(names("added"), names("removed"))), 1, LISTED_PACKAGES).alias("packages"),
        "n_added", "n_removed")


def merge_same_commit(found: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """One row per (sha, kind) when a commit changes several manifests: significances add up, and the subject
    is rebuilt from the united packages. Only names that can be shown are listed; the rest is counted.

    ``found`` is what ``dependency_decisions`` gives; without its sides they are taken from ``changes``. It is written once,
    and its packages are dealt by group once and ranked where they are."""
    if "added" not in found.columns:
        sides = [F.collect_set(F.when(F.col("side") == s, F.col("package"))).alias(s) for s in ("added", "removed")]
        found = found.join(changes.groupBy("sha", "manifest").agg(*sides), ["sha", "manifest"], "left")
    found = stored(found.select("sha", "kind", "manifest", "subject", "significance", "added", "removed", "packages"))
    kept = found.groupBy("sha", "kind").agg(
        F.round(F.sum("significance"), 3).alias("significance"), F.count(F.lit(1)).alias("n_manifests"),
        F.min("subject").alias("_own"), F.array_join(F.sort_array(F.collect_set("manifest")), ", ").alias("manifest"))
    # (sha, kind, side, package) over all manifests of the group; 'packages' carries the named ones
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("names")) for s in ("added", "removed", "packages")])
    each = dealt(found.select("sha", "kind", "added", "removed", "packages"), "sha", "kind").select("sha", "kind", F.explode(sides).alias("_s"))
    united = each.select("sha", "kind", "_s.side", F.explode("_s.names").alias("package")).distinct()
    facts = united.withColumn("category", category(F.col("package"))).withColumn("low", F.col("package").rlike(LOW_SIGNAL))
    side = Window.partitionBy("sha", "kind", "side")
    ranked = facts.withColumn("n", F.row_number().over(side.orderBy(*_curated_first([])))).withColumn("_all", F.count(F.lit(1)).over(side))
    item = F.struct("n", "package", describe(F.col("package"), F.col("category")).alias("shown"))
    lists = ranked.filter(F.col("n") <= LISTED_PACKAGES).groupBy("sha", "kind").agg(
        F.max(F.when(F.col("side") == "added", F.col("_all"))).alias("_n_added"),
        *[F.sort_array(F.collect_list(F.when(F.col("side") == s, item))).alias(s) for s in ("added", "removed", "packages")])

    def shown(column, limit):
        return F.array_join(F.transform(F.slice(column, 1, limit), lambda x: x["shown"]), ", ")

    more = F.when(F.col("_n_added") > 4, F.format_string(" (and %d more)", F.col("_n_added") - 4)).otherwise("")
    subject = (
        F.when(F.col("kind") == "initial_stack", F.concat(F.lit("Initial technology stack: "), shown("packages", 6)))
        .when(F.col("kind") == "dependency_replace", F.concat(F.lit("Replace "), shown("removed", 3), F.lit(" with "), shown("added", 3)))
        .when(F.col("_n_added") > 0, F.concat(F.lit("Adopt "), shown("added", 4), more))
        .otherwise(F.concat(F.lit("Drop "), shown("removed", 4))))
    return kept.join(lists, ["sha", "kind"], "left").select(
        "sha", "kind", F.when(F.col("n_manifests") > 1, subject).otherwise(F.col("_own")).alias("subject"), "significance",
        "manifest", "n_manifests", F.when(F.col("n_manifests") > 1, F.transform("packages", lambda x: x["package"])).alias("packages"))


# --- other detectors ----------------------------------------------------------------------------------------


def infrastructure(touched: DataFrame, order: list[str]) -> DataFrame:
    """(label, sha): the first commit that brings in each kind of infrastructure. Labels are found row by row;
    the first one is a min_by, combined map-side."""
    path, name = F.col("path"), paths.basename(F.col("path"))
    found = F.array(*[F.when(matches(path, p) | matches(name, p), F.struct(F.lit(i).alias("ord"), F.lit(label).alias("label")))
                      for i, (p, label) in enumerate(INFRA_PATTERNS.items())])
    labelled = touched.select("hash", *[c for c in order if c != "hash"], F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f"))
    return labelled.groupBy(F.col("f.label").alias("label")).agg(F.min_by("hash", F.struct(*order, "f.ord")).alias("sha"))


def top_folder(path: Column) -> Column:
    """The folder a module group is counted under; null for top-level files and folders that hold no code."""
    parts = paths.parts(path)
    first = F.get(parts, F.lit(0))
    nested = first.isin(*NESTED_ROOTS) & (F.size(parts) >= 3)
    return F.when((F.size(parts) >= 2) & ~F.lower(first).isin(*NON_ARCHITECTURAL), F.when(
        nested, F.array_join(F.slice(parts, 1, 2), "/")).otherwise(first))


def folder_changes(presence: DataFrame, last_idx: DataFrame, minimum: int = STRUCTURE_MIN_MODULES) -> DataFrame:
    """(folder, idx, change, n): folders that appear from nothing or vanish with at least ``minimum`` modules.
    ``presence`` is distinct (folder, path, idx). Counts of idx and idx - 1 meet by shifting one of them."""
    return count_changes(presence.groupBy("folder", "idx").agg(F.count(F.lit(1)).alias("n")), last_idx, minimum)


def count_changes(counts: DataFrame, last_idx: DataFrame, minimum: int = STRUCTURE_MIN_MODULES) -> DataFrame:
    """``folder_changes`` from (folder, idx, n), n above 0."""
    sides = counts.select("folder", "idx", F.col("n").alias("after"), F.lit(0).alias("before")).unionByName(
        counts.select("folder", (F.col("idx") + 1).alias("idx"), F.lit(0).alias("after"), F.col("n").alias("before")))
    both = sides.groupBy("folder", "idx").agg(F.max("after").alias("after"), F.max("before").alias("before"))
    return both.join(F.broadcast(last_idx)).filter((F.col("idx") > 0) & (F.col("idx") <= F.col("last"))).select(
        "folder", "idx",
        F.when((F.col("before") == 0) & (F.col("after") >= minimum), "appeared")
        .when((F.col("after") == 0) & (F.col("before") >= minimum), "vanished").alias("change"),
        F.greatest("after", "before").cast("bigint").alias("n")).filter("change IS NOT NULL")


def commit_counts(touched: DataFrame) -> DataFrame:
    """(hash, renames, n_files) of every commit."""
    return touched.groupBy("hash").agg(F.count_if(F.col("old_path").isNotNull()).alias("renames"), F.count_distinct("path").alias("n_files"))


def restructures(touched: DataFrame, minimum: int = RESTRUCTURE_MIN_RENAMES, counts: DataFrame | None = None) -> DataFrame:
    """Commits that move many files. ``counts`` is what ``commit_counts`` gives, if it is known."""
    counts = commit_counts(touched) if counts is None else counts
    return counts.filter(F.col("renames") >= minimum).select(
        F.col("hash").alias("sha"), F.lit("restructure").alias("kind"),
        F.format_string("Restructure: %d files moved or renamed", "renames").alias("subject"),
        F.round(0.5 + 0.05 * F.least("renames", F.lit(20)), 3).alias("significance"), "n_files",
        F.array().cast("array<string>").alias("packages"))


def pickaxe(versions: DataFrame, needles: DataFrame) -> DataFrame:
    """(path, needle, hash): versions in which the number of occurrences of a needle differs from the parent
    version. ``versions`` is (hash, parent, path, content); counts are joined by parent, never by scanning a
    path's whole history in one window."""
    counted = versions.join(needles, "path").select("hash", "parent", "path", "needle", (
        (F.length("content") - F.length(F.replace("content", "needle"))) / F.length("needle")).alias("n"))
    before = counted.select(F.col("hash").alias("parent"), "path", "needle", F.col("n").alias("_before"))
    return counted.join(before, ["parent", "path", "needle"], "left").filter(
        F.col("n") != F.coalesce("_before", F.lit(0.0))).select("path", "needle", "hash")


# --- ranking ------------------------------------------------------------------------------------------------


def decision_id(sha: Column, kind: Column, subject: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", sha, kind, subject)), 1, 10)


def score(kind: Column, significance: Column, n_files: Column) -> Column:
    weight = F.coalesce(*[F.when(kind == k, w) for k, w in KIND_WEIGHT.items()])
    return weight * significance * (1.0 + F.log1p(n_files.cast("double")))


def rank(decisions: DataFrame, limit: int = MAX_DECISIONS, per_kind: int = MAX_PER_KIND) -> DataFrame:
    """The most significant decisions: one per commit and bucket, at most ``per_kind`` per bucket, ``limit`` in
    all. Dedupe is a max_by per (sha, bucket); the two caps are top-k ranks over seven buckets."""
    bucket = F.when(F.col("kind").isin("dependency_replace", "dependency_change"), "dependency").otherwise(F.col("kind"))
    scored = decisions.withColumn("id", decision_id(F.col("sha"), F.col("kind"), F.col("subject"))).withColumn(
        "bucket", bucket).withColumn("score", score(F.col("kind"), F.col("significance"), F.col("n_files")))
    order = [F.desc("score"), F.asc_nulls_first("date"), F.col("id")]
    row = F.struct(*[c for c in scored.columns if c not in ("sha", "bucket")])
    best = scored.groupBy("sha", "bucket").agg(F.min_by(row, F.struct(-F.col("score"), F.coalesce("date", F.lit("")), F.col("id"))).alias("r")).select("sha", "bucket", "r.*")
    capped = best.withColumn("_n", F.row_number().over(Window.partitionBy("bucket").orderBy(*order))).filter(F.col("_n") <= per_kind)
    return capped.orderBy(*order).limit(limit).withColumn("score", F.round("score", 3)).drop("_n", "bucket")


def best_match(decisions: DataFrame, question: str) -> DataFrame:
    """The decision with this id, else the one sharing most words with the question (first in id order)."""
    wanted = text.tokens(F.lit(question))
    have = text.tokens(F.concat_ws(" ", "subject", F.array_join("packages", " "), "commit_subject", "kind"))
    scored = decisions.withColumn("_overlap", F.when(F.col("id") == question.strip(), F.lit(1 << 30)).otherwise(
        F.size(F.array_intersect(F.array_distinct(wanted), have))))
    return scored.filter("_overlap > 0").orderBy(F.desc("_overlap"), "date", "id").limit(1).drop("_overlap")


def excluded(path: Column, patterns: list[str]) -> Column:
    """Paths the user leaves out (case-sensitive wildcards)."""
    return matches_any(path, patterns)


def usable_commits(commits: DataFrame, touched: DataFrame, patterns: list[str]) -> DataFrame:
    """Drops commits whose files are all excluded; commits without files stay."""
    if not patterns:
        return commits
    gone = touched.groupBy("hash").agg(F.min(excluded(F.col("path"), patterns)).alias("_all")).filter("_all")
    return commits.join(gone, "hash", "left_anti")
