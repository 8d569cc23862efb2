"""Text expressions, manifests, diffs, findings and issues on literal inputs."""

import math

import pytest
from pyspark.sql import functions as F

from codestrata.functions import paths, text
from codestrata.functions.patterns import matches
from codestrata.operators import pull_requests, relevance, review
from codestrata.sources import gitlog, manifests


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("path, pattern, hit", [
    ("src/a/b.py", "src/*", True), ("a.py", "?.py", True), ("ab.py", "?.py", False), ("b1", "[ab][!2]", True), ("b2", "[ab][!2]", False),
    ("A.py", "a.py", False), ("docker-compose.prod.yml", "docker-compose*.yml", True), ("x.py\n", "x.py", False)])
def test_wildcards(spark, path, pattern, hit):
    assert value(spark, matches(F.lit(path), pattern)) is hit


@pytest.mark.parametrize("path, safe", [("a/b.py", True), ("/a.py", False), ("a/../b.py", False), ("C:/a.py", False), ("a/.git/x.py", False),
                                        ("node_modules/a.js", False), ("a//b.py", False), ("x" * 241, False), (".eslintrc.js", True)])
def test_safe_paths(spark, path, safe):
    assert value(spark, paths.is_safe_relative(F.lit(path))) is safe


def test_groups(spark):
    inside = lambda p, g: value(spark, paths.in_group(F.lit(p), F.lit(g)))
    assert [inside("pkg/x/a.py", "pkg"), inside("pkg/a.py", "pkg/*"), inside("pkg/x/a.py", "pkg/*"), inside("a.py", "*"), inside("x/a.py", "*")] == [True, True, False, True, False]


def test_tokens(spark):
    assert value(spark, text.tokens(F.lit("Fix HTMLParser in src/user_service.py: parseURL2 and 2024"))) == ["html", "parser", "user", "service", "parse", "url", "2024"]


def test_tfidf_matches_the_formula(spark):
    docs = [["cache", "cache", "redis"], ["redis", "queue"], ["cache"]]
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc int, words string")
    terms = relevance.term_counts(df, "doc", [F.col("words")])
    n = df.agg(F.count(F.lit(1)).cast("double").alias("n_docs"))
    vec = {(r["doc"], r["token"]): r["w"] for r in relevance.vectors(terms, relevance.inverse_frequency(terms, n), n, "doc").collect()}
    idf = lambda c: math.log(4 / (1 + c)) + 1
    a, b = (1 + math.log(2)) * idf(2), idf(2)
    assert vec[0, "cache"] == pytest.approx(a / math.hypot(a, b)) and vec[2, "cache"] == pytest.approx(1.0)


def test_band_pairs_match_brute_force(spark):
    import datetime
    import random
    rng = random.Random(5)
    day = [(datetime.date(2024, 1, 1) + datetime.timedelta(days=i // 3)).isoformat() for i in range(300)]
    commits = [(f"c{i}", i, day[i], rng.random() < 0.8) for i in range(300)]
    chosen = [3, 40, 41, 150, 299]
    d = spark.createDataFrame([(f"d{i}", f"c{i}", i, day[i]) for i in chosen], "decision string, sha string, idx long, date string")
    got = {(r["decision"], r["hash"]) for r in relevance.band_pairs(d, spark.createDataFrame(commits, "hash string, idx long, date string, usable boolean")).collect()}
    gap = lambda a, b: abs((datetime.date.fromisoformat(a) - datetime.date.fromisoformat(b)).days)
    assert got == {(f"d{i}", h) for i in chosen for h, j, when, ok in commits if ok and j != i and abs(i - j) <= 40 and gap(when, day[i]) <= 30}


@pytest.mark.parametrize("raw, masked", [
    ('k = "AbCd1234567890efXY"', 'k = "AbCd****"'), ("AKIA0123456789ABCD", "AKIA****"), ('p = "path/to/some/file1"', 'p = "path/to/some/file1"'),
    ('w = "plainwordsonlyhere"', 'w = "plainwordsonlyhere"'), ('"aaaaaaaaaaaaaaaa.b"1234567890abcdefgh"', '"aaaaaaaaaaaaaaaa.b"1234567890abcdefgh"')])
def test_masking(spark, raw, masked):
    assert value(spark, text.mask_secrets(F.lit(raw))) == masked


@pytest.mark.parametrize("question, intents", [
    ("Why was redis adopted?", ["rationale"]), ("Who changed `app.py` last?", ["structural", "historical"]), ("What does this do?", ["structural"]),
    ("Which layers are violated?", ["architectural"]), ("When did the architecture drift, and why?", ["architectural", "historical", "rationale"])])
def test_routing(spark, question, intents):
    assert value(spark, text.route_intents(F.lit(question))) == intents


@pytest.mark.parametrize("raw, fixed", [
    ('{"a": [{"b": 1}}', '{"a":[{"b":1}]}'), ('{ {"a": 1}', '{"a":1}'), ('{"a": "]}"', '{"a":"]}"}'), ("{nope", None), ("[1]", None), (None, None), ("", None),
    ("{" + " " * 250 + '{"b": 1, "a": [2]}', '{"a":[2],"b":1}'), ('{"a": "x\\"} {["}]', '{"a":"x\\"} {["}'), ('{"a": [1, {"b": 2]}', '{"a":[1,{"b":2}]}'),
    ('{"a": 1', '{"a":1}'), ('{"a": "' + "y" * 60000 + '"', '{"a":"' + "y" * 60000 + '"}')])
def test_bracket_repair(spark, raw, fixed):
    assert value(spark, text.repair_json_brackets(F.lit(raw).cast("string"))) == fixed


def test_manifests(spark):
    rows = [("requirements-dev.txt", "-r base\nFlask_Login[x]>=1 # c\n\nhttp://x\npytest\n"),
            ("package.json", '{"dependencies": {"React": "1"}, "devDependencies": {"react": "1", "jest": "2"}}'), ("bad/package.json", "{"),
            ("pyproject.toml", '[project]\nname = "x"\ndependencies = [\n "sqlalchemy[asyncio]>=2", \'starlette\',\n]\n[project.optional-dependencies]\ntest = ["pytest>=7"]\n'
                               '[tool.poetry.dependencies]\npython = "^3"\nredis = "5"\n[tool.poetry.group.dev.dependencies]\nblack = "1"\n'),
            ("Pipfile", '[packages]\ndjango = "*"\n[dev-packages]\nmypy = "*"\n')]
    got = {(r["path"], r["package"], r["dev"], r["ecosystem"]) for r in manifests.manifest_packages(spark.createDataFrame(rows, "path string, content string"), []).collect()}
    assert got == {("requirements-dev.txt", "flask-login", True, "pypi"), ("requirements-dev.txt", "pytest", True, "pypi"), ("package.json", "react", False, "npm"),
                   ("package.json", "jest", True, "npm"), ("pyproject.toml", "sqlalchemy", False, "pypi"), ("pyproject.toml", "starlette", False, "pypi"), ("pyproject.toml", "pytest", True, "pypi"),
                   ("pyproject.toml", "redis", False, "pypi"), ("pyproject.toml", "black", True, "pypi"), ("Pipfile", "django", False, "pypi"), ("Pipfile", "mypy", True, "pypi")}


DIFF = """diff --git a/app.py b/app.py
index 1..2 100644
--- a/app.py
+++ b/app.py
@@ -1,3 +1,4 @@ def f():
 import os
-old
+new one
+new two

@@ -20,2 +21,2 @@
-x
+y
 z
diff --git a/old.py b/new.py
similarity index 100%
rename from old.py
rename to new.py
diff --git a/gone.py b/gone.py
deleted file mode 100644
--- a/gone.py
+++ /dev/null
@@ -1 +0,0 @@
-bye
"""


def test_diff(spark):
    files = gitlog.diff_files(spark.createDataFrame([(1, DIFF)], "id int, diff string"), ["id"])
    assert {(r["path"], r["old_path"], r["status"]) for r in files.collect()} == {("app.py", "app.py", "modified"), ("new.py", "old.py", "renamed"), ("gone.py", "gone.py", "deleted")}
    lines = [(r["kind"], r["new_no"], r["text"]) for r in gitlog.diff_lines(files, ["id"]).filter("path = 'app.py'").orderBy("hunk", "pos").collect()]
    assert lines == [(" ", 1, "import os"), ("-", None, "old"), ("+", 2, "new one"), ("+", 3, "new two"), (" ", 4, ""), ("-", None, "x"), ("+", 21, "y"), (" ", 22, "z")]


def test_next_fit(spark):
    assert value(spark, review.next_fit(F.array(*[F.lit(n) for n in (5, 4, 3, 9, 1)]), 8)) == [0, 1, 1, 2, 3]


def test_issue_plan(spark):
    found = spark.createDataFrame([("a", 1, "high"), ("b", 2, "high"), ("c", 3, "low"), ("d", 4, "critical"), ("e", 5, "medium")], "fingerprint string, rank long, severity string")
    raw = spark.createDataFrame([(7, "open", "a", False), (8, "closed", "b", False), (9, "open", "c", True)], "number long, state string, fp string, is_pull_request boolean")
    body = review.encode_meta(F.struct(F.col("fp"), F.lit("code").alias("kind"), F.lit("x.py").alias("file"), F.lit("q").alias("quote")))
    issues = review.decode_issues(raw.select("number", "state", F.lit("t").alias("title"), body.alias("body"), "is_pull_request"))
    plan = {r["fingerprint"]: (r["action"], r["reason"]) for r in review.plan_issues(found, issues, max_issues=1).collect()}
    assert plan == {"a": ("skip", "already open as #7"), "b": ("skip", "closed as #8; not re-raised"), "c": ("skip", "below the medium threshold"), "d": ("create", ""),
                    "e": ("skip", "over the 1-issue limit for one run")}


def test_pull_request_links(spark):
    assert value(spark, pull_requests.message_refs(F.lit("Fix (#12)"), F.lit("see #3, a#4 and #12, #5, #6"))) == [12, 3, 5, 6]
    assert value(spark, pull_requests.message_refs(F.lit("Fix (#12)"), F.lit("see #3, a#4 and #12, #5, #6"), limit=3)) == [12, 3, 5]
    merges = spark.createDataFrame([("m1", ["b0", "f2"], "2024-01-05", "Merge pull request #9 from x/y"), ("m2", ["m1", "z"], "2024-01-06", "Merge branch z")],
                                   "hash string, parents array<string>, date string, subject string")
    parents = spark.createDataFrame([("f2", "f1"), ("f1", "b0"), ("b0", "root"), ("m1", "b0")], "hash string, parent string")
    brought = pull_requests.commits_of_merges(pull_requests.merge_numbers(merges), parents)
    assert {tuple(r) for r in brought.select("hash", "number").collect()} == {("f1", 9), ("f2", 9)}
    urls = spark.createDataFrame([("main/src",), ("feature/x/src/a",), ("gone",)], "rest string")
    branches = spark.createDataFrame([("main",), ("feature",), ("feature/x",)], "branch string")
    assert {tuple(r) for r in pull_requests.split_branch(urls, branches).collect()} == {("main/src", "main", "src"), ("feature/x/src/a", "feature/x", "src/a"), ("gone", None, None)}
    texts = spark.createDataFrame([(1, "t", "about secret/x"), (2, "t", "<!-- a -->fine")], "number int, title string, body string")
    assert [tuple(r) for r in pull_requests.visible_texts(texts, ["secret/*"]).select("number", "body").collect()] == [(2, "fine")]


def test_unquoted_paths(spark):
    cases = {r'"b/caf\303\251.py"': "b/café.py", r'"a\tb\n\"c\"\\d"': 'a\tb\n"c"\\d', r'"\344\270\255/\001x"': "中/\x01x", "plain/ä.py": "plain/ä.py", '"': '"', '""': "", '"open': '"open', r'"\\303"': "\\303"}
    got = spark.createDataFrame([(c,) for c in cases] + [(None,)], "p string").select("p", paths.unquoted(F.col("p")).alias("u")).collect()
    assert {r["p"]: r["u"] for r in got} == {**cases, None: None}
