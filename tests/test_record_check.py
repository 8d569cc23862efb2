"""Drafted records against literal evidence."""

from codestrata.operators import record_check

FULL = "0123456789abcdef0123456789abcdef01234567"
OTHER = "0123456fffffffffffffffffffffffffffffffff"
FIELDS = "record_id long, title string, context string, decision string, consequences string, alternatives string, inference string, confidence double"


def _cited(spark, drafts, items, evidence, payload, numbers):
    return record_check.citations(
        drafts, spark.createDataFrame(items, "record_id long, ord long, commit string"),
        spark.createDataFrame(evidence, "record_id long, pos long, hash string, short string"),
        spark.createDataFrame(payload, "record_id long, payload string"), spark.createDataFrame(numbers, "record_id long, number long"))


def _rows(df):
    return {(r["record_id"], r["kind"], r["cited"]): (r["in_items"], r["in_text"], r["match"], r["supported"]) for r in df.collect()}


def test_hashes_of_any_length(spark):
    drafts = spark.createDataFrame([(1, "T", f"see [{FULL[:12]}] and [0123456] and [abcdef0]", "d", None, None, "i", 0.9), (2, "T", f"[{FULL}]", "d", "", "", "i", 0.9)], FIELDS)
    items = [(1, 1, " [0123456789AB] "), (1, 2, "012345"), (1, 3, FULL), (1, 4, None), (1, 5, "0123456f")]
    got = _rows(_cited(spark, drafts, items, [(1, 2, FULL, FULL[:9]), (1, 1, OTHER, OTHER[:8])], [], []))
    assert got[1, "commit", " [0123456789AB] "] == (True, False, FULL[:9], True)
    assert got[1, "commit", "012345"] == (True, False, None, False)  # too short to name a commit
    assert got[1, "commit", FULL] == (True, False, FULL[:9], True)
    assert got[1, "commit", ""] == (True, False, None, False)
    assert got[1, "commit", "0123456f"][2] == OTHER[:8]
    assert got[1, "commit", "0123456"] == (False, True, OTHER[:8], True)  # both agree, the first evidence counts
    assert got[1, "commit", FULL[:12]] == (False, True, FULL[:9], True)
    assert got[1, "commit", "abcdef0"] == (False, True, None, False)
    assert got[2, "commit", FULL] == (False, True, None, False)  # another record's evidence


def test_paths_and_numbers(spark):
    text = "src/Api.py uses Node.js, not lib/x.toml or /root.py, see #12, &#13; x#14 and #0012 (#99)"
    drafts = spark.createDataFrame([(1, "T", text, "d", None, None, "i", None)], FIELDS)
    got = _rows(_cited(spark, drafts, [], [], [(1, "Files: SRC/api.py")], [(1, 12), (1, 12), (2, 99)]))
    assert {k[1:]: v[3] for k, v in got.items()} == {
        ("path", "src/Api.py"): True, ("path", "Node.js"): True, ("path", "lib/x.toml"): False, ("number", "#12"): True, ("number", "#99"): False}


def test_verdicts(spark):
    drafts = spark.createDataFrame([
        (1, "T", f"[{FULL[:7]}] a.py", "d", None, None, "i", 0.9), (2, " ", "c", None, None, None, "i", 0.9), (3, "T", "c", "d", None, None, "i", 5.0), (4, None, None, None, None, None, None, None)], FIELDS)
    items = [(1, 2, FULL[:8]), (1, 1, OTHER[:8]), (1, 3, FULL), (2, 1, FULL), (3, 1, "feedbee")]
    evidence = [(r, p, h, h[:8]) for r in (1, 2, 3) for p, h in ((1, FULL), (2, OTHER))]
    cited = _cited(spark, drafts, items, evidence, [], [])
    scores = spark.createDataFrame([(1, 0.4, 2, True), (2, 0.4, 2, True)], "record_id long, relevance double, others long, rationale boolean")
    got = {r["record_id"]: r for r in record_check.verdicts(drafts, cited, scores).collect()}
    assert len(got) == 4
    assert got[1]["cited_commits"] == [OTHER[:8], FULL[:8]] and got[1]["unsupported"] == ["a.py"] and got[1]["usable"]
    assert (got[1]["cap"], got[1]["confidence"], got[1]["label"]) == (0.59, 0.59, "Medium")  # 0.3 + 0.14 + 0.1 + 0.15 - 0.1
    assert got[2]["missing"] == ["title", "decision"] and not got[2]["usable"] and got[2]["confidence"] == 0.1
    assert got[3]["invalid"] == ["feedbee"] and got[3]["cited_commits"] == [] and got[3]["label"] == "Low"
    assert got[4]["missing"] == ["title", "context", "decision", "inference"] and got[4]["cap"] == 0.3


def test_texts_are_read_once(spark):
    drafts = spark.createDataFrame([(1, "[abcdef0] a.py #1", None, None, None, None, None)], "record_id long, title string, context string, decision string, consequences string, alternatives string, inference string")
    items = spark.createDataFrame([(1, 1, "abcdef01")], "record_id long, ord long, commit string")
    evidence = spark.createDataFrame([(1, 1, "abcdef0123", "abcdef0")], "record_id long, pos long, hash string, short string")
    payloads = spark.createDataFrame([(1, "A.PY")], "record_id long, payload string")
    attached = spark.createDataFrame([(1, 2)], "record_id long, number long")
    found = record_check.citations(drafts, items, evidence, payloads, attached)
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["kind"], r["cited"], r["match"], r["supported"]) for r in found.collect()) == [
        ("commit", "abcdef0", "abcdef0", True), ("commit", "abcdef01", "abcdef0", True), ("number", "#1", None, False), ("path", "a.py", None, True)]
