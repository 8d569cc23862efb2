"""The Merkle manifest against a plain tree, on awkward rows and on trees of several levels."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from codestrata.llm import op13_merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    fields = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def tree(leaves):
    """(root, siblings of each leaf as (left, right) lists by level)."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        here = levels[-1]
        levels.append([sha(*here[i:i + 8]) for i in range(0, len(here), 8)])
    paths = []
    for at in range(len(leaves)):
        path = []
        for level in levels[:-1]:
            first = at - at % 8
            path.append(("".join(level[first:at]), "".join(level[at + 1:first + 8])))
            at //= 8
        paths.append(path)
    return levels[-1][0], paths


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    by_lang = defaultdict(list)
    for row in rows:
        by_lang[row["lang"]].append((leaf(row, row["text"]), row))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        by_lang[lang].sort(key=lambda x: (x[1]["doc_id"] is not None, x[1]["doc_id"] or 0, x[0]))
    built = {lang: tree([x[0] for x in by_lang[lang]]) for lang in langs}
    root, upper = tree([built[lang][0] for lang in langs])
    out = []
    for lang, above in zip(langs, upper, strict=True):
        for (own, row), path in zip(by_lang[lang], built[lang][1], strict=True):
            i = row["doc_id"]
            node = leaf(row, lowered(row["text"])) if i is not None and zlib.crc32(str(i).encode()) % 3 == 0 else own
            whole = path + above
            for left, right in whole:
                node = sha(left, node, right)
            out.append((i, own, built[lang][0], root, sha(*(left + right for left, right in whole)), node, node == root))
    return sorted(out, key=repr)


def run(spark, rows, tmp_path, **extra):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    for name, value in extra.items():
        df = df.withColumn(name, F.lit(value))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = op13_merkle.op13_merkle(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in got.collect()), key=repr), [r.asDict() for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def test_levels_and_lone_runs(spark, tmp_path):
    # 521 = one more than 65 runs: the last run of two levels is a single node; a language of one, of eight and of nine
    rows = [(i, f"s{i % 3}", "en", 7, f"Text {i}") for i in range(521)] + [(1000, None, "de", None, "Alone")]
    rows += [(2000 + i, "x", "fr", 1, "gleich") for i in range(8)] + [(3000 + i, "x", "中", 1, "É A") for i in range(9)]
    got, given = run(spark, rows, tmp_path)
    assert got == brute(given)
    assert any(r[6] for r in got) and not all(r[6] for r in got)


def test_awkward_rows(spark, tmp_path, awkward):
    rows = [(i, s, None if i % 5 == 0 else "en", None if t is None else len(t), t) for i, t, s in awkward]
    rows += [(4, "b", "en", 1, "Repeated"), (4, "b", "en", 1, "Repeated"), (None, "b", "en", 1, "First"), (None, "b", "en", 1, "Second"), (7, "", "", 0, "")]
    got, given = run(spark, rows, tmp_path, tree="mine", slot=1, digest="d", _at=5, left="l", path="p", _slot=2, Last="x")
    assert got == brute(given) and len(got) == len(rows)


def test_empty_and_single(spark, tmp_path):
    assert run(spark, [], tmp_path / "none")[0] == []
    got, given = run(spark, [(5, "s", "en", 1, "Only ONE")], tmp_path / "one")
    assert got == brute(given) and got[0][1] == got[0][2] == got[0][3]


@pytest.mark.parametrize("column", ["doc_id", "source", "lang", "n_chars", "text"])
def test_any_changed_field_shows(spark, column):
    rows = [(i, "s", "en", 5, "abc de") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    other = docs.schema[column].dataType
    changed = {c: F.col(c) for c in docs.columns} | {column: F.lit("9").cast(other)}
    suspect = op13_merkle.digest(*[op13_merkle.field(changed[c]) for c in op13_merkle.FIELDS])
    checked = op13_merkle.verify(op13_merkle.manifest(docs, F.when(F.col("doc_id") == 11, suspect).otherwise(op13_merkle.leaf()))).collect()
    assert [r["doc_id"] for r in checked if not r["verified"]] == [11]
