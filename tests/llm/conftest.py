import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def documents(spark):
    """Rows of ``documents`` from (doc_id, text, source) triples."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def awkward():
    """Nulls, blanks, a very long text, ties, repeated rows, odd white space and symbols."""
    import random

    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = prose(300), prose(60)
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, base, "b"), (5, base, "b"), (6, base.replace(" ", "\n", 9), "b"),
            (7, base + " tail words here", None), (8, passage, "c"), (9, prose(40) + "\n" + passage + " " + prose(40), "c"),
            (10, "same same " * 60, "a"), (11, "One two", "a"), (12, "one TWO", "b"), (13, "x" * 5000, None), (14, "é ß 中 " * 12, "é"),
            (15, prose(20000), "b"), (16, "a# b$ c% " * 30, "c"), (17, "line one is this\n" * 30, "c"), (18, "LOUD WORDS ONLY " * 9, "a"),
            (19, prose(19), "a"), (20, prose(20), "a")]
    rows += [(100 + i, prose(rng.randint(1, 120)), rng.choice(["a", "b", "c", None])) for i in range(60)]
    changed = base.split(" ")
    for i in range(30):
        w = list(changed)
        for _ in range(rng.randint(1, 8)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((200 + i, " ".join(w), "b"))
    return rows
