"""Substring and prefix search against all pairs."""

from lexquarry.operators import resolve, substrings

TEXTS = [(1, "the cat sat"), (2, "The Cat"), (3, ""), (4, None), (5, "äöü the"), (1, "the cat sat"), (6, "a" * 5000 + "b")]
PATTERNS = ["the", "cat", "t", "", None, "the", "äö", "aab", "cat sat on", "the c", "a" * 33]


def _tables(spark):
    return spark.createDataFrame(TEXTS, "id long, text string"), spark.createDataFrame([(p,) for p in PATTERNS], "pattern string")


def _pairs(rows):
    return sorted((r["id"], r["pattern"]) for r in rows.collect())


def test_holding(spark, monkeypatch):
    texts, patterns = _tables(spark)
    want = sorted((i, p) for i, t in TEXTS for p in set(PATTERNS) if t is not None and p is not None and p in t)
    assert _pairs(substrings.holding(texts, "text", patterns)) == want
    monkeypatch.setattr(substrings, "CHARACTERS", 12)
    assert _pairs(substrings.holding(texts, "text", patterns)) == want
    assert _pairs(substrings.holding(texts.limit(0), "text", patterns)) == [] == _pairs(substrings.holding(texts, "text", patterns.limit(0)))


def test_beginning(spark):
    texts, patterns = _tables(spark)
    want = sorted((i, p) for i, t in TEXTS for p in PATTERNS if t is not None and p is not None and t.startswith(p))
    assert _pairs(substrings.beginning(texts, "text", patterns)) == want
    assert _pairs(substrings.beginning(texts, "text", patterns.limit(0))) == []


def test_no_nested_loop(spark):
    texts, patterns = _tables(spark)
    for rows in (substrings.holding(texts, "text", patterns), substrings.beginning(texts, "text", patterns)):
        assert "NestedLoop" not in rows._jdf.queryExecution().executedPlan().toString()


def test_translate(spark):
    queries = spark.createDataFrame([(1, "The CAT of the house"), (2, "none"), (3, None)], "query_id long, query string")
    glossary = spark.createDataFrame([("cat", "Katze"), ("the house", "das Haus"), ("Of", "von")], "en string, de string")
    got = {r["query_id"]: r["terms"] for r in resolve.translate(queries, glossary).collect()}
    assert got == {1: "das Haus Katze von", 2: "none", 3: None}
