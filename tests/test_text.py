"""Text and citation functions on literals with known values."""

import pytest
from pyspark.sql import functions as F

from lexquarry.functions import text as fn
from lexquarry.operators import fusion, resolve, select
from lexquarry.operators.retrieval import rank_step


@pytest.fixture(scope="module")
def one(spark):
    return lambda column: spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens(one):
    text = F.lit("Über Straße Éléments x ab 12cd")
    assert one(fn.tokenize(text)) == ["über", "straße", "ments", "ab", "cd"]
    assert one(fn.tokenize(text, 2)) == ["über", "straße", "ments"]


def test_explicit(one):
    text = "Under Art. 934 Abs. 1bis ZGB, Art. 8 Abs. 1 BV and Art. 5 Common law; Art. 221 Abs. 1 lit. b StPO"
    assert one(fn.explicit_citations(F.lit(text))) == ["Art. 934 Abs", "Art. 8 Abs. 1 BV", "Art. 5 Common", "Art. 221 Abs. 1 lit. b StPO"]
    assert one(fn.explicit_cases(F.lit("BGE 137 IV 122 E. 4.2, 1B_210/2023"))) == ["BGE 137 IV 122", "1B_210/2023"]
    assert one(fn.mined_citations(F.lit("BGE 137 IV 122 E. 4.2 und Art. 5 ZGB und BGE 137 IV 122 E. 4.2"))) == ["Art. 5 ZGB", "BGE 137 IV 122 E. 4.2"]


@pytest.mark.parametrize(("citation", "key"), [("Art. 221 Abs. 1 lit. b StPO", ("StPO", "221")), ("Art. 10a USG", ("USG", "10a")), ("Art. 934 Abs. 1bis ZGB", ("ZGB", "934")), ("Art. 221 Abs", ("Abs", "221")), ("Art. 1bis ZGB", None), ("BGE 137 IV 122 E. 4.2", None)])
def test_law_key(one, citation, key):
    got = one(fn.law_key(F.lit(citation)))
    assert (tuple(got) if got else None) == key


def test_bases(one):
    assert one(fn.court_base(F.lit("BGE 137 IV 122 E. 4.2"))) == "BGE 137 IV 122"
    cites = ["Art. 221 Abs. 1 StPO", "Art. 5 Abs. 2 ZGB", "Art. 1 LugÜ"]
    assert [one(fn.law_base(F.lit(c))) for c in cites] == ["Art. 221", "Art. 5 ZGB", "Art. 1"]
    assert [one(fn.law_base_by_tokens(F.lit(c))) for c in cites] == ["Art. 221 StPO", "Art. 5 ZGB", "Art. 1 LugÜ"]


def test_ratio(spark):
    rows = spark.createDataFrame([("Art. 221 Abs. 1 StPO",), ("Art. 221 Abs. 2 StPO",), ("Art. 221 StPO",)], "c string")
    got = [round(r[0], 6) for r in rows.select(resolve.sequence_ratio(F.lit("Art. 221 Abs. 1 lit. b StPO"), "c")).collect()]
    assert got == [0.851064, 0.808511, 0.65]


def test_boost(one):
    for score, n, value in [(0.9, 2, 0.96), (0.9, 3, 0.98), (0.4, 2, 0.5), (0.4, 3, 0.675)]:
        assert one(F.round(fusion.boosted(F.lit(score), F.lit(n)), 6)) == value


def test_target(one):
    got = [one(select.staged_target(F.lit(e), F.lit(n))) for e, n in [(1, 0), (25, 30), (25, 40), (38, 60), (5, 0)]]
    assert got == [9, 30, 33, 40, 10]
    assert [one(F.bround(F.lit(x))) for x in (2.5, 3.5, 4.5)] == [2, 4, 4]


def test_split(one):
    assert one(fn.split_citations(F.lit(""))) == [] and one(fn.split_citations(F.lit(None).cast("string"))) == []
    assert one(fn.split_citations(F.lit("a; b;"))) == ["a", "b"]


def test_strings(one):
    assert one(fn.compact(F.lit("  a  b\n" + "c" * 20), 10)) == "a b ccc..."
    assert one(fn.truncate(F.lit("abcdef"), 3)) == "abc…"
    assert one(fn.safe_name(F.lit("a b/c"))) == "a_b_c"
    assert one(fn.lenient_json(F.lit('noise {"k": 3} tail'), "k int")) == (3,)
    assert one(fn.lenient_json(F.lit("no json"), "k int")) is None
    assert one(rank_step(F.lit(30), [(10, 0.72), (25, 0.66), (50, 0.58)], 0.44)) == 0.58
    assert one(fn.expand_case(F.lit("BGE 1 I 1"), F.array().cast("array<string>"))) == ["BGE 1 I 1"]


def test_decisions(spark):
    raw = spark.createDataFrame([(1, 1, "1", "MAYBE", "1.7"), (1, 2, "2", "must_include", "x"), (1, 3, "2", "plausible", "0.4"), (1, 4, "z", "reject", "0")], "query_id int, pos int, id string, label string, confidence string")
    assert sorted(map(tuple, fusion.decisions(raw).collect())) == [(1, 1, "reject", 1.0), (1, 2, "plausible", 0.4)]


def test_consensus(spark):
    labels = {"a": ["must_include", "must_include", "reject"], "b": ["must_include", "plausible", "reject"], "c": [None, None, None]}
    rows = spark.createDataFrame([(1, c, i, x, 0.5) for c, xs in labels.items() for i, x in enumerate(xs)], "query_id int, citation string, pass int, label string, confidence double")
    got = {r.citation: r.label for r in fusion.consensus(rows).collect()}
    assert got == {"a": "must_include", "b": "plausible", "c": "reject"}
