"""The robust objective against plain loops, with and without a test set and anchors."""

import random
import statistics

import __spark_entry__ as entry
from lexquarry.operators import ensemble, metrics
from lexquarry.plans import base

SF = "/root/testdata/sf0.001"


def _shape(sets, queries):
    n = [len(sets.get(q, ())) for q in queries]
    courts = [sum(not c.startswith("Art.") for c in sets[q]) / len(sets[q]) if sets.get(q) else 0.0 for q in queries]
    return sum(n) / len(n), sum(courts) / len(courts)


def _like(sets, anchor, queries):
    pairs = [(sets.get(q, set()), anchor.get(q, set())) for q in queries]
    return sum(len(a & b) / len(a | b) if a | b else 1.0 for a, b in pairs) / len(pairs)


def _objective(f1, sets, queries, test=None, test_queries=(), v11=None, v7=None):
    low = lambda x, floor, weight: max(0.0, floor - x) * weight
    n, courts = _shape(sets, queries)
    out = statistics.fmean(f1) - 0.45 * statistics.pstdev(f1) + 0.08 * min(f1) - low(courts, 0.28, 0.9) - low(n, 24.0, 0.01)
    if test is not None:
        n, courts = _shape(test, test_queries)
        out -= low(courts, 0.24, 0.9) + low(n, 23.0, 0.01)
        out -= low(_like(test, v11, test_queries), 0.60, 0.15) if v11 is not None else 0
        out -= low(_like(test, v7, test_queries), 0.30, 0.10) if v7 is not None else 0
    return out


def _sets(rows):
    out = {}
    for *key, c in rows:
        out.setdefault(tuple(key), set()).add(c)
    return out


def _of(sets, variant):
    return {q: s for (v, q), s in sets.items() if v == variant}


def test_robust_objective(spark):
    rng = random.Random(5)
    make = lambda variants, queries, size: [(v, q, f"{'BGE' if rng.random() < 0.15 * v else 'Art.'} {rng.randint(1, 40)}") for v in variants for q in queries for _ in range(size * v)]
    val, test = make(range(1, 5), range(5), 9), make(range(1, 5), range(4), 8)
    val, test = val + val[:9], [r for r in test if r[0] != 2]  # repeated rows; a variant without test predictions
    anchors = {k: [(q, c) for v, q, c in test if v == 4 and rng.random() < share] for k, share in (("v11", 0.8), ("v7", 0.2))}
    f1 = [(v, q, rng.random()) for v in range(1, 5) for q in range(6)]
    frame = lambda rows: spark.createDataFrame(rows, "variant int, query_id int, citation string")
    ids = lambda n: spark.createDataFrame([(q,) for q in range(n)], "query_id int")
    scores = spark.createDataFrame(f1, "variant int, query_id int, f1 double")
    sets, held = _sets(val), _sets(test)
    flat = {k: {q: {c for p, c in rows if p == q} for q in range(5)} for k, rows in anchors.items()}
    for names in (None, [], ["v11"], ["v11", "v7"]):
        more = {} if names is None else {"test": frame(test), "test_queries": ids(5)} | {k: spark.createDataFrame(anchors[k], "query_id int, citation string") for k in names}
        got = dict(map(tuple, ensemble.robust_objective(scores, "variant", frame(val), ids(6), **more).collect()))
        assert sorted(got) == [1, 2, 3, 4]
        for v, x in got.items():
            want = _objective([y for w, _, y in f1 if w == v], _of(sets, v), range(6), *([] if names is None else [_of(held, v), range(5)]), **{k: flat[k] for k in names or ()})
            assert abs(x - want) < 2e-6


def test_registered(spark):
    """The query's own figures: penalties on courts and list sizes, none on F1."""
    queries = range(42)
    sets = _sets(map(tuple, base.runs(spark, SF).collect()))
    got = dict(map(tuple, entry.queries()["robust_objective"](spark, SF).collect()))
    assert sorted(got) == list(range(5))
    for v, x in got.items():
        f1 = [r.f1 for r in metrics.per_query(base.run(spark, SF, v), base.gold(spark, SF), base.queries(spark, SF)).collect()]
        assert abs(x - _objective(f1, _of(sets, v), queries)) < 1e-4
