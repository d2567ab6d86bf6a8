"""A cache fed by batches that may come again, and what a session carries on."""

import uuid

from lexquarry.sources.committed import Committed
from lexquarry.streaming import cache


def test_repeated_batches_change_nothing(spark, tmp_path):
    table = Committed(spark, f"file://{tmp_path}/{uuid.uuid4().hex}")
    rows = lambda *r: spark.createDataFrame(list(r), "key string, label string, pos long")
    keep, got = cache.keeper(table), lambda: {r["key"]: r["label"] for r in cache.current(table).collect()}
    assert cache.current(table) is None
    first = rows(("a", "x", 1), ("a", "y", 2), ("b", "z", 3), (None, "n", 4))
    keep(first, 0)
    keep(rows(("a", "late", 0)), 1)
    assert got() == {"a": "late", "b": "z"}
    keep(first, 0)
    assert got() == {"a": "late", "b": "z"}
    cache.compact(table)
    keep(first, 0)
    assert got() == {"a": "late", "b": "z"} and len(table.batches()) == 1
    keep(rows(("b", "new", 0)), 2)
    assert got() == {"a": "late", "b": "new"}
    cache.compact(table)
    keep(rows(("c", "w", 9)), 3)
    assert got() == {"a": "late", "b": "new", "c": "w"}


def test_sessions(spark):
    rows = [(1, i, (i * 7) % 11, (i * 5) % 9) for i in range(300)] + [(2, 0, None, 3), (2, 1, 4, None), (None, 0, 2, 2)]
    df = spark.createDataFrame(rows, "session int, pos int, estimate int, available int")
    got = {(r["session"], r["pos"]): (r["target"], r["taken"]) for r in cache.carried(df).collect()}
    state = {}
    for s, pos, estimate, available in rows:
        before = state.setdefault(s, [])
        target = max(estimate or 0, int(sum(before) / len(before) * 0.8)) if before else estimate or 0
        before.append(min(target, available or 0))
        assert got[s, pos] == (target, before[-1])
    assert cache.carried(df.limit(0)).count() == 0
