"""Forced selection against its loop, a row at a time."""

import random

import pytest

from lexquarry.operators.select import Forced, forced


def _loop(rows, cfg):
    """The selection as a loop over one query's rows."""
    rows = sorted(rows, key=lambda r: (-r["prob"], -r["is_explicit"], -(r["auto_bucket"] == "auto_keep"), -r["final_score"], r["baseline_rank"], r["citation"]))
    target = min(cfg.max_output, max(cfg.min_output, round(rows[0]["estimate"] * cfg.mult + cfg.bias)))
    cap, out, courts = max(0, round(target * cfg.court_fraction)), [], 0

    def take(r):
        nonlocal courts
        out.append(r["citation"])
        courts += r["kind"] == "court"

    for r in rows if cfg.keep_explicit else []:
        if r["is_explicit"]:
            take(r)
    for r in rows if cfg.keep_auto else []:
        if r["auto_bucket"] == "auto_keep" and r["citation"] not in out and not (r["kind"] == "court" and courts >= cap):
            take(r)
            if len(out) >= target:
                return out
    for r in rows:
        if len(out) >= target or (r["prob"] < cfg.threshold and len(out) >= cfg.min_output):
            break
        if r["citation"] not in out and not (r["kind"] == "court" and courts >= cap):
            take(r)
    return out


@pytest.mark.parametrize("cfg", [Forced(), Forced(0.5, 0.5, 2, 7, 0.6, 0.5), Forced(1, 0, 3, 9, 0.3, 0.2, keep_explicit=False), Forced(1, 0, 3, 9, 0.8, 0.4, keep_auto=False), Forced(0.1, 0, 1, 5, 0.5, 0.0)])
def test_equals_the_loop(spark, cfg):
    rng, rows = random.Random(7), []
    for q in range(40):
        estimate = rng.randint(1, 14)
        for i in range(rng.randint(1, 18)):
            rows.append((q, f"c{i:02d}", rng.choice(["law", "court"]), rng.randint(0, 4) / 4, rng.random() < 0.2, rng.choice(["auto_keep", "judge", "auto_drop"]), rng.randint(0, 2) / 2, rng.randint(1, 5), estimate))
    names = ["query_id", "citation", "kind", "prob", "is_explicit", "auto_bucket", "final_score", "baseline_rank", "estimate"]
    df = spark.createDataFrame(rows, "query_id int, citation string, kind string, prob double, is_explicit boolean, auto_bucket string, final_score double, baseline_rank int, estimate int")
    got = {}
    for r in sorted(forced(df, cfg).collect(), key=lambda r: (r["query_id"], r["position"])):
        got.setdefault(r["query_id"], []).append(r["citation"])
    for q in range(40):
        assert got.get(q, []) == _loop([dict(zip(names, r)) for r in rows if r[0] == q], cfg)


def test_stops_at_the_target(spark):
    rows = [(1, f"e{i}", "law", 0.9, True, "judge", 0.5, i, 5) for i in range(3)] + [(1, f"k{i}", "law", 0.8, False, "auto_keep", 0.5, i, 5) for i in range(5)]
    df = spark.createDataFrame(rows, "query_id int, citation string, kind string, prob double, is_explicit boolean, auto_bucket string, final_score double, baseline_rank int, estimate int")
    assert forced(df, Forced(min_output=1)).count() == 5
    assert forced(df.limit(0), Forced()).count() == 0
