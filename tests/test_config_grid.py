"""The grid against a loop over each configuration's candidates."""

import random

import numpy as np

from lexquarry.operators.config_grid import FIRST, Grid, Options, _Order, grid_scores, selected_counts


def _rows(seed):
    rng, out = random.Random(seed), []
    for q in range(6):
        for i in range(rng.randint(1, 30)):
            court = rng.random() < 0.5
            out.append((q, f"c{i:02d}", 3 + q, court, f"b{rng.randint(0, 4)}", rng.randint(0, 1), float(rng.randint(0, 1)), float(rng.randint(0, 1)), rng.randint(0, 4) / 4))
    return out


def _loop(rows, weights, o):
    score = lambda r: round(sum(w * x for w, x in zip(weights, r[6:])), 6)
    target = min(o.max_output, max(o.min_output, round(rows[0][2] * o.mult) + o.bias))
    cap, chosen, courts, bases = round(target * o.court_fraction), [], 0, {}
    for r in sorted(rows, key=lambda r: (-score(r), -r[6], -r[7], r[1])):
        most = o.court_per_base if r[3] else o.law_per_base
        if len(chosen) >= target:
            break
        if (r[3] and courts >= cap) or (most and bases.get((r[3], r[4]), 0) >= most):
            continue
        chosen.append(r)
        courts += r[3]
        bases[r[3], r[4]] = bases.get((r[3], r[4]), 0) + 1
    return len(chosen), sum(r[5] for r in chosen), courts


def test_grid_equals_the_loop(spark):
    rows = _rows(3)
    df = spark.createDataFrame(rows, "query_id int, citation string, estimate int, court boolean, base string, label int, v7_bonus double, v11_bonus double, x double")
    grid = Grid.of({"v7_bonus": 0.5, "v11_bonus": 0.25, "x": 0.0}, {"x": [-1.0, 0.0, 2.0], "v7_bonus": [0.0, 1.0]}, Options(min_output=2, max_output=9), law_per_base=[0, 1, 2], court_per_base=[0, 1], court_fraction=[0.2, 0.5])
    assert len(grid) == 72
    got = {(r["config_id"], r["query_id"]): (r["n_pred"], r["tp"], r["courts"]) for r in selected_counts(df, grid).collect()}
    want = {}
    for i in range(len(grid)):
        c = grid.config(i)
        o = Options(**{k: c[k] for k in vars(Options())})
        for q in range(6):
            want[i, q] = _loop([r for r in rows if r[0] == q], [c[n] for n in grid.names], o)
    assert got == want
    some = {(r["config_id"], r["query_id"]): (r["n_pred"], r["tp"], r["courts"]) for r in selected_counts(df, grid, [5, 40]).collect()}
    assert some == {k: v for k, v in want.items() if k[0] in (5, 40)}
    assert selected_counts(df.limit(0), grid).count() == 0


def test_scores(spark):
    counts = spark.createDataFrame([(0, 1, 2, 1, 1), (0, 2, 0, 0, 0)], "config_id int, query_id int, n_pred int, tp int, courts int")
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (4, "c")], "query_id int, citation string")
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "query_id int")
    r = grid_scores(counts, gold, ids).first()
    assert (r["macro_f1"], r["avg_n"], r["court_fraction"]) == (0.625, 0.5, 0.125)
    assert abs(r["objective"] - (0.625 - 0.155 * 0.9 - 0.235)) < 1e-6


def test_long_orders_equal_the_loop(spark):
    """F8: more candidates than are looked at first; some sets are full early, some never."""
    rng = random.Random(9)
    rows = [(q, f"c{i:03d}", 3 + q, q < 2 and rng.random() < (0.2, 0.97)[q] or q == 2 and i < 250, f"b{rng.randint(0, 9)}", rng.randint(0, 1), float(rng.randint(0, 1)), float(rng.randint(0, 1)), (q == 2 and i < 250) + rng.randint(0, 4) / 4) for q in range(3) for i in range(FIRST + 130)]
    df = spark.createDataFrame(rows, "query_id int, citation string, estimate int, court boolean, base string, label int, v7_bonus double, v11_bonus double, x double")
    grid = Grid.of({"v7_bonus": 0.5, "v11_bonus": 0.25, "x": 3.0}, {"v7_bonus": [0.0, 1.0]}, Options(min_output=2, max_output=40), law_per_base=[0, 2], court_per_base=[0, 1], mult=[1.0, 12.0])
    got = {(r["config_id"], r["query_id"]): (r["n_pred"], r["tp"], r["courts"]) for r in selected_counts(df, grid).collect()}
    configs = [grid.config(i) for i in range(len(grid))]
    assert got == {(i, q): _loop([r for r in rows if r[0] == q], [c[n] for n in grid.names], Options(**{k: c[k] for k in vars(Options())})) for i, c in enumerate(configs) for q in range(3)}


def test_first_rows_are_looked_at_first():
    """F8: the first rows of an order give what the whole one gives, wherever they fill the set."""
    rng = np.random.default_rng(4)
    n = 900
    court, label, base, order = rng.random(n) < 0.4, rng.integers(0, 2, n), rng.integers(0, 40, n), np.argsort(rng.random((n, 8)), 0)
    o = Options(court_per_base=2, law_per_base=3)
    few, whole = (_Order(court, label, base, x).taken(o, 30, n) for x in (order[:FIRST], order))
    assert (few[0] == 30).all() and (few == whole).all()
