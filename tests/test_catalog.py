"""Every registered query against DuckDB on the smallest tables."""

import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lexquarry.plans import catalog

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
#: Queries whose values are rounded or ranked by sums of many terms.
ROUNDED = ["agent_gather", "bm25_okapi", "bm25_topk", "cocitation_expand", "dense_topk", "features_boosted", "fuzzy_ratio", "generation_scores", "grid_sweep", "hybrid_score", "perturb_triple_scores", "random_search", "robust_objective", "select_forced"]


def _views(folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.fixture(scope="module")
def db():
    return _views(SF)


def _plain(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return v if v is None or isinstance(v, int) else str(v)


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple(str(x) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    _compare(spark, db, name, SF)


@pytest.mark.parametrize("name", ROUNDED)
def test_query_on_more_rows(spark, name):
    _compare(spark, _views(LARGER), name, LARGER)


def test_no_query_is_vacuous():
    """Every query with SQL returns rows on the larger tables."""
    db = _views(LARGER)
    for name, sql in entry.oracle_sql().items():
        assert db.execute(sql).fetchone() is not None, name


def _compare(spark, db, name, sf):
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = _sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    out = db.execute(sql)
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == _sorted(tuple(_plain(r[i]) for i in at) for r in out.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "tp", "n_pred", "n_gold", "f1"]
