"""Learned selectors in a session that has observed a query, folds, draws and saved models."""

from pyspark.sql import Observation
from pyspark.sql import functions as F

from lexquarry.operators import extra, learn
from lexquarry.plans import base, more

SF = "/root/testdata/sf0.001"


def test_a_model_after_an_observation(spark, tmp_path):
    seen = Observation()
    spark.range(5).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 5
    rows = spark.range(200).select(F.col("id").alias("x"), (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 2 * 3 + 1).cast("double").alias("f"))
    model = learn.fit(rows, ["f"])
    assert {(r.label, r.prob > 0.5) for r in learn.predict(model, rows).collect()} == {(0, False), (1, True)}
    model.write().save(str(tmp_path / "model"))
    again = extra.load_model(str(tmp_path / "model"))
    assert {(r.label, r.prob > 0.5) for r in learn.predict(again, rows).collect()} == {(0, False), (1, True)}


def test_folds(spark):
    queries = spark.range(13).withColumnRenamed("id", "query_id")
    sizes = learn.shuffled_folds(queries, 4).groupBy("fold").count().collect()
    assert {r.fold: r["count"] for r in sizes} == {0: 3, 1: 3, 2: 3, 3: 4}
    assert learn.shuffled_folds(queries.limit(2), 4).count() == 2
    assert sorted(r.fold for r in learn.leave_one_out(queries).collect()) == list(range(13))
    assert learn.leave_one_out(queries.where("false")).count() == 0


def test_drawn_configurations(spark):
    rows = learn.random_configs(spark, 200, 7, a=[1, 2, 3], b=[0.5, 0.25]).collect()
    assert {r.a for r in rows} == {1, 2, 3} and {r.b for r in rows} == {0.5, 0.25} and len({(r.a, r.b) for r in rows}) == 6
    assert rows == learn.random_configs(spark, 200, 7, a=[1, 2, 3], b=[0.5, 0.25]).collect()


def test_each_generation_has_its_own_cut(spark):
    """The list of a generation is what its cutoff leaves of its own rows alone."""
    from lexquarry.operators import fusion, generations

    configs = generations.table(spark)
    rows = generations.scored(more._generation_hits(spark, SF), configs, more._key_statutes(spark, SF))
    estimates = base.queries(spark, SF).withColumn("estimate", F.col("query_id") % 30 + 3)
    got = {}
    for r in generations.cut(rows, estimates).collect():
        got.setdefault(r.generation, set()).add((r.query_id, r.citation))
    alone = {"v1": lambda d: fusion.threshold_walk(d, 0.10, 15, 60), "v4": fusion.gap_elbow, "v5": fusion.knee, "v6": fusion.high_signal_cut, "v7": fusion.smart_cut, "v8": fusion.kind_caps}
    for name, f in alone.items():
        part = rows.where(F.col("generation") == name).join(estimates, "query_id")
        assert got[name] == {(r.query_id, r.citation) for r in f(part).select("query_id", "citation").collect()}, name
    assert set(got) == {r[0] for r in generations.ROWS}


def test_hand_worked_scores_of_generations(spark):
    """A query of two key statutes: what each generation makes of single hits."""
    from lexquarry.operators import generations

    schema = "query_id int, citation string, kind string, source string, score double, rank int, freq int, state string"
    hits = spark.createDataFrame([
        (1, "Art. 1 OR", "law", "bm25", 8.0, 1, 0, "known"), (1, "Art. 2 ZGB", "law", "explicit", 1.0, 1, 0, "known"), (1, "Art. 3 OR", "law", "gpt_specific", 1.0, 1, 0, "known"),
        (1, "Art. 4 OR", "law", "bm25", 4.0, 2, 0, "known"), (1, "Art. 4 OR", "law", "gpt_case", 1.0, 1, 0, "known"), *[(1, f"BGE {r} I 1", "court", "court_dense", 0.5, r, 0, "known") for r in (10, 11, 20, 21, 50, 51, 100, 101)],
    ], schema)
    statutes = spark.createDataFrame([(1, ["OR", "ZGB"])], "query_id int, statutes array<string>")
    got = {(r.generation, r.citation): r.score for r in generations.scored(hits, generations.table(spark), statutes).collect()}
    assert got["v3", "Art. 1 OR"] == 0.91 and got["v4", "Art. 1 OR"] == 0.91 and got["v6", "Art. 1 OR"] == 0.65  # 0.7 * 1.3
    assert got["v3", "Art. 2 ZGB"] == 0.95 and got["v4", "Art. 2 ZGB"] == 0.92  # no keyword hit in v3; all are boosted in v4
    assert got["v3", "Art. 3 OR"] == 0.92 and got["v4", "Art. 3 OR"] == 0.92
    assert got["v3", "Art. 4 OR"] == 0.85 and got["v4", "Art. 4 OR"] == 0.85  # 0.35 * 1.3 against a case that comes in later
    assert [got["v8", f"BGE {r} I 1"] for r in (10, 11, 20, 21, 50, 51, 100, 101)] == [0.68, 0.68, 0.68, 0.6, 0.6, 0.52, 0.52, 0.42]
    assert [got["v11", f"BGE {r} I 1"] for r in (10, 11, 20, 21, 50, 51, 100, 101)] == [0.72, 0.66, 0.66, 0.66, 0.58, 0.5, 0.5, 0.44]


def test_siblings_of_generations(spark):
    """v1 has all siblings of its 15 best decisions, v8 the first three of each."""
    from lexquarry.operators import generations

    rows = spark.createDataFrame([(g, 1, f"BGE {i:02d} I 1", "court", i / 100, i / 100, ["x"], False) for g in ("v1", "v8") for i in range(1, 21)], "generation string, query_id int, citation string, kind string, raw_score double, score double, sources array<string>, is_explicit boolean")
    corpus = spark.createDataFrame([(f"BGE {i:02d} I 1 E. {e:02d}",) for i in range(1, 21) for e in range(30)], "citation string")
    new = generations.with_siblings(rows, corpus, generations.table(spark)).where("citation LIKE '% E. %'")
    n = {r["generation"]: r["count"] for r in new.groupBy("generation").count().collect()}
    assert n == {"v1": 15 * 30, "v8": 20 * 3}


def test_no_window_over_all_hits(spark):
    """the best keyword score of a query is an aggregate, so that no task sorts the hits of all generations."""
    from lexquarry.operators import generations
    from lexquarry.plans import more

    rows = generations.scored(more._generation_hits(spark, SF), generations.table(spark), more._key_statutes(spark, SF))
    assert "Window" not in rows._jdf.queryExecution().optimizedPlan().toString()
