"""Window forms of selection against sequential loops, and sources and sinks."""

import random

from pyspark.sql import functions as F

from lexquarry.operators import learn, metrics, select
from lexquarry.sources import io
from lexquarry.streaming import cache


def _rows(seed, n):
    rng = random.Random(seed)
    return [(q, f"{'Art.' if rng.random() < 0.5 else 'BGE'} {i}", rng.randint(0, 9) / 10) for q in range(4) for i in range(n)]


def test_greedy(spark):
    for seed in range(3):
        rows = _rows(seed, 12)
        df = spark.createDataFrame(rows, "query_id int, citation string, prob double").withColumn("kind", F.when(F.col("citation").startswith("Art."), "law").otherwise("court"))
        got = {(r.query_id, r.citation) for r in select.greedy(df, F.lit(6), F.lit(2), F.lit(0.5), F.lit(4)).collect()}
        want = set()
        for q in range(4):
            n = courts = 0
            for _, c, p in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1])):
                if n >= 6 or p < 0.5 and n >= 4:
                    break
                if c.startswith("BGE"):
                    if courts >= 2:
                        continue
                    courts += 1
                n += 1
                want.add((q, c))
        assert got == want


def test_f1_edges(spark):
    p = spark.createDataFrame([(2, "a"), (2, "b")], "query_id int, citation string")
    g = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "query_id int, citation string")
    q = spark.createDataFrame([(0,), (1,), (2,)], "query_id int")
    assert {r.query_id: r.f1 for r in metrics.per_query(p, g, q).collect()} == {0: 1.0, 1: 0.0, 2: 0.5}
    assert {r.query_id: r.f1 for r in metrics.per_query(p, g, q, metrics.F1(over="predictions")).collect()} == {2: 0.5}


def test_grid(spark):
    rows = learn.grid(spark, a=[1, 2], b=[0.5, 0.7]).orderBy("config_id").collect()
    assert [(r.a, r.b) for r in rows] == [(1, 0.5), (1, 0.7), (2, 0.5), (2, 0.7)]


def test_round_trip(spark, tmp_path):
    p = spark.createDataFrame([("q1", "b"), ("q1", "a"), ("q2", "c")], "query_id string, citation string")
    io.write_predictions(p, str(tmp_path / "out"))
    back = io.explode_predictions(spark.read.csv(str(tmp_path / "out"), header=True))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, p.collect()))
    io.write_stage(p, str(tmp_path), "select", {"k": 1})
    assert spark.read.parquet(str(tmp_path / "select")).count() == 3
    assert io.append_pending(p, str(tmp_path / "done")) == 2 and io.append_pending(p, str(tmp_path / "done")) == 0


def test_shards_and_cache(spark, tmp_path):
    for shard, label in (("train_1", "x"), ("train_2", "y")):
        spark.createDataFrame([("q1", label)], "query_id string, label string").write.parquet(str(tmp_path / shard))
    pattern = str(tmp_path / "train_*")
    assert io.read_shards(spark, pattern, "first").first().label == "x"
    assert io.read_shards(spark, pattern, "last").first().label == "y"
    (tmp_path / "cache.jsonl").write_text('{"key":"a","created_at":1,"label":"x"}\nbroken\n{"key":"a","created_at":2,"label":"y"}\n{"label":"z"}\n')
    rows = io.read_cache(spark, str(tmp_path / "cache.jsonl"), "key string, created_at double, label string").collect()
    assert [(r.key, r.label) for r in rows] == [("a", "y")]


def test_csv_and_json(spark, tmp_path):
    (tmp_path / "laws.csv").write_text('citation,text\n"Art. 1 OR","two\nlines, ""quoted"""\n')
    assert io.read_corpus(spark, str(tmp_path / "laws.csv")).first().text == 'two\nlines, "quoted"'
    (tmp_path / "m.json").write_text('{"q1": {"n": 3}, "q2": {"n": 4}}')
    assert sorted((r.query_id, r.value.n) for r in io.read_json_map(spark, str(tmp_path / "m.json"), "struct<n:int>").collect()) == [("q1", 3), ("q2", 4)]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "key string, created_at bigint, label string"
    for i, label in enumerate(("x", "y")):
        (tmp_path / "in" / f"{i}.json").write_text(f'{{"key":"a","created_at":{i},"label":"{label}"}}\n')
        cache.follow(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.count() == 2 and cache.latest(rows).first().label == "y"
