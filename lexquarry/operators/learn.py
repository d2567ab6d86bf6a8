"""Features, priors, folds, parameter sweeps and learned selectors."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.functions import text as fn
from lexquarry.operators.metrics import numbered, per_query
from lexquarry.sources.scratch import scratch


def inverse_rank(rank: Column) -> Column:
    return F.when(rank > 0, 1.0 / (1.0 + rank)).otherwise(0.0)


def base_features(candidates: DataFrame, sources: list[str]) -> DataFrame:
    """candidates with one-hot kinds and sources, inverse ranks and counts."""
    flags = {f"src_{s}": F.array_contains("sources", s).cast("int") for s in sources}
    return candidates.withColumns({"is_law": (F.col("kind") == "law").cast("int"), "inv_dense": F.round(inverse_rank(F.col("dense_rank")), 6), "inv_bm25": F.round(inverse_rank(F.col("bm25_rank")), 6), "n_sources": F.size("sources")} | flags)


def relative_features(candidates: DataFrame, score: str = "raw_score") -> DataFrame:
    """candidates with their place and share within their query."""
    q = Window.partitionBy("query_id")
    n = F.count("*").over(q)
    pct = (F.row_number().over(q.orderBy(F.asc(score), F.asc("citation"))) - 1) / F.greatest(n - 1, F.lit(1))
    return candidates.withColumns({"pool": n, "score_pct": F.round(pct, 6), "to_best": F.round(F.col(score) / F.max(score).over(q), 6), "laws_in_pool": F.count_if(F.col("kind") == "law").over(q)})


def priors(gold: DataFrame) -> DataFrame:
    """(level, key, n): how often a citation, a base and a statute are gold."""
    c = F.col("citation")
    keys = F.array(F.struct(F.lit("exact").alias("level"), c.alias("key")), F.struct(F.lit("base").alias("level"), F.when(fn.is_law(c), fn.law_base_by_tokens(c)).otherwise(fn.court_base(c)).alias("key")), F.struct(F.lit("code").alias("level"), fn.statute_code(c).alias("key")))
    return gold.select(F.explode(keys).alias("k")).where("k.key <> ''").groupBy("k.level", "k.key").agg(F.count("*").alias("n"))


#: Golds of a query from which it is dense, and of a sparse one.
DENSE, SPARSE = 10, (7, 9)


def prior_channels(gold: DataFrame, first: DataFrame, second: DataFrame, predicted: DataFrame) -> DataFrame:
    """(channel, level, key, n): counts of citations and law bases, over gold sets and over predictions of chosen queries.

    `all` and `dense` (queries with DENSE golds or more) count gold citations; the
    channels dense100 (the ids in `first`), dense12 (dense ones in `second`) and
    sparse79 (those in `second` with SPARSE golds) count predictions, an id in the
    first channel that takes it.
    """
    sizes = gold.groupBy("query_id").agg(F.count("*").alias("golds"))
    own = gold.join(sizes, "query_id").select("citation", F.explode(F.when(F.col("golds") >= DENSE, F.array(F.lit("all"), F.lit("dense"))).otherwise(F.array(F.lit("all")))).alias("channel"))
    a, b = first.select("query_id").distinct().withColumn("a", F.lit(1)), second.select("query_id").distinct().withColumn("b", F.lit(1))
    asked = a.join(b, "query_id", "full").join(sizes, "query_id", "left")
    channel = F.when(F.col("a") == 1, "dense100").when(F.col("golds") >= DENSE, "dense12").when(F.col("golds").between(*SPARSE), "sparse79")
    given = predicted.join(asked.select("query_id", channel.alias("channel")).where("channel IS NOT NULL"), "query_id").select("citation", "channel")
    c = F.col("citation")
    keys = F.array(F.struct(F.lit("exact").alias("level"), c.alias("key")), F.struct(F.lit("law_base").alias("level"), F.when(fn.is_law(c), fn.law_base_by_tokens(c)).alias("key")))
    return own.unionByName(given.select(own.columns)).select("channel", F.explode(keys).alias("k")).where("k.key <> ''").groupBy("channel", "k.level", "k.key").agg(F.count("*").alias("n"))


def labelled(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    marks = gold.select("query_id", "citation", F.lit(1).alias("label")).distinct()
    return candidates.join(marks, ["query_id", "citation"], "left").fillna(0, ["label"])


def stratified_folds(gold: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, n_gold, fold): queries in order of their number of gold citations, dealt round."""
    n = queries.select("query_id").distinct().join(gold.groupBy("query_id").agg(F.count("*").alias("n_gold")), "query_id", "left").fillna(0, ["n_gold"])
    return numbered(n, [F.col("n_gold"), F.col("query_id")]).select("query_id", "n_gold", (F.col("row") % k).cast("int").alias("fold"))


def shuffled_folds(queries: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """(query_id, fold): queries in an order drawn by a seed, in k blocks of one size; what remains goes to the last."""
    rows = numbered(queries.select("query_id").distinct(), [F.md5(F.concat_ws(":", F.lit(seed), "query_id")), F.col("query_id")])
    return rows.select("query_id", F.least(F.floor(F.col("row") / F.greatest(F.floor(F.col("rows") / k), F.lit(1))), F.lit(k - 1)).cast("int").alias("fold"))


def leave_one_out(queries: DataFrame) -> DataFrame:
    """(query_id, fold): every query is a fold."""
    return numbered(queries.select("query_id").distinct(), [F.col("query_id")]).select("query_id", F.col("row").cast("int").alias("fold"))


def random_configs(spark, n: int, seed: int, **options: list) -> DataFrame:
    """n rows drawn from lists of values, with config_id; the draws come from a linear congruence, the same in any engine."""
    out = spark.range(n).select(F.col("id").cast("int").alias("config_id"))
    for place, (name, values) in enumerate(options.items()):
        draw = F.expr(f"(((config_id * 7919L + {place} * 104729 + {seed}) * 1103515245L + 12345) % 2147483648L) DIV 65536 % {len(values)}")
        out = out.withColumn(name, F.element_at(F.array(*[F.lit(v) for v in values]), (draw + 1).cast("int")))
    return out


def meta_sweep(scored: DataFrame, gold: DataFrame, queries: DataFrame, configs: DataFrame) -> DataFrame:
    """(config_id, query_id, f1) as sweep(), with a target and a court cap that follow each query's estimate.

    configs has target_mult, bias, min_out, max_out, thresh, court_cap_frac; one
    whose max_out is below its min_out takes no part.
    """
    configs = configs.where("max_out >= min_out")
    sizes = scored.groupBy("query_id").agg(F.max("estimate").alias("estimate")).crossJoin(F.broadcast(configs))
    target = F.least(F.col("max_out"), F.greatest(F.col("min_out"), F.bround(F.col("estimate") * F.col("target_mult") + F.col("bias")).cast("int")))
    sizes = sizes.withColumn("target", target).withColumn("court_cap", F.greatest(F.lit(0), F.bround(F.col("target") * F.col("court_cap_frac")).cast("int")))
    return _sweep(scored, gold, queries, configs, sizes.select("config_id", "query_id", "target", "thresh", "min_out", "court_cap"))


def stratified_best(per: DataFrame, strata: DataFrame) -> DataFrame:
    """(stratum, config_id, mean_f1): the best configuration of each stratum of queries (query_id, stratum)."""
    means = per.join(strata, "query_id").groupBy("stratum", "config_id").agg(F.round(F.avg("f1"), 8).alias("mean_f1"))
    first = F.row_number().over(Window.partitionBy("stratum").orderBy(F.desc("mean_f1"), "config_id"))
    return means.withColumn("n", first).where("n = 1").drop("n")


def grid(spark, **values: list) -> DataFrame:
    """A row for each combination, with config_id in order of the arguments."""
    out = None
    for name, options in values.items():
        table = spark.createDataFrame([(i, v) for i, v in enumerate(options)], f"i_{name} int, {name} {'double' if isinstance(options[0], float) else 'int'}")
        out = table if out is None else out.crossJoin(F.broadcast(table))
    w = Window.orderBy(*[f"i_{n}" for n in values])
    return out.withColumn("config_id", F.row_number().over(w) - 1).drop(*[f"i_{n}" for n in values])


def sweep(scored: DataFrame, gold: DataFrame, queries: DataFrame, configs: DataFrame) -> DataFrame:
    """(config_id, query_id, f1) of every configuration in one job.

    configs has target, thresh, min_out, court_cap.  A configuration's sets are
    never written out: each candidate is ranked once, and what a configuration
    keeps are counts over these ranks.
    """
    return _sweep(scored, gold, queries, configs, None)


def _sweep(scored: DataFrame, gold: DataFrame, queries: DataFrame, configs: DataFrame, sizes: DataFrame | None) -> DataFrame:
    """A query's candidates are one array, best first, each with its rank among the courts.

    What a configuration keeps is the beginning of what its court cap leaves of the
    array, so candidates are shuffled once, whatever the number of configurations.
    """
    order = [F.desc("prob"), F.asc("citation")]
    marks = labelled(scored.select("query_id", "citation", "kind", "prob"), gold)
    court_rank = F.when(F.col("kind") == "court", F.row_number().over(Window.partitionBy("query_id", "kind").orderBy(*order))).otherwise(0)
    ranks = marks.withColumn("court_rank", court_rank).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    lists = ranks.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "court_rank", "prob", "label"))).alias("all"))
    every = lists.crossJoin(F.broadcast(configs)) if sizes is None else lists.join(sizes, "query_id")  # a row for each query and configuration
    left = F.filter("all", lambda x: x["court_rank"] <= F.col("court_cap"))
    sure = lambda rows: F.size(F.filter(rows, lambda x: x["prob"] >= F.col("thresh")))
    count = lambda rows: F.greatest(F.lit(0), F.least(F.col("target"), F.size(rows), F.greatest(sure(rows), F.col("min_out")))).cast("int")
    right = lambda rows, n: F.aggregate(F.slice(rows, F.lit(1), n), F.lit(0), lambda s, x: s + x["label"])
    got = every.select("config_id", "query_id", fn.let(left, lambda rows: fn.let(count(rows), lambda n: F.struct(n.alias("n_pred"), right(rows, n).alias("tp")))).alias("got")).select("config_id", "query_id", "got.n_pred", "got.tp")
    size = queries.select("query_id").distinct().join(gold.groupBy("query_id").agg(F.count_distinct("citation").alias("n_gold")), "query_id", "left").fillna(0, ["n_gold"])
    rows = size.crossJoin(F.broadcast(configs.select("config_id"))).join(got, ["config_id", "query_id"], "left").fillna(0, ["n_pred", "tp"])
    empty = (F.col("n_pred") == 0) & (F.col("n_gold") == 0)
    return rows.select("config_id", "query_id", F.when(empty, 1.0).otherwise(F.round(2 * F.col("tp") / (F.col("n_pred") + F.col("n_gold")), 6)).alias("f1"))


def best_config(per: DataFrame) -> DataFrame:
    """(config_id, mean_f1) of the first configuration with the best mean."""
    means = per.groupBy("config_id").agg(F.round(F.avg("f1"), 8).alias("mean_f1"))
    return means.orderBy(F.desc("mean_f1"), "config_id").limit(1)


def cross_validated(per: DataFrame, folds: DataFrame) -> DataFrame:
    """(fold, config_id, train_f1, test_f1): the best configuration of the other folds, on each fold."""
    rows = per.join(folds.select("query_id", "fold"), "query_id")
    sums = rows.groupBy("config_id", "fold").agg(F.sum("f1").alias("s"), F.count("*").alias("n"))
    w = Window.partitionBy("config_id")
    sums = sums.withColumns({"train": F.round((F.sum("s").over(w) - F.col("s")) / (F.sum("n").over(w) - F.col("n")), 6), "test": F.round(F.col("s") / F.col("n"), 6)})
    pick = F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("train"), "config_id"))
    return sums.withColumn("r", pick).where("r = 1").select("fold", "config_id", F.col("train").alias("train_f1"), F.col("test").alias("test_f1"))


MODELS: dict[str, Callable] = {
    "forest": lambda: RandomForestClassifier(labelCol="label", featuresCol="features", weightCol="weight", numTrees=20, maxDepth=5, seed=7),
    "boosted": lambda: GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", maxIter=10, maxDepth=4, seed=7),
}


def fit(rows: DataFrame, features: list[str], model: str = "forest"):
    """A pipeline model of labelled rows; positives weigh as much as all others.

    It is saved and loaded: a fresh model's summary holds the session, which
    can't go to executors once the session has observed a query.
    """
    share = rows.agg(F.avg("label").alias("p"))
    weighed = rows.crossJoin(F.broadcast(share)).withColumn("weight", F.when(F.col("label") == 1, 0.5 / F.greatest("p", F.lit(1e-6))).otherwise(0.5 / F.greatest(1 - F.col("p"), F.lit(1e-6)))).drop("p")
    fresh = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), MODELS[model]()]).fit(weighed)
    path = f"{scratch(rows.sparkSession).root}/model-{uuid.uuid4().hex}"
    fresh.write().save(path)
    return PipelineModel.load(path)


def predict(model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("prob", F.round(vector_to_array("probability")[1], 6)).drop("features", "rawPrediction", "probability", "prediction")


def out_of_fold(rows: DataFrame, folds: DataFrame, features: list[str], k: int, model: str = "forest") -> DataFrame:
    """Every row scored by a model of the other folds.  The rows are written once, for all fits and scores."""
    held, out = scratch(rows.sparkSession).keep(rows.join(folds.select("query_id", "fold"), "query_id"), "folds"), None
    for i in range(k):
        part = predict(fit(held.where(F.col("fold") != i), features, model), held.where(F.col("fold") == i))
        out = part if out is None else out.unionByName(part)
    return out


__all__ = ["base_features", "best_config", "cross_validated", "fit", "grid", "inverse_rank", "labelled", "out_of_fold", "per_query", "predict", "priors", "relative_features", "stratified_folds", "sweep"]
