"""The bound of the sequence ratio."""

import random

from pyspark.sql import functions as F

from lexquarry.operators import resolve


def test_bound_holds_and_filters(spark):
    rng = random.Random(5)
    some = ["Art. 221 Abs. 1 lit. b StPO", "Art. 221 Abs. 1 StPO", "Art. 221 StPO", "", "aaab", "baaa", "äöü a"]
    some += ["".join(rng.choice("abc 1") for _ in range(rng.randint(1, 12))) for _ in range(25)]
    pairs = spark.createDataFrame([(a, b) for a in some for b in some], "citation string, match string")
    rows = pairs.withColumn("r", resolve.sequence_ratio("citation", "match")).withColumn("bound", resolve.ratio_bound(F.col("citation"), F.col("match")))
    assert rows.where("r > bound + 1e-9").count() == 0
    likely = resolve.likely_matches(pairs, 0.75)
    good = {tuple(x) for x in rows.where("r >= 0.75").select("citation", "match").collect()}
    assert good <= {tuple(x) for x in likely.collect()} and likely.count() < pairs.count()
