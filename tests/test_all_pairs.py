"""Scores of all pairs: rounded where they are made, and dealt evenly."""

import numpy as np
from pyspark.sql import functions as F

from corpuswell.operators import vectors
from corpuswell.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_rounded_as_columns_are(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=3000) / 4, np.arange(-2000, 2000) / 2e3 + 5e-7, np.arange(-300, 300) * 5e-7, np.nextafter(np.arange(1, 200) / 1e3 + 5e-7, 0), [0.0, -0.0, 1.0, -1.0, -1e-9]])
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "k int, v double")
    for digits in (6, 2):
        want = [r.v for r in df.select("k", F.round("v", digits).alias("v")).orderBy("k").collect()]
        got = vectors.half_up(x.reshape(-1, 1), digits)[:, 0]
        assert got.tolist() == want and not np.signbit(got[got == 0]).any()


def test_cosine_scores_are_rounded_in_tasks(spark):
    found = catalogue.cosine_scores(spark, SF)
    assert "round(" not in found._jdf.queryExecution().optimizedPlan().toString()
    plain = vectors.cosine_scores(catalogue._queries(spark, SF), catalogue._vectors(spark, SF), True).withColumn("score", F.round("score", 6))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))


def test_blocks_for_many_queries_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 5)
    table = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(60)], "vec_id long, embedding array<double>").coalesce(1)
    one = vectors.cosine_scores(table, table, True)
    monkeypatch.setattr(vectors, "MANY_QUERIES", 50)
    many = vectors.cosine_scores(table, table, True)
    assert (one.rdd.getNumPartitions(), many.rdd.getNumPartitions()) == (1, 4)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect())) and many.count() == 60 * 59


def test_more_queries_than_before_are_broadcast(spark):
    """Of 64 numbers each, as many as the bytes allow: nothing is copied to each group."""
    ids = spark.range(25_000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    found = vectors.cosine_scores(ids, ids.limit(2))
    assert "BroadcastNestedLoopJoin" in found._jdf.queryExecution().executedPlan().toString()


def test_minmax_norm_is_rounded_in_tasks(spark):
    found = catalogue.minmax_norm(spark, SF)
    assert "round(" not in found._jdf.queryExecution().optimizedPlan().toString()
    plain = vectors.scaled_scores(catalogue._queries(spark, SF), catalogue._vectors(spark, SF), True).withColumn("score", F.round("score", 6))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))
