"""Resamples that are dealt to tasks against one generator's."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuswell.operators import stats, vectors
from corpuswell.plans import experiments


@pytest.mark.parametrize("n", [2, 7, 49, 1000, 3_000_000_001])
def test_picks_are_those_of_one_generator(n):
    want = np.random.default_rng(42).integers(0, n, size=2000)
    got = np.concatenate([stats.picks(42, b, n, 512) for b in range(20)])
    assert len(got) >= 2000 and (got[:2000] == want).all()  # of three thousand millions many numbers are thrown away
    assert n < 3e9 or len(got) < 0.8 * 20 * 512


def test_dealt_groups_as_whole_ones(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(g, k, float(rng.normal(g or 0)), float(rng.normal())) for g, n in ((1, 400), (2, 3), (None, 250), (4, 1)) for k in rng.permutation(n).tolist()]
    table = spark.createDataFrame(rows, "g int, example_id long, a double, b double").repartition(3)
    one = lambda: {r.g: tuple(r)[1:] for r in stats.bootstrap_ci(table.withColumn("value", F.col("a")), ["g"], resamples=200).collect()}
    two = lambda: {r.g: tuple(r)[1:] for r in stats.paired_bootstrap(table, ["g"], resamples=200).collect()}
    whole = one(), two()
    monkeypatch.setattr(stats, "DRAWN", 1024)
    for got, want in zip((one(), two()), whole):
        assert set(got) == set(want) and all(got[g] == pytest.approx(want[g], rel=1e-12) for g in want)


def test_one_large_group_runs_on_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(stats, "DRAWN", 1 << 16)
    table = spark.range(100_000).select(F.lit("all").alias("g"), F.col("id").alias("example_id"), (F.col("id") % 101).cast("double").alias("value"))
    found = stats.bootstrap_ci(table, ["g"], resamples=20).collect()[0]
    v = np.arange(100_000) % 101.0
    lo, hi = np.percentile(v[np.random.default_rng(42).integers(0, 100_000, size=(20, 100_000))].mean(axis=1), [2.5, 97.5])
    assert (found.mean, found.lo, found.hi) == pytest.approx((v.mean(), lo, hi), rel=1e-12)
    blocks = stats._dealt_means(table.select("g", F.col("example_id").alias("_o"), F.col("value").alias("_v")), ["g"], 20, 42)
    assert "block" in blocks._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_draws_have_tasks_of_their_own(spark, monkeypatch):
    """Rows of blocks are small, so that adaptive execution would join them to one task."""
    monkeypatch.setattr(stats, "DRAWN", 1 << 12)
    table = spark.range(2000).select(F.lit("all").alias("g"), F.col("id").alias("_o"), (F.col("id") % 101).cast("double").alias("_v"))
    plan = stats._dealt_means(table, ["g"], 200, 42)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and "REPARTITION_BY_COL" not in plan


def test_a_sweep_is_searched_once(spark):
    rows = spark.range(60).select(F.col("id").alias("vec_id"), (F.col("id") % 3).cast("int").alias("label"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    queries = rows.where("vec_id % 20 = 0")
    gold = queries.select(F.col("vec_id").alias("query_id"), F.col("label").alias("paper_id"))
    sweep = experiments.dense_sweep(vectors.cosine_scores(queries, rows, True, 10), rows, gold, (3, 5))
    assert "MapInArrow" not in sweep._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("held", [1, 4_000_000])
@pytest.mark.parametrize("later", [False, True])
def test_a_task_hands_on_the_best_of_all_its_blocks(spark, monkeypatch, later, held):
    monkeypatch.setattr(vectors, "HELD", held)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rows = spark.range(500).coalesce(1).select(F.col("id").alias("vec_id"), F.array(F.sin(F.col("id") % 40), F.cos(F.col("id") % 40)).alias("embedding"))
    queries = rows.where("vec_id % 50 = 0")
    best = vectors.cosine_scores(queries, rows, True, 7, later).toPandas()
    every = vectors.cosine_scores(queries, rows, True).toPandas()
    order = [False, not later]
    top = lambda df: df.sort_values(["score", "vec_id"], ascending=order).groupby("query_id").head(7).sort_values(["query_id", "vec_id"]).to_numpy().tolist()
    assert top(best) == top(every) and len(best) == 7 * 10
