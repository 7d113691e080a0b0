"""The search in balls against all scores, and what it leaves out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuswell.operators import balls as B
from corpuswell.operators import ranking, vectors

SCHEMA = "vec_id long, embedding array<double>"


def clustered(n=1500, clusters=12, width=16, spread=0.1, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width))
    return [(k, (centres[k % clusters] + spread * rng.normal(size=width)).tolist()) for k in range(n)]


def rows_of(frame):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in frame.collect())


@pytest.mark.parametrize("spread", [0.1, 3.0])
def test_same_rows_as_all_scores(spark, monkeypatch, spread):
    monkeypatch.setattr(B, "ROWS", 60)
    monkeypatch.setattr(B, "PIVOTS", 24)
    data = clustered(spread=spread) + [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [1.0] * 5), (None, [1.0] * 16), (2004, clustered()[7][1]), (2005, [float("nan")] * 16)]
    table = spark.createDataFrame(data, SCHEMA).repartition(3)
    asked = table.where("vec_id % 50 = 0 OR vec_id > 1999")
    want = rows_of(ranking.ranked(vectors.cosine_scores(asked, table, exclude_self=True), 5))
    assert rows_of(B.nearest(asked, B.balls(table), 5, exclude_self=True)) == want
    monkeypatch.setattr(B, "BROADCAST_QUERIES", 3)
    assert rows_of(B.nearest(asked, B.balls(table), 5, exclude_self=True)) == want


def test_few_rows_and_empty_tables(spark):
    table = spark.createDataFrame(clustered(7), SCHEMA)
    assert rows_of(B.nearest(table, B.balls(table), 20)) == rows_of(ranking.ranked(vectors.cosine_scores(table, table), 20))
    assert B.nearest(table, B.balls(table.where("false")), 3).collect() == [] and B.nearest(table.where("false"), B.balls(table), 3).collect() == []


def test_balls_of_other_clusters_are_left(spark, monkeypatch):
    monkeypatch.setattr(B, "ROWS", 60)
    monkeypatch.setattr(B, "PIVOTS", 48)
    data = clustered(3000)
    table = spark.createDataFrame(data, SCHEMA)
    index = B.balls(table).collect()
    assert sum(len(r["ids"]) for r in index) == 3000 and len(index) < 200
    v = np.array([x for _, x in data])
    v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
    q = v[::100]
    floors = np.sort(q @ v.T, axis=1)[:, -5]
    opened = sum(B.open_balls(q, floors, np.array(r["centre"]), r["reach"]).sum() * len(r["ids"]) for r in index)
    assert opened < 0.3 * len(q) * 3000  # of all products less than a third is made
    for r in index:  # no ball is left that holds one of the five best
        own = np.array(r["ids"])
        holds = (q @ v[own].T).max(axis=1) >= floors
        assert not (holds & ~B.open_balls(q, floors, np.array(r["centre"]), r["reach"])).any()


def test_one_crowded_pivot_makes_several_balls_on_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(B, "ROWS", 50)
    table = spark.range(1000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(0.5)).alias("embedding"))
    index = B.balls(table)
    assert index.count() >= 20 and index.select(F.shiftright("ball", 32)).distinct().count() > 1
    got = rows_of(B.nearest(table.where("vec_id = 7"), index, 3))
    assert [r[2] for r in got] == [0, 1, 2]
