"""Selection for diversity straight from vectors, against a plain loop over all candidates; what tasks hand on."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuswell.operators import ranking, vectors
from tests.test_reference import plain_mmr


def table_of(spark, v, parts=3):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(parts)


@pytest.mark.parametrize("pool", [8, 64])
@pytest.mark.parametrize("copies", [1, 3])
def test_as_over_all_candidates(spark, pool, copies):
    v = np.repeat(np.random.default_rng(5).normal(size=(150 // copies, 8)), copies, axis=0)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    table = table_of(spark, v)
    got = {}
    for r in ranking.diverse(table.where("vec_id < 5"), table, 8, 0.3, True, pool).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: plain_mmr({i: round(float(v[q] @ v[i]), 9) for i in range(len(v)) if i != q}, v, 8, 0.3) for q in range(5)}


def test_few_candidates_and_dealt_queries(spark, monkeypatch):
    v = np.eye(4)[[0, 1, 2, 3]]
    table = table_of(spark, v)
    want = [(q, n + 1, i) for q in range(4) for n, i in enumerate(x for x in range(4) if x != q)]
    assert sorted(map(tuple, ranking.diverse(table, table, 8, exclude_self=True).collect())) == want
    monkeypatch.setattr(vectors, "BROADCAST_QUERIES", 1)
    assert sorted(map(tuple, ranking.diverse(table, table, 8, exclude_self=True).collect())) == want


def test_tasks_hand_on_pools_only():
    rng = np.random.default_rng(1)
    best, seen = ranking._Best(3, 5), []
    for lo in range(0, 4000, 100):
        ids, bound = np.arange(lo, lo + 100), np.round(rng.normal(size=(3, 100)), 1)
        best.add(ids, bound * 2, bound)
        seen.append(bound)
    every = np.concatenate(seen, axis=1)
    who, ids, score, bound = best.settle()
    assert len(who) == 15 and all(list(ids[who == q]) == list(np.lexsort((np.arange(4000), -every[q]))[:5]) for q in range(3))
    assert (score == 2 * bound).all()


def test_best_of_blocks_with_ties_to_later_rows(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 4)
    table = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(30)], "vec_id long, embedding array<double>")
    asked = table.where("vec_id = 0")
    got = vectors.cosine_scores(asked, table, k=2, later=True)
    assert got.count() < 30
    best = [r.vec_id for r in got.orderBy(F.desc("score"), F.desc("vec_id")).limit(2).collect()]
    assert best == [27, 24]


def test_pools_do_not_grow(spark, monkeypatch):
    """Each pass goes on from the choices made, also where nearly all candidates are worth about as much."""
    made, bounds = [], ranking._bounds
    monkeypatch.setattr(ranking, "_bounds", lambda most, *rest: made.append(most) or bounds(most, *rest))
    v = np.random.default_rng(7).normal(size=(400, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    table, got = table_of(spark, v), {}
    for r in ranking.diverse(table.where("vec_id < 3"), table, 6, 0.3, True, 8).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: plain_mmr({i: round(float(v[q] @ v[i]), 9) for i in range(len(v)) if i != q}, v, 6, 0.3) for q in range(3)}
    assert set(made) == {9} and len(made) <= 6


def test_null_vectors_may_be_chosen(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in ranking.diverse(table.where("vec_id = 0"), table, 2, 0.7).orderBy("rank").collect()] == [0, 1]
