"""Hybrid search by segments against the join of all pairs; counts of matching documents; what is handed on."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuswell.operators import postings, ranking, vectors
from corpuswell.staging import staged


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.4, rng.integers(0, 30)) % 60) for _ in range(400)]
    texts[7], texts[9], texts[11] = None, "", texts[10]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    asked = [(0, "w1 w2 w3"), (1, "w5 w5 w40 w1"), (2, "nowhere"), (3, ""), (4, texts[20])]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    with_vectors = lambda df: df.withColumn("embedding", vectors.hash_embedding(F.coalesce("text", F.lit("")), 16))
    return with_vectors(docs), with_vectors(queries)


def best(scores, k):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 7)) for r in ranking.ranked(scores, k, "doc_id").collect())


@pytest.mark.parametrize("weight", [0.5, 0.2])
def test_as_over_all_pairs(spark, tables, monkeypatch, weight):
    monkeypatch.setattr(postings, "SEGMENT", 900)
    monkeypatch.setattr(postings, "STEP", 20)
    docs, queries = tables
    dense = vectors.cosine_scores(queries.withColumnRenamed("query_id", "vec_id"), docs.withColumnRenamed("doc_id", "vec_id")).withColumnRenamed("vec_id", "doc_id")
    want = best(ranking.hybrid(dense, ranking.bm25(queries, docs.select("doc_id", "text")), weight), 7)
    found = ranking.hybrid_search(queries, docs, 7, weight)
    assert best(found, 7) == want and len(want) == 35
    assert found.count() < 5 * 400


def test_groups_of_queries(spark, tables, monkeypatch):
    docs, queries = tables
    want = best(ranking.hybrid_search(queries, docs, 5), 5)
    monkeypatch.setattr(postings, "QUERY_WORDS", 3)
    assert best(ranking.hybrid_search(queries, docs, 5), 5) == want


def test_no_documents(spark, tables):
    docs, queries = tables
    assert ranking.hybrid_search(queries, docs.where("doc_id < 0"), 5).count() == 0


def test_matches(spark, tables):
    docs, queries = tables
    plain = docs.select("doc_id", "text")
    want = {r.query_id: r["count"] for r in ranking.bm25(queries, plain).groupBy("query_id").count().collect()}
    assert {r.query_id: r.n for r in ranking.matches(staged(postings.segments(plain), "postings"), queries).collect()} == want


def test_queries_make_no_table_of_all_pairs(spark):
    """What the searches of the catalogue hand on is bounded by segments, blocks and k."""
    from corpuswell.plans import catalogue as C

    sf = "/root/testdata/sf0.001"
    pairs = C._docs(spark, sf).count() * C._items(spark, sf).count()
    assert C._dense_docs(spark, sf, 8).count() < pairs / 2 and C._hybrid_docs(spark, sf, 8).count() < pairs / 2


@pytest.mark.parametrize("most", [100, 1])
def test_scaled_where_scores_are_made(spark, monkeypatch, most):
    monkeypatch.setattr(vectors, "BLOCK", 5)
    monkeypatch.setattr(vectors, "BROADCAST_QUERIES", most)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(40)] + [(40, [0.0] * 4), (41, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = table.where("vec_id % 10 = 0 OR vec_id = 41")
    plan = vectors.scaled_scores(asked, table, True)
    assert "Window" not in plan._jdf.queryExecution().toString() and "Aggregate" not in plan._jdf.queryExecution().toString()
    key = lambda df: sorted((r.query_id, r.vec_id, round(r.score, 9)) for r in df.collect())
    assert key(plan) == key(ranking.min_max(vectors.cosine_scores(asked, table, True)))


def test_minmax_norm_writes_no_pairs_before_its_result(spark, monkeypatch):
    from corpuswell.plans import catalogue as C

    monkeypatch.setattr(ranking, "staged", lambda *_: pytest.fail("all pairs are staged"))
    assert C.minmax_norm(spark, "/root/testdata/sf0.001").count() == 12475
