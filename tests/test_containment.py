"""The join of items and the texts that hold them, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from corpuswell.operators import containment as C
from corpuswell.plans import service


@pytest.mark.parametrize("chunk", [60, 4 << 20])
def test_join_as_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(C, "CHUNK", chunk)
    rng = random.Random(6)
    texts = ["".join(rng.choice("abé中🙂 ") for _ in range(rng.randint(0, 150))) for _ in range(120)] + ["", "a", "ab", None, "aaaaaaaaaa" * 30]
    items = [None, "", "a", "ab", "é", "🙂", "aaa", "aaaaaaaaaa" * 8, "nowhere to be found in any of these texts at all"]
    for n in (3, 5, 9, 17, 33, 60, 90):
        t = rng.choice([x for x in texts if x and len(x) > n])
        at = rng.randint(0, len(t) - n)
        items += [t[at : at + n], t[at : at + n - 1] + "#"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(f"q{k}", i) for k, i in enumerate(items)], "query_id string, item string")
    want = sorted((f"q{k}", d) for k, i in enumerate(items) for d, t in enumerate(texts) if i is not None and t is not None and i in t)
    assert sorted(map(tuple, C.containing(asked, docs).collect())) == want
    only = asked.where("item <> ''")
    assert sorted(map(tuple, C.containing(only, docs).collect())) == [r for r in want if r[0] != "q1"]


def test_empty_tables_and_the_plan(spark):
    docs = spark.createDataFrame([(1, "some text of a document that holds an item in it"), (2, "none")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "document that holds an item")], "query_id long, item string")
    assert C.containing(items.where("false"), docs).collect() == [] and C.containing(items, docs.where("false")).collect() == []
    found = C.containing(items, docs)
    assert [tuple(r) for r in found.collect()] == [(7, 1)]
    plan = C.containing(items, docs)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and ("HashJoin" in plan or "SortMergeJoin" in plan), plan


def test_few_grams_of_long_texts(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh ") for _ in range(20_000))
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string").mapInArrow(C._text_grams([32]), "doc_id long, length int, gram long")
    assert rows.count() < 3 * len(text) / 33
    assert rows.where(F.col("length") != 32).isEmpty()


@pytest.mark.parametrize("sets,step", [(512, 256), (512, 2), (0, 256)])
def test_first_documents_that_hold_all_terms(spark, monkeypatch, sets, step):
    monkeypatch.setattr(C, "SETS", sets)
    monkeypatch.setattr(C, "STEP", step)
    rng = random.Random(8)
    texts = {d: " ".join(rng.choice(["the", "of", "été", "rare" if d % 29 == 0 else "word", "中文", ""]) for _ in range(rng.randint(0, 6))) for d in range(300)}
    rows = [*texts.items(), (None, "the of"), (500, None)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = {1: ["the"], 2: ["the", "été"], 3: ["rare"], 4: [""], 5: ["nowhere"], 6: ["the"], 7: ["of", "the", "rare", "中"]}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, terms array<string>")
    want = sorted((q, d) for q, terms in asked.items() for d in [d for d in sorted(texts) if all(t in texts[d] for t in terms)][:5])
    assert sorted(map(tuple, C.first_holding(queries, docs, 5).collect())) == want


def test_a_term_that_all_texts_hold_makes_few_rows(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the text "), F.col("id").cast("string")).alias("text")).repartition(2)
    part = docs.mapInArrow(C._first([["the"], ["text", "the"], ["4999"]], 20, C.STEP), "terms array<string>, doc_id long")
    assert part.count() <= 2 * (20 + 20) + 1
    queries = spark.createDataFrame([(1, ["the"])], "query_id long, terms array<string>")
    assert sorted(r.doc_id for r in C.first_holding(queries, docs, 20).collect()) == list(range(20))


def test_topics_search_embeds_only_what_it_finds(spark):
    """Of many papers that hold a topic the embedder meets the first twenty."""
    seen = spark.sparkContext.accumulator(0)

    def embed(text):
        @F.udf("array<double>")
        def one(t):
            seen.add(1)
            return [1.0, float(len(t or ""))]

        return one(text)

    papers = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("Title").alias("title"), F.concat(F.lit("common "), F.col("id").cast("string")).alias("abstract"))
    queries = spark.createDataFrame([(1, "common", "a question")], "query_id long, topics string, text string")
    assert service.papers_for(queries, papers, embed).count() == 6
    assert 0 < seen.value < 100
