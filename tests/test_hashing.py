"""Hashed embeddings and what is made of them, against plain Python; numbers of chunks."""

import hashlib
import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuswell.operators import chunkers, containment, listing, vectors
from corpuswell.plans import service


def plain(text, width):
    counts = [0] * width
    for w in (text or "").lower().split():
        counts[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % width] += 1
    norm = math.sqrt(sum(c * c for c in counts))
    return [c / norm if norm else 0.0 for c in counts]


def test_hashes_of_words_of_all_lengths():
    words = [("aé" * n)[:n] for n in range(90)] + ["€" * 18, "€" * 19]
    want = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in words]
    assert listing.hashed(pa.array(words)).tolist() == want and listing.hashed(pa.array(words).slice(50, 9)).tolist() == want[50:59]
    assert len(listing.hashed(pa.array([], pa.string()))) == 0


@pytest.mark.parametrize("width", [4, 64, 200])
def test_embedding_in_batches(spark, monkeypatch, width):
    monkeypatch.setattr(vectors, "TEXT_BYTES", 40)
    texts = [None, "", "  ", "a b A", "one two one\nthree " * 9, "x" * 70 + " y", "\u00e9t\u00e9 \u00c9T\u00c9"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").coalesce(1)
    found = df.select("k", vectors.hash_embedding(F.col("text"), width).alias("v"))
    assert {r.k: r.v for r in found.collect()} == {k: plain(t, width) for k, t in enumerate(texts)}
    assert "ArrowEvalPython" in found._jdf.queryExecution().toString()


def test_likeness_of_neighbours(spark):
    rows = [(0, ["a b", "b a", None, "c", "c d"]), (1, []), (2, None), (3, ["x"])]
    df = spark.createDataFrame(rows, "k int, t array<string>")
    got = {r.k: r.v for r in df.select("k", vectors.hash_likeness(F.col("t")).alias("v")).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(plain(a, 64), plain(b, 64)))
    assert got[1] == [] and got[2] is None and len(got[3]) == 1
    assert got[0][1:] == pytest.approx([dot(a, b) for a, b in zip(rows[0][1], rows[0][1][1:])])


def test_chunkers_make_arrays_once(spark):
    """What stands beside paragraphs and blocks is not made again for each of them."""
    docs = spark.createDataFrame([(1, "a b\n\nc d")], "doc_id long, text string")
    for strategy in ("SEMANTIC_PARAGRAPH_GROUPING", "STRUCTURE_AWARE_OVERLAP", "SECTION_LEVEL_CHUNKING"):
        assert "[0][lambda" not in chunkers.chunk(docs, strategy)._jdf.queryExecution().optimizedPlan().toString(), strategy


def test_likeness_as_with_vectors(spark):
    text = "\n\n".join(["the owl sleeps all day", "the owl sleeps all the day", "bees make honey", "bees make more honey", "end"])
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = lambda **o: [r.chunk_text for r in chunkers.semantic_paragraphs(docs, **o).orderBy("position").collect()]
    each = F.udf(lambda t: [plain(x, 64) for x in t], "array<array<double>>")
    assert rows() == rows(embed_all=each) and len(rows()) == 3


def test_numbers_of_chunks_need_no_sort(spark):
    docs = spark.createDataFrame([(d, "some words\n\nand more " * 40) for d in (-5, 70, 3)], "doc_id long, text string")
    chunks = chunkers.chunk(docs, "FIXED_WINDOW_OVERLAP").unionByName(chunkers.chunk(docs, "SECTION_LEVEL_CHUNKING").withColumn("position", F.col("position") + 90))
    items = service._items(chunks, vectors.hash_embedding, service._number(docs))
    assert "Exchange" not in items._jdf.queryExecution().executedPlan().toString()
    rows = items.select("vec_id", "doc_id", "position").collect()
    assert len({r.vec_id for r in rows}) == len(rows) > 3
    assert sorted(rows) == sorted(rows, key=lambda r: (r.doc_id, r.position))


def test_ids_that_give_no_numbers(spark):
    of = lambda ids, kind="long": service._number(spark.createDataFrame([(i, "t") for i in ids], f"doc_id {kind}, text string"))
    assert of([1, 2]) is not None and of([1, 1]) is None and of([1, None]) is None and of([]) is None
    assert of(["a"], "string") is None and of([-(1 << 62), 1 << 62]) is None


def test_containing_shuffles_no_texts(spark):
    items = spark.createDataFrame([(1, "an owl sleeps in the wood all day")], "query_id long, item string")
    docs = spark.createDataFrame([(k, f"text {k} " + ("an owl sleeps in the wood all day" if k % 7 == 0 else "")) for k in range(50)], "doc_id long, text string")
    found = containment.containing(items, docs)
    assert sorted(r.doc_id for r in found.collect()) == list(range(0, 50, 7))
    assert "BroadcastHashJoin" in found._jdf.queryExecution().sparkPlan().toString()
