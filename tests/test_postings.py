"""The inverted index against a plain scorer."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpuswell.operators import postings as P


def plain(queries, docs, k=None):
    """query, document, score, from dictionaries; ties to smaller ids."""
    listed = [(i, (t or "").lower().split()) for i, t in docs]
    n, mean = len(listed), max(sum(len(w) for _, w in listed), 1) / max(len(listed), 1)
    df = Counter(w for _, ws in listed for w in set(ws))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    usual = sum(idf.values()) / len(idf) if idf else 0
    out = []
    for q, text in queries:
        found = []
        for i, ws in listed:
            tf = Counter(ws)
            own = [w for w in text.lower().split() if w in tf]
            if own:
                score = sum((0.25 * usual if idf[w] < 0 else idf[w]) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ws) / mean)) for w in own)
                found.append((-round(score, 9), i))
        out += [(q, i, -s) for s, i in (sorted(found)[:k] if k else found)]
    return sorted(out)


def near(got, want):
    assert [r[:2] for r in got] == [r[:2] for r in want] and [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=1e-8)


def some_docs(n=300, seed=2):
    rng = random.Random(seed)
    word = lambda: f"w{min(int(rng.expovariate(0.03)), 400)}" if rng.random() < 0.8 else "the"
    return [(k, " ".join(word() for _ in range(rng.randint(0, 60)))) for k in range(n)]


QUERIES = [(1, "the w1 w2 w2"), (2, "w7 w300 unknown"), (3, "The the the"), (4, ""), (5, " ".join(f"w{k}" for k in range(40)))]


@pytest.mark.parametrize("segment", [400, 2_000_000])
@pytest.mark.parametrize("k", [None, 1, 5])
def test_search_as_plain_okapi(spark, monkeypatch, segment, k):
    monkeypatch.setattr(P, "SEGMENT", segment)
    monkeypatch.setattr(P, "STEP", 8)
    docs = some_docs() + [(900, None), (901, " \n")]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = P.bm25(spark.createDataFrame(QUERIES, "query_id long, text string"), table, k)
    rows = sorted(map(tuple, got.collect()))
    if k:  # each segment gives its k best
        best = {}
        for q, i, s in rows:
            best.setdefault(q, []).append((-s, i))
        rows = sorted((q, i, -s) for q, found in best.items() for s, i in sorted(found)[:k])
    near(rows, plain(QUERIES, docs, k))


def test_names_of_other_types_ties_and_empty_tables(spark):
    docs = [(f"d{k % 10}-{k}", f"same words here {'rare' if k % 9 == 0 else ''}") for k in range(40)]
    queries = [("a", "rare words"), ("b", "same")]
    table, asked = spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(queries, "query_id string, text string")
    near(sorted(map(tuple, P.bm25(asked, table.coalesce(1), 3).collect())), plain(queries, docs, 3))
    near(sorted(map(tuple, P.bm25(asked, table).collect())), plain(queries, docs))
    assert P.bm25(asked, table.where("false")).collect() == [] and P.bm25(asked.where("false"), table).collect() == []


def test_queries_in_groups(spark, monkeypatch):
    monkeypatch.setattr(P, "QUERY_WORDS", 4)
    docs = some_docs(60)
    got = P.bm25(spark.createDataFrame(QUERIES, "query_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"))
    near(sorted(map(tuple, got.collect())), plain(QUERIES, docs))


def test_added_documents_make_segments_of_their_own(spark, tmp_path):
    docs, path = some_docs(), str(tmp_path / "index")
    one, two = (spark.createDataFrame(d, "doc_id long, text string") for d in (docs[:200], docs[200:]))
    before = {r.segment for r in P.write_index(one, path).where("term IS NULL").collect()}
    index = P.write_index(two, path, "append")
    after = [r.segment for r in index.where("term IS NULL").collect()]
    assert before < set(after) and len(after) == len(set(after))
    near(sorted(map(tuple, P.search(index, spark.createDataFrame(QUERIES, "query_id long, text string")).collect())), plain(QUERIES, docs))


def test_reading_stops_by_the_bounds():
    rng = np.random.default_rng(1)
    listed = [["hot"] * int(tf) + ["filler"] * int(n) + (["rare"] if k % 50 == 0 else []) for k, (tf, n) in enumerate(zip(rng.zipf(2.0, 4000).clip(1, 60), rng.integers(5, 60, 4000)))]
    rows = list(P._segment(0, pa.array(range(4000)), pa.array(listed)))
    own = P.Postings(pa.Table.from_batches(rows))
    mean = float(np.mean([len(x) for x in listed]))
    for terms, weights, share in ((["hot"], [1.0], 0.3), (["hot", "filler"], [1.0, 0.1], 0.8), (["rare", "hot"], [5.0, 0.2], 1)):
        every, scores, all_read = own.best(terms, weights, mean, None)
        found, best, read = own.best(terms, weights, mean, 5)
        top = np.lexsort((every, -scores))[:5]
        assert found.tolist() == every[top].tolist() and best.tolist() == scores[top].tolist()
        assert read <= share * all_read  # what a rare word may add keeps the other's blocks open
    # A weight below zero makes what is known no lower bound, so all is read.
    assert own.best(["rare", "hot"], [-1.0, 0.2], mean, 5)[2] == own.best(["rare", "hot"], [-1.0, 0.2], mean, None)[2]
    # Blocks of a term fall in what bounds them.
    for blocks in own.terms.values():
        assert sum(len(b[2]) // 4 for b in blocks) == sum(1 for x in listed if next(t for t, o in own.terms.items() if o is blocks) in x)


def test_hits_of_chunks_are_looked_up_once(spark):
    """What is made of the hits meets no table of chunks again."""
    from corpuswell.plans import catalogue

    hits, _ = catalogue._chunk_hits(spark, "/root/testdata/sf0.001")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and {"query_id", "rank", "doc_id", "position", "section", "chunk_text"} <= set(hits.columns)


def test_blocks_are_decoded_once_for_all_queries():
    rows = pa.Table.from_batches(list(P._segment(0, pa.array([1, 2, 3]), pa.array([["a", "b"], ["a"], ["b", "b"]]))))
    own = P.Postings(rows)
    first = own.best(["a", "b"], [1.0, 2.0], 5 / 3, 2)
    assert own.blocks("a", 5 / 3) is own.blocks("a", 5 / 3) and len(own.decoded) == 2
    again = own.best(["a", "b"], [1.0, 2.0], 5 / 3, 2)
    assert first[0].tolist() == again[0].tolist() and first[1].tolist() == again[1].tolist()


ODD = ["", " ", "\u0085", "one", " a\u00a0b\u0085c ", "\x1cx\x1f\x1fy\x0b", "\u00c2 \u00e9t\u00c9\u00a0\u0130\u2003z", None, "A\tB\nC\r\fD", "\u4e2d\u6587 \U0001f600", "end "]


def test_words_of_texts_by_their_bytes(spark):
    """Tasks take whole texts and find the words that the column function finds."""
    from pyspark.sql import functions as F

    from corpuswell.functions.text import words

    text = F.coalesce("text", F.lit(""))
    rows = spark.createDataFrame(list(enumerate(ODD)), "n int, text string").select("n", F.lower(text).alias("low"), words(text).alias("words")).toArrow().sort_by("n")
    low, want = rows["low"].combine_chunks(), rows["words"].to_pylist()
    for lo in range(len(want) + 1):
        assert P._listed(low.slice(lo)).to_pylist() == want[lo:] and P._listed(low.slice(0, lo)).to_pylist() == want[:lo]
    asked = spark.createDataFrame([(1, "a b x"), (2, "z one")], "query_id long, text string")
    assert {(r.query_id, r.doc_id) for r in P.bm25(asked, spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")).collect()} == {(1, 4), (1, 5), (1, 8), (2, 3)}


def test_postings_hold_no_lengths_and_all_scores_are_looked_at_where_it_may_tell(monkeypatch):
    rng = random.Random(5)
    listed = [[w for w in "abcdefgh" for _ in range(rng.randint(0, 3))] or ["a"] for _ in range(1500)]
    rows = pa.Table.from_batches(list(P._segment(0, pa.array(range(1500)), pa.array(listed))))
    assert rows.filter(pa.compute.is_valid(rows["term"]))["dls"].null_count == len(rows) - 1
    own, mean, looks = P.Postings(rows), float(np.mean([len(x) for x in listed])), []
    every, scores, _ = own.best(list("abcdefgh"), [1.0] * 8, mean, None)
    whole = np.partition
    monkeypatch.setattr(np, "partition", lambda x, k: (looks.append(len(x)), whole(x, k))[1])
    found, best, _ = own.best(list("abcdefgh"), [1.0] * 8, mean, 6)
    top = np.lexsort((every, -scores))[:6]
    assert found.tolist() == every[top].tolist() and best.tolist() == scores[top].tolist()
    assert len(looks) < 8 * 2  # of 4 for each of 8 words


def test_all_terms_are_counted_in_one_pass(spark, tmp_path):
    """Of the terms only what is asked for is kept, and one row for the others."""
    index = P.write_index(spark.createDataFrame(some_docs(), "doc_id long, text string"), str(tmp_path / "index"))
    asked, kept = spark.createDataFrame(QUERIES, "query_id long, text string"), {}
    own = P.staged
    with pytest.MonkeyPatch.context() as m:
        m.setattr(P, "staged", lambda df, name: kept.setdefault(name, own(df, name)))
        near(sorted(map(tuple, P.search(index, asked).collect())), plain(QUERIES, some_docs()))
    words = {w for _, t in QUERIES for w in t.lower().split()}
    rows = kept["weights"].collect()
    assert {r.term for r in rows} == {r.term for r in index.select("term").distinct().collect() if r.term in words} | {None}
    assert sum(r.n for r in rows) == index.where("term IS NOT NULL").select("term").distinct().count()


def test_chunks_are_stored_for_the_papers_of_hits_only(spark):
    from corpuswell.plans import catalogue

    hits, chunks = catalogue._chunk_hits(spark, "/root/testdata/sf0.001")
    papers = {r.doc_id for r in hits.select("doc_id").collect()}
    every = catalogue._windows(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).select("doc_id", "position", "chunk_text")
    want = sorted(tuple(r) for r in every.collect() if r.doc_id in papers)
    assert sorted(map(tuple, chunks.select("doc_id", "position", "chunk_text").collect())) == want and every.count() > len(want)


def test_papers_without_an_id_and_of_one_id_keep_their_hits(spark, tmp_path):
    from corpuswell.plans import catalogue

    docs = [(None, "lonely words of a paper that has no name but has fifty characters"), (1, "first words of a paper that shares its name with another, long enough"), (1, "second of the papers that share a name and is long enough as well ..."), (2, "nothing of that kind, only other terms, yet of more than fifty letters")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, "lonely words"), (8, "second shares")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    hits, _ = catalogue._chunk_hits(spark, str(tmp_path))
    got = {(r.query_id, r.doc_id, r.chunk_text.split()[0]) for r in hits.collect()}
    assert got == {(7, None, "lonely"), (7, 1, "first"), (7, 1, "second"), (8, 1, "first"), (8, 1, "second")}
