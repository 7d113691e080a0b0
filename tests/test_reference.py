"""Operators of retrieval and evaluation against hand-worked cases and plain Python."""

import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from corpuswell.functions import text as T
from corpuswell.operators import chunkers, metrics, prompting, ranking, stats, structure, vectors
from corpuswell.plans import experiments, service
from corpuswell.sources import datasets, index

STRUCTURED = """preamble line
Abstract
We say it short.
Abstract
1.1.1 inner
still abstract
1.1 Early
early text
1 Introduction
12 0.5 0.7
1. Intro
body of a table row section
\\section{Method}
m
\\subsection{Data}
d
2.1.3 Deep
deep text
Conclusion
5 Conclusion
the end
6 References
kept
References
gone
1 Never"""


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first().y


def test_scalars(spark):
    assert one(spark, T.search_query, " a ,b c,, d") == 'a "b c" d'
    assert one(spark, T.name_uuid, "fixed_é") == str(uuid.uuid5(uuid.NAMESPACE_DNS, "fixed_é"))
    assert one(spark, T.archive_id, "http://arxiv.org/abs/2101.00001v2") == "2101.00001"
    assert one(spark, T.token_count, "abcdefghi") == 2
    assert one(spark, T.html_escaped, '<a&"b">') == "&lt;a&amp;&quot;b&quot;&gt;"
    assert one(spark, T.words, "A\tb c ") == ["a", "b", "c"]
    assert one(spark, T.without_references, "x" * 50 + "References [1]") == "x" * 50
    assert one(spark, T.without_references, "references" + "x" * 50) == "references" + "x" * 50
    assert one(spark, T.paragraphs, "a\n\n b \n\n\n") == ["a", "b"]
    assert one(spark, T.paragraphs, "a\nb") == ["a\nb"]
    assert len(one(spark, T.paragraphs, "a" * 300 + "\n" + "b" * 300)) == 2
    assert one(spark, lambda c: T.truncated(c, 3), "abcd") == "abc..."
    assert one(spark, T.strategy_label, "SECTION_LEVEL_CHUNKING") == "Section-Level Chunking"
    assert one(spark, T.page_text, "<p>a &amp; b</p><script>x<y</script>\n c") == "a & b c"


def test_parser(spark):
    docs = spark.createDataFrame([(1, STRUCTURED), (2, "just text"), (3, ""), (4, None)], "doc_id long, text string")
    blocks = [(r.block_no, r.block_type, r.section, r.subsection, r.text) for r in structure.parse_blocks(docs.where("doc_id = 1")).orderBy("block_no").collect()]
    assert blocks == [
        (0, "body", None, None, "preamble line"),
        (1, "abstract", "Abstract", None, "We say it short.\nAbstract\n1.1.1 inner\nstill abstract"),
        (2, "subsection", None, "Early", "early text"),
        (3, "section", "0.5 0.7", None, "1. Intro\nbody of a table row section"),
        (4, "section", "Method", None, "m"),
        (5, "subsection", "Method", "Data", "d"),
        (6, "subsection", "Method", "Deep", "deep text\nConclusion"),
        (7, "conclusion", "Conclusion", None, "the end"),
        (8, "section", "References", None, "kept"),
    ]
    rest = {r.doc_id: r.text for r in structure.text_without_abstract(docs).collect()}
    assert rest[2] == "just text" and rest[3] == "" and rest[1].startswith("preamble line\n\nearly text")


def test_parser_keeps_lines_and_rows(spark):
    code = "  code:\n    x = 1\n  \n    y = 2"
    docs = spark.createDataFrame([(1, code), (1, "alpha\nbeta"), (1, "gamma\ndelta"), (None, "Abstract\na\n1 X\nb"), (None, "Abstract\nc")], "doc_id long, text string")
    assert sorted(r.text for r in structure.parse_blocks(docs).where("doc_id = 1").collect()) == sorted([code.strip(), "alpha\nbeta", "gamma\ndelta"])
    assert sorted(r.text for r in structure.text_without_abstract(docs).where("doc_id IS NULL").collect()) == ["Abstract\nc", "b"]
    fixed = chunkers.chunk(docs, "FIXED_WINDOW_OVERLAP").collect()
    assert len(fixed) == 5 and {r.position for r in fixed} == {0}
    assert "Exchange" not in chunkers.chunk(docs, "SECTION_LEVEL_CHUNKING")._jdf.queryExecution().executedPlan().toString()


def pack(paras, carry):
    done, run = [], []
    size = lambda r: sum(len(p) // 4 for p in r)
    for p in paras:
        if len(p) // 4 > 900:
            if run:
                done.append("\n\n".join(run))
            done.append(p)
            run = []
        elif run and size(run) + len(p) // 4 > 900:
            done.append("\n\n".join(run))
            keep = []
            while carry and len(keep) < len(run) and size(run[len(run) - len(keep) - 1 :]) <= 78:
                keep = run[len(run) - len(keep) - 1 :]
            run = [*keep, p]
        else:
            run.append(p)
    return [*done, "\n\n".join(run)] if run else done


def test_structure_aware_packs_and_carries(spark):
    rng = random.Random(1)
    rows = []
    for i in range(30):
        paras = ["".join(rng.choice("abc") for _ in range(rng.choice([40, 311, 312, 315, 316, 900, 2000, 3700]))) for _ in range(rng.randint(1, 14))]
        rows.append((i, "\n\n".join(paras), paras))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {}
    for r in chunkers.chunk(docs, "STRUCTURE_AWARE_OVERLAP").orderBy("doc_id", "position").collect():
        got.setdefault(r.doc_id, []).append(r.chunk_text)
    assert got == {i: pack(p, True) for i, _, p in rows}


def test_other_chunkers(spark):
    sizes = [0, 1, 2200, 2201, 2800, 2801, 5000]
    docs = spark.createDataFrame([(n, "x" * n) for n in sizes], "doc_id long, text string")
    count = {r.doc_id: r["count"] for r in chunkers.chunk(docs, "FIXED_WINDOW_OVERLAP").groupBy("doc_id").count().collect()}
    assert count == {n: (n - 1) // 2200 + 1 for n in sizes if n}
    long = "\n\n".join(["p" * 1400] * 5)
    halves = chunkers.chunk(spark.createDataFrame([(1, long), (2, "q" * 9000)], "doc_id long, text string"), "SECTION_LEVEL_CHUNKING").orderBy("doc_id", "position").collect()
    assert [(r.doc_id, len(r.chunk_text)) for r in halves] == [(1, 2802), (1, 4204), (2, 9000)]
    paras = ["alpha beta gamma", "alpha beta gamma", "delta epsilon zeta", "x", "y", "the References follow", "z"]
    semantic = chunkers.chunk(spark.createDataFrame([(1, "\n\n".join(paras))], "doc_id long, text string"), "SEMANTIC_PARAGRAPH_GROUPING").orderBy("position").collect()
    assert [r.chunk_text for r in semantic] == ["alpha beta gamma\n\nalpha beta gamma", "delta epsilon zeta", "x", "y"]
    with pytest.raises(ValueError):
        chunkers.chunk(docs, "OTHER")
    kept = chunkers.index_chunks(spark.createDataFrame([(1, "w" * 60), (2, "short")], "doc_id long, text string"), "FIXED_WINDOW_OVERLAP", spark.createDataFrame([(1, "about"), (2, "about")], "doc_id long, abstract string"))
    assert sorted((r.doc_id, r.position, r.chunk_id) for r in kept.collect()) == [(1, -1, "1_FIXED_WINDOW_OVERLAP_abstract"), (1, 0, "1_FIXED_WINDOW_OVERLAP_0")]


def test_ranking(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.9, 0.1])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.2])], "vec_id long, embedding array<double>")
    scores = vectors.cosine_scores(q, v)
    assert [r.vec_id for r in ranking.ranked(scores, 3).orderBy("rank").collect()] == [2, 4, 1]
    assert [r.vec_id for r in ranking.mmr(scores, v, 2, 0.3).orderBy("rank").collect()] == [2, 3]
    assert [r.vec_id for r in ranking.mmr(scores, v, 4).orderBy("rank").collect()] == [1, 2, 3, 4]
    assert {r.score for r in ranking.min_max(scores.withColumn("score", F.lit(0.3))).collect()} == {1.0}
    assert [spark.range(1).select(ranking.pool_size(k, F.lit(100))).first()[0] for k in (3, 5, 8, 10, 50)] == [16, 20, 32, 40, 64]
    chunks = spark.createDataFrame([(1, p) for p in (-1, 0, 1, 3)], "doc_id long, position int")
    hits = spark.createDataFrame([(7, 1, 1, 0), (7, 2, 1, 1), (7, 3, 1, 3)], "query_id long, rank int, doc_id long, position int")
    assert [r.position for r in ranking.expand_neighbours(hits, chunks).orderBy("rank").collect()] == [-1, 0, 1, 3]
    assert [r.rank for r in ranking.distinct_sources(hits).collect()] == [1]


def test_bm25(spark):
    import math
    from collections import Counter

    docs = {1: "a b a c", 2: "a", 3: "", 4: "b d d", 5: "a e"}
    query = "a a d zz"
    tokens = {i: t.split() for i, t in docs.items()}
    n, avg = len(docs), sum(map(len, tokens.values())) / len(docs)
    df = Counter(w for t in tokens.values() for w in set(t))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if x < 0 else x for w, x in idf.items()}
    want = {i: sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in query.split()) for i, t in tokens.items()}
    got = ranking.bm25(spark.createDataFrame([(1, query)], "query_id long, text string"), spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    assert {r.doc_id: pytest.approx(r.score) for r in got.collect()} == {i: s for i, s in want.items() if any(w in tokens[i] for w in query.split())}


def test_metrics(spark):
    hits = spark.createDataFrame([(1, 1, "x"), (1, 2, "g"), (1, 3, "g"), (2, 1, "x"), (4, 1, "x")], "query_id long, rank int, paper_id string")
    gold = spark.createDataFrame([(1, "g"), (1, "h"), (2, "g"), (3, "g")], "query_id long, paper_id string")
    similar = spark.createDataFrame([(4, 1, 0.9), (4, 1, 1.2), (2, 1, -0.5)], "query_id long, rank int, similarity double")
    graded = metrics.relevance(hits, gold, similar)
    assert {(r.query_id, r.rank): r.grade for r in graded.collect()} == {(1, 1): 0, (1, 2): 1, (1, 3): 1, (2, 1): 0, (4, 1): 1}
    queries = spark.createDataFrame([(i,) for i in range(1, 5)], "query_id long")
    rows = {r.query_id: tuple(r)[1:] for r in metrics.retrieval_metrics(graded, queries, gold, 4).collect()}
    assert rows[1] == (1.0, 0.5, 0.5, 0.5, pytest.approx((1 / 2 + 2 / 3) / 2))
    assert rows[2] == rows[3] == (0, 0, 0, 0, 0) and rows[4] == (1.0, 1.0, 0.25, 1.0, 1.0)
    assert set(tuple(r)[1:] for r in metrics.retrieval_metrics(graded, queries, gold, 0).collect()) == {(0, 0, 0, 0, 0)}


def test_statistics_reach_published_figures(spark):
    rows = [(name, k, 1.0 if k in ones else 0.0, 0.0) for name, ones in (("p34", {34}), ("p36", {36}), ("three", {1, 2, 3}), ("same", set())) for k in range(49)]
    pairs = spark.createDataFrame(rows, "name string, example_id long, a double, b double")
    boot = {r.name: r for r in stats.paired_bootstrap(pairs, ["name"]).collect()}
    assert round(boot["p34"].p_value, 4) == 0.6293 and round(boot["p36"].p_value, 4) == 0.6228 and round(boot["p34"].hi, 4) == 0.0612
    signed = {r.name: r for r in stats.wilcoxon_p(pairs, ["name"]).collect()}
    assert round(signed["p34"].p_value, 4) == 0.3173 and round(signed["three"].p_value, 4) == 0.0833
    assert signed["same"].statistic == 0 and signed["same"].p_value == 1
    ci = {r.name: r for r in stats.bootstrap_ci(pairs.withColumnRenamed("a", "value"), ["name"]).collect()}
    assert ci["p34"].lo == 0 and round(ci["p34"].hi, 4) == 0.0612


def test_statistics_at_size(spark, monkeypatch):
    import numpy as np

    many = spark.range(3_000_000).select(F.lit("g").alias("name"), F.col("id").alias("example_id"), (F.col("id") % 3 == 0).cast("double").alias("a"), F.lit(0.5).alias("b"))
    row = stats.wilcoxon(many, ["name"]).first()
    assert row.statistic == pytest.approx(1e6 * (3e6 + 1) / 2) and row.z < -100
    values = np.random.default_rng(1).normal(size=37)
    picks = np.random.default_rng(42).integers(0, 37, size=(1000, 37))
    monkeypatch.setattr(stats, "DRAWN", 100)
    assert (stats._means(values, 1000, 42) == values[picks].mean(axis=1)).all()


def plain_mmr(rel, v, k, weight):
    picks = [max(rel, key=lambda i: (rel[i], -i))]
    while len(picks) < k:
        value = lambda i: round(weight * rel[i] - (1 - weight) * max(round(float(v[i] @ v[p]), 9) for p in picks), 9)
        picks.append(max((i for i in rel if i not in picks), key=lambda i: (value(i), -i)))
    return picks


@pytest.mark.parametrize("pool", [8, 256])
def test_mmr_as_brute_force(spark, pool):
    import numpy as np

    rng = np.random.default_rng(2)
    v = rng.normal(size=(150, 6))
    v[100:] = v[:50] + 0.05 * rng.normal(size=(50, 6))  # near copies, which diversity has to pass over
    v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
    table = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    scores = vectors.cosine_scores(table.where("vec_id < 5"), table, exclude_self=True)
    got = {}
    for r in ranking.mmr(scores, table, 8, 0.3, pool).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = {q: plain_mmr({i: round(float(v[q] @ v[i]), 9) for i in range(150) if i != q}, v, 8, 0.3) for q in range(5)}
    assert got == want


def test_block_scores_keep_the_best(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(k, rng.choice([0.0, 0.5, 1.0], 4).tolist()) for k in range(60)] + [(60, None), (61, [0.0] * 4)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    every = vectors.cosine_scores(table.where("vec_id < 7"), table, True)
    monkeypatch.setattr(vectors, "BROADCAST_QUERIES", 2)
    best = vectors.cosine_scores(table.where("vec_id < 7"), table, True, 5)
    top = lambda df: sorted(map(tuple, ranking.ranked(df, 5).collect()))
    assert every.count() == 7 * 61 and top(every) == top(best)


def test_manifest_and_dataset(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"topics": " t ", "question": "q1"}\n\n{"id": "x", "topics": "u", "question": "q2", "gold_passages": ["p"]}\n')
    rows = datasets.read_dataset(spark, str(tmp_path / "d.jsonl"))
    assert [(r.id, r.topics, r.gold_passages) for r in rows.collect()] == [("ex_0", "t", []), ("x", "u", ["p"])]
    (tmp_path / "bad.jsonl").write_text('{"question": "q"}\n')
    with pytest.raises(ValueError):
        datasets.read_dataset(spark, str(tmp_path / "bad.jsonl"))
    manifest = spark.createDataFrame([(0, "x", "u", "q2", ["b"]), (1, "m", "t", "q1", ["b", "a"]), (2, "x", "u", "q2", ["c"])], "ord int, id string, topics string, question string, paper_ids array<string>")
    assert {r.id: r.paper_ids for r in experiments.match_manifest(rows, manifest).collect()} == {"ex_0": ["b", "a"], "x": ["c"]}
    with pytest.raises(ValueError):
        experiments.match_manifest(rows, manifest.where("ord = 0")).collect()
    datasets.write_manifest(manifest, str(tmp_path / "m"), "snap", "2026-01-01T00:00:00")
    assert [(r.ord, r.id) for r in datasets.read_manifest(spark, str(tmp_path / "m")).collect()] == [(0, "x"), (1, "m"), (2, "x")]
    assert [r.paper_id for r in datasets.snapshot_papers(manifest).orderBy("position").collect()] == ["b", "a", "c"]
    assert json.loads(next((tmp_path / "m").glob("part-*")).read_text())["snapshot_id"] == "snap"
    stored = datasets.metadata_strings(spark.createDataFrame([("p", None, 3), ("", "t", 1)], "paper_id string, title string, n int")).collect()
    assert [tuple(r) for r in stored] == [("p", "None", "3")]


def test_index_and_stream(spark, tmp_path):
    from corpuswell.sources.versions import VersionedIndex
    from corpuswell.streaming.ingest import ingest_stream

    head = "h" * 50
    new = spark.createDataFrame([(1, "S", 0, head + "a"), (1, "S", 1, head + "b"), (1, "S", -1, head + "abstract"), (2, "S", 0, "other")], "doc_id long, strategy string, position int, chunk_text string")
    assert sorted((r.doc_id, r.chunk_text[50:]) for r in index.upsert(None, new).collect()) == [(1, "abstract"), (2, "")]
    index.write(new, str(tmp_path / "i"))
    assert index.fetch(spark, str(tmp_path / "i"), "S").count() == 4
    assert index.point_id(new).select("point_id").distinct().count() == 2
    with pytest.raises(ValueError):
        index.check_width(spark.createDataFrame([([1.0],)], "embedding array<double>"), 2)
    schema = "doc_id long, text string"
    for k, text in enumerate(("first " * 20, "second " * 20)):
        spark.createDataFrame([(k, text), (7, f"{text} again")], schema).write.mode("append").json(str(tmp_path / "in"))
        docs = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        ingest_stream(docs, "FIXED_WINDOW_OVERLAP", str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    assert sorted(r.doc_id for r in VersionedIndex(spark, str(tmp_path / "out")).snapshot().collect()) == [0, 1, 7, 7]


def test_service(spark):
    docs = spark.createDataFrame([(k, f"t{k}", f"The {w} paper tells of {w} things. " + f"More words on {w} follow here. " * 3) for k, w in enumerate(["quantum", "retrieval", "graph"])], "doc_id long, title string, text string")
    queries = spark.createDataFrame([(1, "x", "tell of quantum things"), (2, "x", "graph words")], "query_id long, topics string, text string")
    got = {(r.query_id, r.strategy): r for r in service.answer(queries, docs, ("FIXED_WINDOW_OVERLAP", "SECTION_LEVEL_CHUNKING"), k=1).collect()}
    assert got[1, "FIXED_WINDOW_OVERLAP"].answer == "The quantum paper tells of quantum things." and got[2, "SECTION_LEVEL_CHUNKING"].sources[0].title == "t2"
    with pytest.raises(ValueError):
        service.answer(queries.withColumn("topics", F.lit(" ")), docs)
    gold = spark.createDataFrame([(1, 0), (2, 2)], "query_id long, paper_id long")
    scores = service.evaluate(queries, gold, docs, "FIXED_WINDOW_OVERLAP", (1, 2))
    assert scores.count() == 2 * 2 * 2 * 2 * 5 and scores.where("metric = 'hit_at_k' AND value < 1").count() == 0
    html = prompting.transcripts(spark.createDataFrame([(1, 1, "user", "a<b\nc"), (1, 0, "assistant", "hi")], "conv_id long, turn long, role string, text string")).first().html
    assert html.index("hi") < html.index("a&lt;b<br>c")


def test_answer_path_from_topics(spark):
    words_ = ["quantum", "retrieval", "graph"]
    papers = [(k, f"On {w}", f"About {w} systems.", f"The {w} paper tells of {w} things. " + f"More words on {w} follow here. " * 3) for k, w in enumerate(words_)]
    papers.append((9, "On lost", "About lost systems", None))
    papers = spark.createDataFrame(papers, "doc_id long, title string, abstract string, text string")
    queries = spark.createDataFrame([(1, "systems, quantum", "tell of quantum things"), (2, "nothing here", "x"), (3, "lost", "y")], "query_id long, topics string, text string")
    rows = {r.query_id: r for r in service.answer_topics(queries, papers, ("FIXED_WINDOW_OVERLAP",), debug=True).collect()}
    # Few chunks keep the order of storage, in which the abstract is first.
    assert rows[1].answer == "About quantum systems." and [c.position for c in rows[1].debug_context] == [-1, 0]
    assert rows[2].answer == prompting.NO_PAPERS and rows[3].answer == prompting.NONE_LOADED and rows[2].sources == []
    assert rows[1].sources[0].arxiv_url.endswith("/0")


def test_answers_are_asked_again_with_fewer_hits(spark):
    hits = spark.createDataFrame([(q, r, "p", "t", None, f"text {r}") for q in (1, 2) for r in range(1, 9)], "query_id long, rank int, paper_id string, title string, section string, chunk_text string")
    queries = spark.createDataFrame([(1, "short"), (2, "broken")], "query_id long, text string")

    def generate(prompt, context):
        long = (F.length(context) > 120) & F.contains(prompt, F.lit("short"))
        error = F.when(long, F.lit("maximum context length is 120")).when(F.contains(prompt, F.lit("Question: broken")), F.lit("no answer"))
        return F.struct(F.lit("ok").alias("answer"), error.alias("error"))

    got = {r.query_id: (r.answer, r.n_chunks) for r in prompting.answers(hits, queries, generate).collect()}
    assert got == {1: ("ok", 2), 2: ("Error generating response: no answer", 8)}


def test_text_pieces(spark):
    assert one(spark, T.committed_topics, "a, b ,, c") == ["a", "b"] and one(spark, T.committed_topics, "abc") == []
    assert one(spark, lambda c: T.topics_value(T.committed_topics(c), F.lit(" d ")), "a,b,") == "a, b, d"
    assert one(spark, lambda c: T.topics_value(T.committed_topics(c), F.lit(" ")), "a,b,") == "a, b,"
    assert one(spark, lambda c: T.step_line(F.lit(2), c, kept=F.lit(3), k=F.lit(6)), "Filter") == "2. Filter (kept=3 - k=6)"
    assert one(spark, lambda c: T.step_line(F.lit(2), c), "Filter") == "2. Filter"
    assert one(spark, lambda c: T.source_line(F.lit(None).cast("string"), c, F.lit("")), "7") == "[Source: Unknown (arxiv.org/abs/7), Section: -]"
    assert [one(spark, lambda c, k=k: T.page_of(F.lit(k), F.length(c)), "abc") for k in (-1, 1, 7)] == [0, 1, 2]
    sources = spark.sql("SELECT array(named_struct('title', 'T<', 'section', 'Abstract', 'arxiv_url', 'u'), named_struct('title', 'V', 'section', 'S', 'arxiv_url', 'w')) AS s")
    html = sources.select(prompting.message_html(F.lit("assistant"), F.lit("x"), F.col("s")).alias("h")).first().h
    assert "T&lt;</a></li>" in html and '<span class="source-section">(S)</span>' in html
    results = sources.select(F.array(F.struct(F.lit("Label").alias("strategy_label"), F.lit("a\nb").alias("answer"), F.col("s").alias("sources"))).alias("r"))
    shown = results.select(prompting.message_html(F.lit("assistant"), F.lit("x"), None, F.col("r")).alias("h")).first().h
    assert '<h3 class="strategy-title">Label</h3><p class="content">a<br>b</p>' in shown
    assert one(spark, lambda c: prompting.page_html(c, F.lit("body")), "t&").count("t&amp;") == 2


def test_tokens_by_a_rank_file(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from corpuswell.operators import tokens

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = tokens.encoding(path)
    texts = ["One paragraph of words.\n\nAnother one, 1234567!\n\n" + "long words here " * 200, "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.i for r in docs.orderBy("doc_id").select(tokens.token_ids(path, F.col("text")).alias("i")).collect()] == [own.encode_ordinary(texts[0]), [], None]
    windows = [r.chunk_text for r in chunkers.fixed_window(docs, window=50, overlap=10, windows=tokens.token_windows(path)).orderBy("position").collect()]
    ids = own.encode_ordinary(texts[0])
    assert windows == [t for k in range(0, len(ids), 40) if (t := own.decode(ids[k : k + 50]).strip())]
    packed = chunkers.chunk(docs, "STRUCTURE_AWARE_OVERLAP", count=tokens.token_counter(path)).count()
    assert packed == 1 and chunkers.chunk(docs, "SEMANTIC_PARAGRAPH_GROUPING", embed=None).first().strategy == "STRUCTURE_AWARE_OVERLAP"


def test_results_are_written_merged_and_shown(spark, tmp_path):
    from corpuswell.plans import reporting

    configs = spark.createDataFrame([("a", 0, 3, "dense", False), ("b", 1, 5, "hybrid", True)], "config_id string, ord int, top_k int, retrieval_type string, re_ranking boolean")
    rows = [(c, q, m, float(c == "b" and q == 2)) for c in "ab" for q in (1, 2) for m in metrics.METRICS]
    long = spark.createDataFrame(rows, "config_id string, query_id long, metric string, value double")
    intervals = stats.bootstrap_ci(long.withColumnRenamed("query_id", "example_id"), ["config_id", "metric"], resamples=50)
    made = reporting.result_rows(configs, long, intervals)
    reporting.write_results({"phase2": made}, str(tmp_path / "a"), "t1")
    reporting.merge_results(spark, str(tmp_path / "a"), {"phase3": made}, str(tmp_path / "b"), "t2")
    document = json.loads(next((tmp_path / "b").glob("part-*")).read_text())
    assert document["merged_from_created_utc"] == "t1" and document["phase2"] == document["phase3"]
    assert document["phase2"][1]["config"] == {"top_k": 5, "retrieval_type": "hybrid", "re_ranking": True}
    assert document["phase2"][1]["per_query"]["mrr"] == [0.0, 1.0] and document["phase2"][1]["metrics_ci"]["mrr"]["mean"] == 0.5
    assert reporting.first_matching(configs, top_k=5, re_ranking=True).first().config_id == "b" and reporting.first_matching(configs, top_k=4).count() == 0
    tests = spark.createDataFrame([(0, "phase3_baseline_vs_x_hit", "hit_at_k", "org/m_1", 0.01, -0.02, 0.03, 0.04, None)], "ord int, name string, metric string, model string, mean_diff double, lo double, hi double, p_value double, wilcoxon_p double")
    latex = reporting.significance_table(tests).first().latex
    assert "\\texttt{m_1} (Hit@k) & +0.0100 & [-0.0200, +0.0300] & \\textbf{0.0400} & -- \\\\" in latex.replace("\\texttt{m_1}}", "\\texttt{m_1}")
    means = spark.createDataFrame([(0, "A_B", "dense", 10, False, "org/e", 64, 0.5, 0.1, 0.2, 0.3, 0.4), (1, "C", "dense", 10, False, "f", 32, 0.4, 0.1, 0.3, 0.2, 0.1)],
        "ord int, chunking_strategy string, retrieval_type string, top_k int, re_ranking boolean, embedding_model string, embedding_dim int, hit_at_k double, paper_coverage double, precision_at_k double, mrr double, average_precision double")
    one_ = reporting.phase1_table(means).first().latex
    assert "\\texttt{A\\_B} & \\textbf{0.5000} & \\textbf{0.1000} & 0.2000" in one_ and one_.endswith("\\end{table}\n")
    assert "(a b, dense, top-$k=10$, no rerank; fixed judge embedder)" in reporting.phase3_table(means).first().latex
    assert reporting.phase1_table(means.where("false")).collect() == []


def test_stores(spark, tmp_path):
    papers = spark.createDataFrame([("p", "old", 1), ("p", "new", 2), ("", "x", 3)], "paper_id string, title string, n int")
    first = index.save_papers(None, papers, "n")
    assert [(r.paper_id, r.title, r.point_id) for r in first.collect()] == [("p", "new", str(uuid.uuid5(uuid.NAMESPACE_DNS, "paper_p")))]
    again = index.save_papers(first, spark.createDataFrame([("p", "newest", 0), ("q", "t", 0)], "paper_id string, title string, n int"), "n")
    assert sorted((r.paper_id, r.title) for r in again.collect()) == [("p", "newest"), ("q", "t")]
    files = spark.createDataFrame([("s1", "a", bytearray(b"x")), ("s1", "b", bytearray(b"y")), ("s2", "a", bytearray(b"z"))], "snapshot_id string, paper_id string, content binary")
    datasets.write_files(files, str(tmp_path / "f"))
    assert bytes(datasets.stored_file(spark, str(tmp_path / "f"), "s2", "a").first().content) == b"z"
    rest, gone = index.clear_snapshot(files, "s1")
    assert rest.count() == 1 and gone.first().deleted == 2
    index.ensure(spark, str(tmp_path / "t"), "a long")
    index.ensure(spark, str(tmp_path / "t"), "a long")
    with pytest.raises(ValueError):
        index.ensure(spark, str(tmp_path / "t"), "b string")
    manifest = spark.createDataFrame([(0, ["a", "b"]), (1, ["b"]), (2, [])], "ord int, paper_ids array<string>")
    assert tuple(datasets.snapshot_totals(manifest).first()) == (3, 3, 2)
    assert datasets.extracted(files.where("snapshot_id = 's2'"), lambda c: F.decode(c, "UTF-8")).first().text == "z"


def test_models_are_compared_and_broken_ones_skipped(spark):
    docs = spark.createDataFrame([(k, f"The {w} paper tells of {w} things in many words. " * 3) for k, w in enumerate(["quantum", "graph"])], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "x", "quantum things"), (2, "x", "graph")], "query_id long, topics string, text string")
    gold = spark.createDataFrame([(1, 0), (2, 1)], "query_id long, paper_id long")

    def broken(c):
        raise OSError("no such model")

    long, skipped = service.compare_models(queries, gold, docs, "FIXED_WINDOW_OVERLAP", {"base": vectors.hash_embedding, "wide": lambda c: vectors.hash_embedding(c, 128), "none": broken}, 1)
    assert skipped == ["none"]
    pairs = experiments.model_pairs(long, "base")
    assert {(r.name, r.a, r.b) for r in pairs.collect()} == {(f"phase3_baseline_vs_wide_{m}", 1.0, 1.0) for m in ("hit", "map")}


def test_blocks_are_parsed_once(spark):
    """A filter on the size of the array of blocks would hold the whole parser once more."""
    docs = spark.createDataFrame([(1, "1 One\nabc\n\\section{Two}\ndef\n\xa0\t 2.1 Sub\nghi\n\x85BIBLIOGRAPHY\nend"), (2, ""), (3, None)], "doc_id long, text string")
    found = structure.parse_blocks(docs)
    assert [(r.doc_id, r.block_no, r.section, r.subsection, r.text) for r in found.collect()] == [(1, 0, "One", None, "abc"), (1, 1, "Two", None, "def"), (1, 2, "Two", "Sub", "ghi")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1, plan
