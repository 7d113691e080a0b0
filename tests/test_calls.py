"""Calls of a model are made once; chunks of any ids have numbers of their own; errors of jobs are not taken for broken models."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpuswell.operators import prompting, vectors
from corpuswell.plans import service


def counting(folder):
    """A model that notes each call; questions with `long` overflow in contexts of more than two sources, those with `bad` fail."""

    @F.pandas_udf("answer string, error string")
    def model(prompt: pd.Series, context: pd.Series) -> pd.DataFrame:
        out = []
        for p in prompt:
            question, sources = p.split("Question: ")[1].split("\n")[0], p.count("[Source: ")
            with open(f"{folder}/calls", "a") as f:
                f.write(f"{question}|{sources}\n")
            error = f"{prompting.OVERFLOW} is small" if "long" in question and sources > 2 else "no luck" if "bad" in question else None
            out.append((None if error else f"of {sources}", error))
        return pd.DataFrame(out, columns=["answer", "error"])

    return model


def calls(folder):
    path = f"{folder}/calls"
    found = sorted(open(path).read().split("\n")[:-1]) if os.path.exists(path) else []
    open(path, "w").close()
    return found


def hits(spark, n=4):
    rows = [(q, r, f"p{r}", "t", None, f"text of {q} {r}") for q in (1, 2, 3) for r in range(1, n + 1)]
    return spark.createDataFrame(rows, "query_id long, rank int, paper_id string, title string, section string, chunk_text string")


def test_each_call_is_made_once(spark, tmp_path):
    queries = spark.createDataFrame([(1, "a long one"), (2, "a plain one"), (3, "a bad one"), (4, "without hits")], "query_id long, text string")
    found = prompting.answers(hits(spark), queries, counting(tmp_path), most=4)
    for _ in range(2):  # reading the result again calls nothing again
        assert {r.query_id: (r.answer, r.n_chunks) for r in found.collect()} == {1: ("of 2", 2), 2: ("of 4", 4), 3: ("Error generating response: no luck", 4)}
    assert calls(tmp_path) == ["a bad one|4", "a long one|2", "a long one|4", "a plain one|4"]
    still = prompting.answers(hits(spark), queries, counting(tmp_path), most=4, retries=0)
    assert {r.query_id: r.answer for r in still.collect()}[1] == f"Error generating response: {prompting.OVERFLOW} is small"


def test_a_log_saves_calls_of_later_runs(spark, tmp_path):
    queries = spark.createDataFrame([(1, "a long one"), (2, "a plain one")], "query_id long, text string")
    one = prompting.answers(hits(spark), queries, counting(tmp_path), log=str(tmp_path / "log")).collect()
    assert len(calls(tmp_path)) == 3  # five sources at most are the same prompt as ten
    more = queries.unionByName(spark.createDataFrame([(3, "another")], "query_id long, text string"))
    two = prompting.answers(hits(spark), more, counting(tmp_path), log=str(tmp_path / "log")).collect()
    assert calls(tmp_path) == ["another|4"] and {tuple(r) for r in one} < {tuple(r) for r in two}


def test_a_plain_answer_and_equal_prompts(spark, tmp_path):
    prompts = spark.createDataFrame([(k, 1, f"p{k % 2}", "c") for k in range(6)], "query_id long, n_chunks int, prompt string, context string")
    rows = prompting.calls(prompts, lambda p, c: F.concat(p, c)).collect()
    assert sorted((r.query_id, r.answer, r.error) for r in rows) == [(k, f"p{k % 2}c", None) for k in range(6)]


PAPERS = "doc_id long, title string, abstract string, text string"


def test_topics_are_answered_with_retries_and_errors(spark, tmp_path):
    body = " ".join(f"The owl number {k} of the wood sleeps all day." for k in range(120))
    papers = spark.createDataFrame([(1 << 44, "Owls", "owls of the wood", body), (1 << 45, "More owls", "owls of the wood again", body + " End."), (3, "Lost", "nothing loaded", None)], PAPERS)
    queries = spark.createDataFrame([(1, "owls", "a long one on owls"), (2, "owls, wood", "a bad one on the wood"), (3, "bees", "no paper"), (4, "nothing loaded", "not loaded")], "query_id long, topics string, text string")
    found = service.answer_topics(queries, papers, ("FIXED_WINDOW_OVERLAP",), counting(tmp_path))
    got = {r.query_id: (r.answer, len(r.sources)) for r in found.collect()}
    assert got[1] == ("of 2", 2) and got[2] == ("Error generating response: no luck", 2)
    assert got[3] == (prompting.NO_PAPERS, 0) and got[4] == (prompting.NONE_LOADED, 0)
    made = calls(tmp_path)
    assert len(made) == len(set(made)) and sum("bad" in c for c in made) == 1


def test_chunks_of_large_ids_and_positions_have_their_own_numbers(spark):
    rows = [(1 << 44, 0), (1 << 45, 0), (5, 1 << 20), (6, 0), (-1, 3), ((1 << 62) + 1, 1 << 30)]
    chunks = spark.createDataFrame([(d, p, None, f"chunk text number {k}") for k, (d, p) in enumerate(rows)], "doc_id long, position int, section string, chunk_text string")
    queries = spark.createDataFrame([(1, "chunk text number")], "query_id long, text string")
    found = service.retrieve(queries, chunks, k=10, diverse=False, expand=False).collect()
    assert sorted((r.doc_id, r.position) for r in found) == sorted(rows)
    assert [(r.doc_id, r.position) for r in sorted(found, key=lambda r: r.rank) if r.doc_id in (5, 6)] == sorted((d, p) for d, p in rows if d in (5, 6))


def test_only_models_that_do_not_load_are_broken(spark):
    docs = spark.createDataFrame([(k, "the owl of the wood sleeps all day long " * 3) for k in range(3)], "doc_id long, text string")
    queries, gold = spark.createDataFrame([(1, "owl")], "query_id long, text string"), spark.createDataFrame([(1, 0)], "query_id long, paper_id long")

    def absent(c):
        raise FileNotFoundError("no such model")

    failing = lambda c: F.when(F.length(c) > 0, F.raise_error(F.lit("disk full"))).otherwise(vectors.hash_embedding(c))
    scores, broken = service.compare_models(queries, gold, docs, "FIXED_WINDOW_OVERLAP", {"absent": absent, "good": vectors.hash_embedding})
    assert broken == ["absent"] and {r.config_id for r in scores.collect()} == {"good"}
    with pytest.raises(Exception, match="disk full"):
        service.compare_models(queries, gold, docs, "FIXED_WINDOW_OVERLAP", {"failing": failing, "good": vectors.hash_embedding})
