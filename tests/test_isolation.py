"""A row that fails leaves the others; jobs that fail still fail."""

import os

import pytest
from pyspark.sql import functions as F

from corpuswell.operators.isolation import isolated
from corpuswell.plans.papers import store_papers
from corpuswell.sources.versions import VersionedIndex


def halves(row):
    if row["n"] == 13:
        raise ValueError("unlucky")
    return {"half": "thirty" if row["n"] == 30 else row["n"] // 2, "name": f"n{row['n']}"}


def test_failures_are_named_and_the_rest_goes_on(spark, tmp_path):
    rows = spark.range(40).select((F.col("id") % 4).alias("k"), F.col("id").alias("n"), F.lit(None).cast("string").alias("other")).repartition(3)
    done, bad = isolated(rows, ["n"], halves, "half long, name string")
    assert sorted((r.n, r.half, r.name) for r in done.collect()) == [(n, n // 2, f"n{n}") for n in range(40) if n not in (13, 30)]
    told = {r.n: (r.error, r.where) for r in bad.collect()}
    assert set(told) == {13, 30} and told[13][0] == "ValueError: unlucky" and told[13][1].startswith("halves:") and "Arrow" in told[30][0]
    assert isolated(rows.where("false"), ["n"], halves, "half long, name string")[0].collect() == []


def test_each_row_is_worked_on_once(spark, tmp_path):
    def note(row):
        with open(f"{tmp_path}/seen", "a") as f:
            f.write(f"{row['id']}\n")
        return {"x": 1 // (row["id"] % 5)}

    done, bad = isolated(spark.range(20), ["id"], note, "x long")
    for _ in range(2):
        assert done.count() == 16 and bad.count() == 4
    assert sorted(map(int, open(f"{tmp_path}/seen").read().split())) == list(range(20))


def test_job_failures_are_raised(spark):
    failing = spark.range(5).withColumn("n", F.when(F.col("id") == 3, F.raise_error(F.lit("disk full"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="disk full"):
        isolated(failing, ["id"], halves, "half long, name string")
    with pytest.raises(ValueError, match="n"):
        isolated(failing, ["id"], halves, "n long")


def test_one_bad_paper_leaves_the_others(spark, tmp_path):
    def extract(content):
        if content.startswith(b"%broken"):
            raise ValueError("no text in it")
        if content == b"kill":
            os._exit(1)
        return content.decode()

    good = ("The paper tells of owls that sleep all day in the old wood. " * 3).encode()
    papers = [(1, "About owls.", good), (2, "Lost.", b"%broken file"), (3, "Short.", b"too short"), (4, "Nothing.", None), (5, None, good + b"More."), (6, "Odd bytes.", b"\xff\xfe")]
    frame = spark.createDataFrame(papers, "doc_id long, abstract string, content binary").repartition(2)
    index = VersionedIndex(spark, str(tmp_path / "index"), 2)
    rows = {(r.doc_id, r.strategy): (r.stored, r.reason) for r in store_papers(frame, extract, index, ("FIXED_WINDOW_OVERLAP", "SECTION_LEVEL_CHUNKING"), "b1").collect()}
    assert len(rows) == 12
    for s in ("FIXED_WINDOW_OVERLAP", "SECTION_LEVEL_CHUNKING"):
        assert [rows[k, s] for k in (1, 3, 4, 5)] == [(True, None), (False, "no chunk"), (False, "no content"), (True, None)]
        assert rows[2, s] == (False, "ValueError: no text in it") and rows[6, s][1].startswith("UnicodeDecodeError")
        held = index.snapshot(strategy=s)
        assert {r.doc_id for r in held.collect()} == {1, 5} and held.where("position = -1").count() == 1
    store_papers(frame, extract, index, ("FIXED_WINDOW_OVERLAP",), "b1")
    assert index.version() == 0
