"""Queries against their SQL over texts with lines that look like headings, which the given tables have only when they are larger."""

import duckdb
import pytest

import __spark_entry__
from tests.oracle import rows

TEXTS = [
    "4537960215852590 A card and what is said about it, on the first line of some length.\nAll rights reserved by those who wrote this, and by others.",
    "Before the card.\n  4732588968229808 In the middle stands a line that begins with a number and goes on.\nAfter it, what remains of the text, at some length.",
    "4397110767823743 One line alone that begins with a number, and nothing after it at all.",
    "Abstract\nWhat it is about, in a line that is long enough for a chunk of its own.\n1 Introduction\n" + "Words of the text. " * 300,
    "  \n Plain words with blanks before and after, long enough to be kept in an index. \n",
    "",
    None,
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("prose")
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string").coalesce(1)
    docs.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["chunk_fixed_window", "chunk_semantic", "chunk_all_strategies", "abstract_chunk_union", "payloads", "strategy_scan"])
def test_lines_that_begin_with_numbers(spark, tables, name):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tables}/documents.parquet/*.parquet')")
    want = connection.execute(__spark_entry__.oracle_sql()[name]).df()
    got = __spark_entry__.queries()[name](spark, tables).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(want) > 0
    assert rows(got) == rows(want)


def test_strip_takes_white_space_at_the_ends_only(spark):
    """As the SQL does: a line separator at the end is not white space here, so a blank before it stays."""
    from pyspark.sql import functions as F

    from corpuswell.functions.text import strip

    texts = ["a \u2028", " \x85a b\xa0\n", "\x1c\t", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(strip(F.col("t")).alias("t")).collect()
    assert [r.t for r in rows] == ["a \u2028", "a b", "", "", None]
