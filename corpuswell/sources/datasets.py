"""Readers and writers of evaluation inputs: JSONL datasets, manifests, papers, stored files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuswell.config import SETTINGS as S
from corpuswell.functions.text import strip

_EXAMPLE = "id string, topics string, question string, gold_passages array<string>"
MANIFEST = "snapshot_id string, created_utc string, arxiv_search_max_results long, abstract_filter_top_k long, queries array<struct<id: string, topics: string, question: string, paper_ids: array<string>>>"


def read_dataset(spark: SparkSession, path: str, validate: bool = True) -> DataFrame:
    """id, topics, question, gold_passages of a JSONL file. Blank lines are skipped but count: a row without id is
    `ex_` and its line number, from 0. Raises ValueError where topics or question are blank, unless validate is off.

    The file is one text value (a dataset is a list of questions, written by hand), so that lines have numbers.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "raw")).where(strip(F.col("raw")) != "")
    rows = lines.select("line", F.from_json("raw", _EXAMPLE).alias("r")).select(
        F.coalesce("r.id", F.concat(F.lit("ex_"), F.col("line").cast("string"))).alias("id"), strip(F.coalesce("r.topics", F.lit(""))).alias("topics"),
        strip(F.coalesce("r.question", F.lit(""))).alias("question"), F.coalesce("r.gold_passages", F.array().cast("array<string>")).alias("gold_passages"),
    )
    if validate and (bad := rows.where("topics = '' OR question = ''").take(5)):
        raise ValueError(f"topics and question are needed in {[r['id'] for r in bad]}")
    return rows


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """ord, id, topics, question, paper_ids of a manifest's queries."""
    return spark.read.schema(MANIFEST).json(path, multiLine=True).select(F.posexplode("queries").alias("ord", "q")).select("ord", "q.*")


def write_manifest(queries: DataFrame, path: str, snapshot_id: str, created_utc: str) -> None:
    """Writes queries (ord, id, topics, question, paper_ids) as a manifest, a single JSON object."""
    listed = queries.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id", "topics", "question", "paper_ids"))), lambda q: F.struct(q["id"].alias("id"), q["topics"].alias("topics"), q["question"].alias("question"), q["paper_ids"].alias("paper_ids"))).alias("queries"))
    head = listed.select(F.lit(snapshot_id).alias("snapshot_id"), F.lit(created_utc).alias("created_utc"), F.lit(S.search_results).alias("arxiv_search_max_results"), F.lit(S.abstracts_kept).alias("abstract_filter_top_k"), "queries")
    head.coalesce(1).write.mode("overwrite").json(path)


def read_files(spark: SparkSession, path: str, suffix: str = ".pdf") -> DataFrame:
    """paper_id, content of the files in a folder, named by paper."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.substring(name, F.lit(1), F.length(name) - len(suffix)).alias("paper_id"), "content")


def search_papers(papers: DataFrame, terms: list[str], most: int = S.search_results) -> DataFrame:
    """Papers whose title or abstract holds all terms, the first `most` by paper_id: a stand-in for a remote search."""
    text = F.lower(F.concat_ws(" ", "title", "abstract"))
    found = F.lit(True)
    for t in terms:
        found = found & F.contains(text, F.lit(t.lower()))
    return papers.where(found).orderBy("paper_id").limit(most)


def metadata_strings(papers: DataFrame) -> DataFrame:
    """Metadata as it is stored: all but arrays and structs as strings, null as `None`; rows without paper_id leave."""
    simple = {f.name for f in papers.schema.fields if f.dataType.typeName() not in ("array", "struct", "map")}
    return papers.where("coalesce(paper_id, '') <> ''").select(*[F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(c) if c in simple else F.col(c) for c in papers.columns])


def snapshot_papers(manifest: DataFrame) -> DataFrame:
    """Distinct papers of a snapshot, each once, in the order in which queries first name them."""
    first = manifest.select("ord", F.posexplode("paper_ids").alias("k", "paper_id")).groupBy("paper_id").agg(F.min(F.struct("ord", "k")).alias("f"))
    return first.select("paper_id", (F.row_number().over(Window.orderBy("f")) - 1).alias("position"))


def snapshot_totals(manifest: DataFrame) -> DataFrame:
    """One row: queries, papers named in all, and unique papers of a manifest (ord, paper_ids)."""
    named = manifest.select("ord", F.explode_outer("paper_ids").alias("paper_id"))
    return named.agg(F.count_distinct("ord").alias("queries"), F.count("paper_id").alias("named"), F.count_distinct("paper_id").alias("unique_papers"))


def write_files(files: DataFrame, path: str) -> None:
    """Stores files (snapshot_id, paper_id, content) by snapshot and paper; those of a snapshot that is written replace it."""
    files.select("snapshot_id", "paper_id", "content").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(path)


def stored_file(spark: SparkSession, path: str, snapshot_id: str, paper_id: str) -> DataFrame:
    """The content of a stored file: a partition filter and a pushed one."""
    return spark.read.parquet(path).where((F.col("snapshot_id") == snapshot_id) & (F.col("paper_id") == paper_id)).select("content")


def extracted(files: DataFrame, extract: Callable[[Column], Column]) -> DataFrame:
    """paper_id, text of files (paper_id, content): extract is a column function of the bytes; what it cannot read is empty."""
    return files.select("paper_id", F.coalesce(extract(F.col("content")), F.lit("")).alias("text"))
