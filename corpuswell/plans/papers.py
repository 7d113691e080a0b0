"""Papers from bytes to chunks of the index, each for itself."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuswell.config import STRATEGIES
from corpuswell.operators import chunkers
from corpuswell.operators.isolation import isolated
from corpuswell.sources.versions import VersionedIndex
from corpuswell.staging import staged


def store_papers(papers: DataFrame, extract: Callable[[bytes], str], index: VersionedIndex, strategies: tuple[str, ...] = tuple(STRATEGIES), batch: str | None = None) -> DataFrame:
    """doc_id, strategy, stored, chunks, reason of papers (doc_id, abstract, content): the text of each is extracted, chunked under each strategy, and committed.

    A paper whose extraction fails is left out, and its reason is the error; one without content, without text, or of which no chunk is long enough is left
    out too, abstract and all, and told. The others are one commit (of a batch, at most one), and each row here says what became of a paper.
    """
    asked = papers.select("doc_id", "abstract", "content")
    there = asked.where("content IS NOT NULL")
    read, broken = isolated(there, ["doc_id"], lambda row: {"text": extract(bytes(row["content"]))}, "text string")
    texts = read.select("doc_id", "abstract", F.coalesce("text", F.lit("")).alias("text"))
    parts = [chunkers.index_chunks(texts.select("doc_id", "text"), s, texts.select("doc_id", "abstract")) for s in strategies]
    chunks = staged(reduce(DataFrame.unionByName, parts), "chunks")
    index.upsert(chunks, batch)
    counted = chunks.groupBy("doc_id", "strategy").agg(F.count("*").alias("chunks"))
    listed = papers.sparkSession.createDataFrame([(s,) for s in strategies], "strategy string")
    every = papers.select("doc_id", F.col("content").isNull().alias("_none")).crossJoin(F.broadcast(listed))  # a row for each strategy
    told = every.join(broken.select("doc_id", "error"), "doc_id", "left").join(counted, ["doc_id", "strategy"], "left")
    reason = F.when(F.col("_none"), "no content").when(F.col("error").isNotNull(), F.col("error")).when(F.col("chunks").isNull(), "no chunk")
    return told.select("doc_id", "strategy", F.col("chunks").isNotNull().alias("stored"), F.coalesce("chunks", F.lit(0).cast("long")).alias("chunks"), reason.alias("reason"))
