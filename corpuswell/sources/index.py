"""The chunk index: Parquet by strategy, with upsert in which the last writer wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from corpuswell.functions.text import name_uuid
from corpuswell.operators.ranking import latest_wins
from corpuswell.sources.datasets import metadata_strings

KEYS = ["strategy", "doc_id", "_head"]


def point_id(chunks: DataFrame) -> DataFrame:
    """chunks with point_id, the UUID of strategy, document and the first 50 characters."""
    return chunks.withColumn("point_id", name_uuid(F.concat_ws("_", "strategy", F.col("doc_id").cast("string"), F.left("chunk_text", F.lit(50)))))


def upsert(old: DataFrame | None, new: DataFrame, order: str = "position") -> DataFrame:
    """Old chunks and new ones; of equal strategy, document and first 50 characters the last stays: new before old, then by order.
    An abstract (position -1) counts as saved last."""
    every = new.withColumn("_age", F.lit(1)) if old is None else old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    last = F.struct("_age", F.col(order) < 0, order)
    return latest_wins(every.withColumns({"_head": F.left("chunk_text", F.lit(50)), "_last": last}), KEYS, "_last").drop("_age", "_head", "_last")


def write(chunks: DataFrame, path: str) -> None:
    """Replaces the strategies that chunks holds; others stay as they are."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("strategy").parquet(path)


def fetch(spark: SparkSession, path: str, strategy: str) -> DataFrame:
    """Chunks of one strategy: a partition filter."""
    return spark.read.parquet(path).where(F.col("strategy") == strategy)


def check_width(vectors: DataFrame, width: int) -> None:
    """Raises ValueError if a vector has another width."""
    other = vectors.select(F.size("embedding").alias("w")).where(F.col("w") != width).take(1)
    if other:
        raise ValueError(f"expected vectors of {width} numbers, found {other[0]['w']}")


def save_papers(old: DataFrame | None, papers: DataFrame, order: str = "paper_id") -> DataFrame:
    """Paper metadata as it is stored, with point_id, the UUID of the paper; of equal papers the new one stays, then the last by order.

    Rows without paper_id leave; see metadata_strings.
    """
    stored = metadata_strings(papers.withColumn("_order", F.struct(order))).withColumn("point_id", name_uuid(F.concat(F.lit("paper_"), F.col("paper_id"))))
    new = latest_wins(stored, ["point_id"], "_order").drop("_order").withColumn("_age", F.lit(1))
    every = new if old is None else old.withColumn("_age", F.lit(0)).unionByName(new)
    return latest_wins(every, ["point_id"], "_age").drop("_age")


def ensure(spark: SparkSession, path: str, schema: str) -> None:
    """Makes an empty table at path where none is; raises ValueError if the one there has other columns."""
    try:
        there = spark.read.parquet(path)
    except AnalysisException:
        spark.createDataFrame([], schema).write.parquet(path)
        return
    wanted = {(f.name, f.dataType) for f in spark.createDataFrame([], schema).schema}
    if {(f.name, f.dataType) for f in there.schema} != wanted:
        raise ValueError(f"{path} has the columns {there.schema.simpleString()}")


def reset(spark: SparkSession, path: str, schema: str) -> None:
    """Replaces a table by an empty one."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def clear_snapshot(files: DataFrame, snapshot_id: str) -> tuple[DataFrame, DataFrame]:
    """(what stays, one row with the number of files that go) of files with a snapshot_id column: a delete by prefix."""
    gone = F.col("snapshot_id") == snapshot_id
    return files.where(~gone), files.where(gone).agg(F.count("*").alias("deleted"))
