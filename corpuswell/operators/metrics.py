"""Relevance and rank-aware metrics, one row per query and configuration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuswell.config import SETTINGS as S
from corpuswell.operators.vectors import dot

# Fixed names and order of the metrics.
METRICS = ["hit_at_k", "paper_coverage", "precision_at_k", "mrr", "average_precision"]


def relevance(hits: DataFrame, gold_docs: DataFrame, similarity: DataFrame | None = None) -> DataFrame:
    """hits (query_id, rank, paper_id, ...) with grade and relevant: grade 1 for a gold paper, else the largest similarity
    to a gold passage (query_id, rank, similarity), between 0 and 1. gold_docs: query_id, paper_id, distinct."""
    gold = gold_docs.select("query_id", "paper_id", F.lit(1.0).alias("_g"))
    graded = hits.join(gold, ["query_id", "paper_id"], "left")
    if similarity is None:
        grade = F.coalesce("_g", F.lit(0.0))
    else:
        best = similarity.groupBy("query_id", "rank").agg(F.max("similarity").alias("_s"))
        graded = graded.join(best, ["query_id", "rank"], "left")
        # greatest and least pass over nulls, so a missing similarity is looked at first.
        near = F.when(F.col("_s").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "_s")))
        grade = F.coalesce("_g", near, F.lit(0.0))
    return graded.withColumn("grade", grade).withColumn("relevant", F.col("grade") >= S.relevance).drop("_g", "_s")


def passage_similarity(hits: DataFrame, passages: DataFrame, judge: Callable[[Column], Column]) -> DataFrame:
    """query_id, rank, similarity of each hit's text (query_id, rank, text) with each gold passage of its query (query_id, passage).

    judge gives the unit vector of a text; it may be another embedder than the one that searches. Passages are embedded once each, and a hit meets
    those of its own query only.
    """
    asked = passages.select("query_id", judge(F.col("passage")).alias("_p"))
    own = hits.where(F.coalesce(F.col("text"), F.lit("")) != "").select("query_id", "rank", judge(F.col("text")).alias("_h"))
    return own.join(asked, "query_id").select("query_id", "rank", F.round(dot(F.col("_h"), F.col("_p")), 9).alias("similarity"))


def retrieval_metrics(graded: DataFrame, queries: DataFrame, gold_docs: DataFrame, k: int) -> DataFrame:
    """The METRICS of each query (query_id) over its first k hits; 0 without hits, coverage 1 without gold papers.

    Precision divides by k, average precision by the relevant hits. k of 0 or less gives zeros.
    """
    top = graded.where(F.col("rank") <= k)
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rel = F.col("relevant").cast("int")
    scored = top.withColumn("_cum", F.sum(rel).over(upto))
    per = scored.groupBy("query_id").agg(
        F.max(rel).cast("double").alias("hit_at_k"),
        (F.sum(rel) / F.lit(max(k, 1))).alias("precision_at_k"),
        F.coalesce(1.0 / F.min(F.when(F.col("relevant"), F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.avg(F.when(F.col("relevant"), F.col("_cum") / F.col("rank"))), F.lit(0.0)).alias("average_precision"),
    )
    found = top.join(gold_docs, ["query_id", "paper_id"], "left_semi").groupBy("query_id").agg(F.count_distinct("paper_id").alias("_found"))
    size = gold_docs.groupBy("query_id").agg(F.count_distinct("paper_id").alias("_gold"))
    every = queries.select("query_id").join(per, "query_id", "left").join(found, "query_id", "left").join(size, "query_id", "left")
    coverage = F.when(F.col("_gold").isNull(), F.lit(1.0)).otherwise(F.coalesce("_found", F.lit(0)) / F.col("_gold"))
    if k <= 0:
        return every.select("query_id", *[F.lit(0.0).alias(m) for m in METRICS])
    return every.withColumn("paper_coverage", coverage).select("query_id", *[F.coalesce(m, F.lit(0.0)).alias(m) for m in METRICS])


def config_metrics(graded: DataFrame, configs: DataFrame, queries: DataFrame, gold_docs: DataFrame) -> DataFrame:
    """config_id, ord, query_id and the METRICS of all configurations (config_id, ord, k) in one plan; k is at least 1.

    graded: config_id, query_id, rank, paper_id, relevant, with at most k hits. See retrieval_metrics.
    """
    keys, rel = ["config_id", "query_id"], F.col("relevant").cast("int")
    upto = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    own = graded.join(gold_docs.select("query_id", "paper_id", F.lit(True).alias("_in")), ["query_id", "paper_id"], "left").withColumn("_cum", F.sum(rel).over(upto))
    per = own.groupBy(*keys).agg(
        F.max(rel).cast("double").alias("hit_at_k"), F.sum(rel).alias("_sum"), F.coalesce(1.0 / F.min(F.when(F.col("relevant"), F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.avg(F.when(F.col("relevant"), F.col("_cum") / F.col("rank"))), F.lit(0.0)).alias("average_precision"), F.count_distinct(F.when(F.col("_in"), F.col("paper_id"))).alias("_found"),
    )
    size = gold_docs.groupBy("query_id").agg(F.count_distinct("paper_id").alias("_gold"))
    every = queries.select("query_id").crossJoin(F.broadcast(configs)).join(per, keys, "left").join(size, "query_id", "left")  # some dozens of configurations
    coverage = F.when(F.col("_gold").isNull(), F.lit(1.0)).otherwise(F.coalesce("_found", F.lit(0)) / F.col("_gold"))
    made = every.withColumns({"paper_coverage": coverage, "precision_at_k": F.col("_sum") / F.col("k")})
    return made.select("config_id", "ord", "query_id", *[F.coalesce(m, F.lit(0.0)).alias(m) for m in METRICS])


def long_scores(scores: DataFrame, *keys: str) -> DataFrame:
    """keys, metric, value."""
    return scores.unpivot(list(keys), METRICS, "metric", "value")
