"""Sweeps over configurations, winners, paired comparisons, and the corpus that a manifest names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuswell.config import SETTINGS as S
from corpuswell.operators import metrics, ranking
from corpuswell.staging import staged


def dense_sweep(scores: DataFrame, items: DataFrame, gold: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """config_id, query_id, metric, value for each k: hits are searched and ranked once for the largest k, staged, and cut for the others."""
    hits = ranking.ranked(scores, max(ks)).join(items.select("vec_id", F.col("label").alias("paper_id")), "vec_id")
    graded = staged(metrics.relevance(hits, gold), "graded")
    one = lambda k: metrics.retrieval_metrics(graded, gold.select("query_id"), gold, k).withColumn("config_id", F.lit(f"dense_k{k}"))
    return metrics.long_scores(reduce(DataFrame.unionByName, map(one, ks)), "config_id", "query_id")


def phase2_sweep(scores: dict[str, DataFrame], queries: DataFrame, docs: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (3, 5, 10), similarity: DataFrame | None = None, diverse: dict[str, DataFrame] | None = None) -> DataFrame:
    """config_id, ord, query_id, metric, value of k x kinds of scores x (with and without re-ranking).

    scores: kind to (query_id, doc_id, score); queries: query_id, text; docs: doc_id, text; gold: query_id, paper_id. Re-ranking for k looks at the
    pool that belongs to k. Of each kind only the largest pool of a query is staged; all configurations are made of it, and a text is
    scored for re-ranking once. diverse: kind to (query_id, doc_id, rank), what a selection for diversity chooses of it for the largest k; as it chooses one
    after the other, its first k are those for k.
    """
    pools = []
    for place, (kind, own) in enumerate(scores.items()):
        pools.append(ranking.ranked(own, S.pool_most, "doc_id").select(F.lit(kind).alias("kind"), F.lit(place).alias("k_place"), "query_id", "doc_id", F.col("rank").alias("place")))
    pool = reduce(DataFrame.unionAll, pools)
    texts = pool.join(docs.select("doc_id", F.col("text").alias("_t")), "doc_id").join(queries.select("query_id", F.col("text").alias("_q")), "query_id")
    pool = staged(texts.select("kind", "k_place", "query_id", "doc_id", "place", F.round(ranking.word_overlap(F.col("_q"), F.col("_t")), 9).alias("overlap")), "pool")
    every = pool.select("*", F.posexplode(F.array(*[F.lit(k) for k in ks])).alias("i", "k"))
    name = lambda way: F.concat("kind", F.lit(f"_{way}_k"), F.col("k").cast("string")).alias("config_id")
    order = 4 * F.col("i") + 2 * F.col("k_place")
    plain = every.where("place <= k").select(name("plain"), order.alias("ord"), "k", "query_id", F.col("doc_id").alias("paper_id"), F.col("place").alias("rank"))
    for place, (kind, chosen) in enumerate((k, (diverse or {}).get(k)) for k in scores):
        if chosen is not None:
            own = chosen.select("*", F.posexplode(F.array(*[F.lit(k) for k in ks])).alias("i", "k")).where("rank <= k")
            named = F.concat(F.lit(f"{kind}_plain_k"), F.col("k").cast("string")).alias("config_id")
            own = own.select(named, (4 * F.col("i") + 2 * place).alias("ord"), "k", "query_id", F.col("doc_id").alias("paper_id"), "rank")
            plain = plain.where(~F.col("config_id").startswith(f"{kind}_plain_k")).unionAll(own)
    best = F.row_number().over(Window.partitionBy("kind", "k", "query_id").orderBy(F.desc("overlap"), "doc_id"))
    again = every.where(F.col("place") <= ranking.pool_size(F.col("k"), F.lit(S.pool_most))).withColumn("rank", best).where("rank <= k")
    again = again.select(name("rerank"), (order + 1).alias("ord"), "k", "query_id", F.col("doc_id").alias("paper_id"), "rank")
    configs = [(f"{kind}_{way}_k{k}", 4 * i + 2 * place + j, k) for place, kind in enumerate(scores) for i, k in enumerate(ks) for j, way in enumerate(("plain", "rerank"))]
    configs = queries.sparkSession.createDataFrame(configs, "config_id string, ord int, k int")
    graded = metrics.relevance(plain.unionAll(again), gold, similarity)
    return metrics.long_scores(metrics.config_metrics(graded, configs, queries, gold), "config_id", "ord", "query_id")


def preregistered_pairs(long: DataFrame) -> DataFrame:
    """name, metric, a_config, b_config, example_id, a, b of the comparisons that were fixed beforehand: the best configuration with the
    second (by hit rate, reciprocal rank, precision; of equals the earlier one), and dense with hybrid search at k = 10 without re-ranking, each by hit rate."""
    means = long.groupBy("config_id", "ord").pivot("metric", ["hit_at_k", "mrr", "precision_at_k"]).agg(F.avg("value"))
    place = F.row_number().over(Window.orderBy(*[F.desc(F.round(m, 9)) for m in ("hit_at_k", "mrr", "precision_at_k")], "ord"))  # a row for each configuration
    order = means.select("config_id", place.alias("place"))
    best = order.where("place = 1").select(F.lit("phase2_best_vs_second_hit").alias("name"), F.col("config_id").alias("a_config"))
    second = order.where("place = 2").select(F.col("config_id").alias("b_config"))
    fixed = order.limit(1).select(F.lit("phase2_dense_vs_hybrid_topk10_hit").alias("name"), F.lit("dense_plain_k10").alias("a_config"), F.lit("hybrid_plain_k10").alias("b_config"))
    named = best.crossJoin(second).unionByName(fixed)  # two rows
    values = long.where("metric = 'hit_at_k'").select("config_id", "query_id", "value")
    one = lambda x: values.select(F.col("config_id").alias(f"{x}_config"), F.col("query_id").alias("example_id"), F.col("value").alias(x))
    return F.broadcast(named).join(one("a"), "a_config").join(one("b"), ["b_config", "example_id"]).select("name", F.lit("hit_at_k").alias("metric"), "a_config", "b_config", "example_id", "a", "b")


def best_config(long: DataFrame) -> str:
    """The configuration with the best mean hit rate, then reciprocal rank, then precision; of equals the earlier one (config_id, ord, query_id, metric, value)."""
    means = long.groupBy("config_id", "ord").pivot("metric", ["hit_at_k", "mrr", "precision_at_k"]).agg(F.avg("value"))
    return means.orderBy(*[F.desc(F.round(m, 9)) for m in ("hit_at_k", "mrr", "precision_at_k")], "ord").first()["config_id"]


def model_pairs(long: DataFrame, baseline: str) -> DataFrame:
    """name, metric, a_config, b_config, example_id, a, b: the baseline model with each other, by hit rate and average precision. config_id names a model."""
    own = long.where(F.col("config_id") == baseline).select("query_id", "metric", F.col("value").alias("a"))
    other = long.where((F.col("config_id") != baseline) & F.col("metric").isin("hit_at_k", "average_precision"))
    short = F.when(F.col("metric") == "hit_at_k", "hit").otherwise("map")
    name = F.concat(F.lit("phase3_baseline_vs_"), F.col("config_id"), F.lit("_"), short)
    return other.join(own, ["query_id", "metric"]).select(name.alias("name"), "metric", F.lit(baseline).alias("a_config"), F.col("config_id").alias("b_config"), F.col("query_id").alias("example_id"), "a", F.col("value").alias("b"))


def winner(long: DataFrame) -> DataFrame:
    """The configuration with the best mean hit rate, then reciprocal rank, then precision; the smallest k of equals."""
    means = long.groupBy("config_id").pivot("metric", metrics.METRICS).agg(F.avg("value"))
    order = [F.desc(F.round(m, 9)) for m in ("hit_at_k", "mrr", "precision_at_k")]
    return means.orderBy(*order, F.regexp_extract("config_id", r"(\d+)$", 1).cast("int")).limit(1)


def metric_pairs(long: DataFrame, pairs: list[tuple[str, str]], names: list[str]) -> DataFrame:
    """name, metric, example_id, a, b: values of two configurations for the same query."""

    def one(a: str, b: str) -> DataFrame:
        left = long.where(F.col("config_id") == a).select("query_id", "metric", F.col("value").alias("a"))
        right = long.where(F.col("config_id") == b).select("query_id", "metric", F.col("value").alias("b"))
        return left.join(right, ["query_id", "metric"]).select(F.lit(f"{a}_vs_{b}").alias("name"), "metric", F.col("query_id").alias("example_id"), "a", "b")

    return reduce(DataFrame.unionAll, [one(a, b) for a, b in pairs]).where(F.col("metric").isin(names))


def match_manifest(dataset: DataFrame, manifest: DataFrame) -> DataFrame:
    """dataset (id, topics, question) with the paper_ids of its manifest row (id, topics, question, paper_ids, ord).

    Rows match by id, else by topics and question; of several manifest rows the last holds. Raises ValueError
    if a row has no papers.
    """
    by_id = ranking.latest_wins(manifest, ["id"], "ord").select("id", F.col("paper_ids").alias("_a"))
    by_text = ranking.latest_wins(manifest, ["topics", "question"], "ord").select("topics", "question", F.col("paper_ids").alias("_b"))
    matched = dataset.join(by_id, "id", "left").join(by_text, ["topics", "question"], "left").withColumn("paper_ids", F.coalesce("_a", "_b")).drop("_a", "_b")
    missing = matched.where("coalesce(size(paper_ids), 0) <= 0").select("id").take(5)
    if missing:
        raise ValueError(f"no papers in the manifest for {[r['id'] for r in missing]}")
    return matched


def corpus_papers(manifest: DataFrame) -> DataFrame:
    """paper_id, position: distinct papers of manifest rows (ord, paper_ids) in the order in which they are first named."""
    named = manifest.select("ord", F.posexplode("paper_ids").alias("k", "paper_id"))
    first = named.groupBy("paper_id").agg(F.min(F.struct("ord", "k")).alias("f"))
    return first.select("paper_id", F.row_number().over(Window.orderBy("f")).cast("long").alias("position"))
