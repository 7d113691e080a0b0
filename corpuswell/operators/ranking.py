"""Ranking: top-k, BM25, hybrid fusion, diversity, pools, re-ranking, neighbour expansion."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuswell.config import SETTINGS as S
from corpuswell.functions.text import words
from corpuswell.operators.postings import bm25, fused, matches, segments
from corpuswell.operators.vectors import BLOCK, blocks_with, cosine_scores, loosened, size_of, squeezed, unit_rows, wide
from corpuswell.operators.vectors import Best as _Best
from corpuswell.staging import staged

__all__ = ["bm25", "distinct_sources", "diverse", "expand_neighbours", "hybrid", "hybrid_search", "latest_wins", "matches", "min_max", "mmr", "pool_size", "ranked", "rerank", "segments", "word_overlap"]


def ranked(scores: DataFrame, k: Column | int, item: str = "vec_id") -> DataFrame:
    """scores (query_id, item, score) of the k best items of each query, with rank; ties go to the smaller item."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), item))
    return scores.withColumn("rank", place).where(F.col("rank") <= k)


def _scaled(score: str, low: str, high: str) -> Column:
    """A score scaled to 0 to 1 between its bounds; 1 where those are equal."""
    span = F.col(high) - F.col(low)
    return F.when(span < 1e-12, F.lit(1.0)).otherwise((F.col(score) - F.col(low)) / (span + 1e-12))


def min_max(scores: DataFrame) -> DataFrame:
    """score of each query scaled to 0 to 1; 1 throughout where all are equal. The bounds are aggregates, joined back."""
    scores = staged(scores, "scores")
    bounds = scores.groupBy("query_id").agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    return scores.join(bounds, "query_id").withColumn("score", _scaled("score", "_lo", "_hi")).drop("_lo", "_hi")


def hybrid(dense: DataFrame, lexical: DataFrame, weight: float = S.hybrid_weight, item: str = "doc_id") -> DataFrame:
    """Weighted sum of both scores, each scaled per query. dense has all items of a query; missing lexical scores are 0. The
    scores are staged once, and one aggregate gives the bounds of both."""
    lexical = lexical.select("query_id", item, F.col("score").alias("_l"))
    both = dense.select("query_id", item, F.col("score").alias("_d")).join(lexical, ["query_id", item], "left")
    both = staged(both.withColumn("_l", F.coalesce("_l", F.lit(0.0))), "both")
    bounds = both.groupBy("query_id").agg(*[f(c).alias(f"{c}_{f.__name__}") for c in ("_d", "_l") for f in (F.min, F.max)])
    fused = weight * _scaled("_d", "_d_min", "_d_max") + (1 - weight) * _scaled("_l", "_l_min", "_l_max")
    return both.join(bounds, "query_id").select("query_id", item, F.round(fused, 9).alias("score"))


def hybrid_search(queries: DataFrame, docs: DataFrame, k: int, weight: float = S.hybrid_weight) -> DataFrame:
    """query_id, doc_id, score of the k best documents (doc_id, text, embedding) of each query (query_id, text, embedding) by `hybrid` of their cosine and Okapi
    scores, and of some more; both are made segment by segment, so all pairs are never rows. Texts and vectors are read once, into an index that is staged."""
    index = staged(segments(docs.where("doc_id IS NOT NULL").select("doc_id", "text", "embedding")), "postings")
    return fused(index, queries, k, weight)


def _greedy(k: int, weight: float, pool: int):
    """The choices within a query's pool, with exact: whether no row outside it could have been chosen."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", ignore_index=True)
        ids, score = rows["vec_id"].to_numpy(), rows["score"].to_numpy(float)
        outside, last = -np.inf, -1
        if len(rows) > pool:  # the worst by bound, of equals the largest id, stands for all that are not here
            outside = rows["bound"].min()
            last = ids[rows["bound"].to_numpy(float) == outside].max()
        if len(rows) <= k:
            picks, exact = list(range(len(rows))), True
        else:
            v = np.stack([np.nan_to_num(np.array(x, float)) for x in rows["embedding"]])
            v /= np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-300)
            near, picks, exact = None, [], True
            for _ in range(k):
                value = score.copy() if near is None else np.round(weight * score - (1 - weight) * near, 9)
                value[picks] = -np.inf
                best = int(value.argmax())
                exact &= near is None or value[best] > outside or (value[best] == outside and ids[best] <= last)
                picks.append(best)
                similar = np.round(v @ v[best], 9)
                near = similar if near is None else np.maximum(near, similar)
        return pd.DataFrame({"query_id": rows["query_id"][0], "rank": range(1, len(picks) + 1), "vec_id": ids[picks], "exact": exact})

    return run


def mmr(scores: DataFrame, vectors: DataFrame, k: int = S.top_k, weight: float = S.mmr_lambda, pool: int = 256) -> DataFrame:
    """query_id, rank, vec_id: maximal marginal relevance, k items from all candidates of each query.

    The first choice is the most relevant item. What an item is worth later is at most its worth after that choice, as its
    largest similarity to what is chosen only grows. So the `pool` items with the best such bounds of each query go to a task, which chooses
    among them; where the last choice is not worth more than the best bound outside, the query is done again with a pool four times
    as large, so the result is exact. Ties go to the smaller vec_id; a query with k candidates or fewer keeps them in the
    order of vec_id, as storage does.
    """
    own = vectors.select("vec_id", "embedding")
    first = scores.groupBy("query_id").agg(F.max_by("vec_id", F.struct("score", -F.col("vec_id"))).alias("pick"))
    picked = first.join(own.withColumnRenamed("vec_id", "pick"), "pick").select(F.col("query_id").alias("vec_id"), "embedding")
    near = cosine_scores(picked, own).withColumnRenamed("score", "near")
    bounded = scores.select("query_id", "vec_id", "score").join(near, ["query_id", "vec_id"]).join(first, "query_id")
    # The first choice is always in the pool: its bound is above all others'.
    bound = F.when(F.col("vec_id") == F.col("pick"), F.lit(float("inf"))).otherwise(F.round(weight * F.col("score") - (1 - weight) * F.col("near"), 9))
    bounded = bounded.select("query_id", "vec_id", "score", bound.alias("bound"))
    done, size = None, max(pool, k)
    while True:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "vec_id"))
        pools = bounded.withColumn("_n", place).where(F.col("_n") <= size + 1).drop("_n").join(own, "vec_id")
        found = pools.groupBy("query_id").applyInPandas(_greedy(k, weight, size), "query_id long, rank int, vec_id long, exact boolean").persist()
        again = found.where("NOT exact").select("query_id").distinct()
        good = found.where("exact").select("query_id", "rank", "vec_id")
        done = good if done is None else done.unionByName(good)
        if again.isEmpty():
            return done
        bounded, size = bounded.join(again, "query_id", "left_semi"), 4 * size


#: Rows of pools that are broadcast at most.
BROADCAST_POOLS = 500_000


def _pack_picked(batches):
    """Rows (query, vector, picks, their vectors) as blocks of unit vectors. All queries of a block have as many picks: the last stands again for those that are missing."""
    for batch in batches:
        for lo in range(0, len(batch), BLOCK):
            part = batch.slice(lo, BLOCK)
            own, picks, chosen = unit_rows(part.column(1)), part.column(2).to_pylist(), part.column(3).to_pylist()
            most, width = max(map(len, picks)), max((len(v) for c in chosen for v in c), default=0)
            vectors = np.zeros((most, len(part), width))
            for n, c in enumerate(chosen):
                for j in range(most if c else 0):
                    v = c[min(j, len(c) - 1)]
                    vectors[j, n, : len(v)] = v
            filled = [p + p[-1:] * (most - len(p)) for p in picks]
            cells = [pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([sum(filled, [])], pa.list_(pa.int64()))]
            yield pa.record_batch([*cells, pa.array([own.tobytes()]), pa.array([vectors.tobytes()])], ["q_ids", "picks", "q_vectors", "p_vectors"])


def _bounds(most: int, weight: float, exclude_self: bool):
    """Of the vectors that a task meets, those with the `most` best bounds for each query: query_id, vec_id, score, bound. Without picks the bound is the score."""

    def run(batches):
        best: dict[bytes, _Best] = {}
        for batch in batches:
            for at in range(len(batch)):
                row = batch.slice(at, 1).to_pylist()[0]
                ids, asked = (np.array(row[c], np.int64) for c in ("ids", "q_ids"))
                picks = np.array(row["picks"], np.int64).reshape(len(asked), -1)
                v, q = loosened(row["vectors"], len(ids), row["width"]), np.frombuffer(row["q_vectors"]).reshape(len(asked), -1)
                by = lambda x: x[:, : min(x.shape[1], v.shape[1])] @ v[:, : min(x.shape[1], v.shape[1])].T
                score = bound = np.round(by(q), 9) + 0.0
                if picks.size:
                    near = reduce(np.maximum, map(by, np.frombuffer(row["p_vectors"]).reshape(picks.shape[1], len(asked), -1)))
                    bound = np.round(weight * score - (1 - weight) * (np.round(near, 9) + 0.0), 9)
                else:
                    bound = bound.copy()
                which = np.flatnonzero(np.isin(ids, picks))
                bound[:, which] = np.where((picks[:, :, None] == ids[which]).any(axis=1), -np.inf, bound[:, which])
                if exclude_self:
                    bound[ids[None, :] == asked[:, None]] = -np.inf
                best.setdefault(asked.tobytes(), _Best(len(asked), most)).add(ids, score, bound)
        for key, own in best.items():
            who, ids, score, bound = own.settle()
            table = pa.table([np.frombuffer(key, np.int64)[who], ids, score, bound], ["query_id", "vec_id", "score", "bound"])
            yield from table.to_batches(1 << 16)

    return run


def _chosen(k: int, weight: float, pool: int):
    """A query with the picks that its pool adds to those it has: of these each is sure, as no row outside the pool could have been chosen instead."""

    def run(rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):  # nothing to choose from
            return pd.DataFrame({"query_id": [], "embedding": [], "picks": [], "chosen": [], "done": []})
        rows = rows.sort_values("vec_id", ignore_index=True)
        ids, score, bound = rows["vec_id"].to_numpy(), rows["score"].to_numpy(float), rows["bound"].to_numpy(float)
        v, whole = unit_rows(pa.array(rows["embedding"], pa.list_(pa.float64()))), len(rows) <= pool
        picks, chosen = list(state["picks"][0]), list(state["chosen"][0])
        if whole and len(rows) <= k - len(picks) and not picks:
            picks, chosen = list(ids), list(v)
        else:
            # The worst by bound, of equals the largest id, stands for all that are not here.
            outside = -np.inf if whole else bound.min()
            last = ids[bound == outside].max(initial=-1)
            like = lambda x: np.round(v[:, : len(x)] @ x[: v.shape[1]], 9) + 0.0
            near = reduce(np.maximum, map(like, chosen)) if chosen else None
            value, used = bound.copy(), np.zeros(len(ids), bool)
            while len(picks) < k and not used.all():
                value[used] = -np.inf
                best = int(value.argmax())
                if not (value[best] > outside or value[best] == outside and ids[best] <= last):
                    break
                picks.append(ids[best])
                chosen.append(v[best])
                used[best] = True
                if near is None and not whole:  # scores alone bound nothing after the first choice
                    break
                near = like(v[best]) if near is None else np.maximum(near, like(v[best]))
                value = np.round(weight * score - (1 - weight) * near, 9)
        return pd.DataFrame({"query_id": state["query_id"][:1], "embedding": state["embedding"][:1], "picks": [picks], "chosen": [chosen], "done": whole or len(picks) == k})

    return run


def diverse(queries: DataFrame, vectors: DataFrame, k: int = S.top_k, weight: float = S.mmr_lambda, exclude_self: bool = False, pool: int = 64) -> DataFrame:
    """query_id, rank, vec_id: what `mmr` chooses of the cosine scores of all vectors (vec_id, embedding), without a row for each pair.

    Vectors are packed once. A pass over them, block by block, gives what each is worth at most after the choices that a query has so far; a task hands on no more than
    pool + 1 rows of a query, those with the best bounds of all the vectors that it met. Among them the query chooses on for as long as nothing outside could be chosen instead. The
    best by bound always can be, so there are k passes at most, and pools never grow. vectors are read in each pass for those of the pools, so they should be a table.
    """
    own, size = vectors.select("vec_id", "embedding"), max(pool, k)
    blocks = staged(squeezed(own), "blocks")
    state = staged(wide(queries).select(F.col("vec_id").alias("query_id"), "embedding", F.array().cast("array<bigint>").alias("picks"), F.array().cast("array<array<double>>").alias("chosen")), "asked")
    parts = []
    for n in range(k):
        asked = size_of(state)
        if n and not asked["n"]:
            break
        packed = state.mapInArrow(_pack_picked, "q_ids array<bigint>, picks array<bigint>, q_vectors binary, p_vectors binary")
        bounded = blocks_with(state, packed, blocks, k + 1 if n else 1, asked).mapInArrow(_bounds(size + 1, weight, exclude_self), "query_id long, vec_id long, score double, bound double")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "vec_id"))
        pools = bounded.withColumn("_n", place).where(F.col("_n") <= size + 1).drop("_n")
        pools = wide(own).join(F.broadcast(pools) if asked["n"] * (size + 1) <= BROADCAST_POOLS else pools, "vec_id")
        both = pools.groupBy("query_id").cogroup(state.groupBy("query_id"))
        found = both.applyInPandas(_chosen(k, weight, size), "query_id long, embedding array<double>, picks array<bigint>, chosen array<array<double>>, done boolean")
        state = staged(found, "chosen")
        parts.append(state.where("done").select("query_id", F.posexplode("picks").alias("rank", "vec_id")).select("query_id", (F.col("rank") + 1).alias("rank"), "vec_id"))
        state = state.where("NOT done").drop("done")
    return reduce(DataFrame.unionByName, parts)


def pool_size(k: Column | int, n: Column) -> Column:
    """How many candidates are re-ranked for k results out of n."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.least(n, F.greatest(F.lit(S.pool_least), F.least(F.lit(S.pool_most), S.pool_factor * k)))


def word_overlap(query: Column, text: Column) -> Column:
    """The built-in re-ranker: F1 of the distinct words of query and text."""
    q, t = F.array_distinct(words(query)), F.array_distinct(words(text))
    return F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(q, t)), (F.size(q) + F.size(t)).cast("double")), F.lit(0.0))


def rerank(scores: DataFrame, queries: DataFrame, docs: DataFrame, k: int = S.top_k, scorer: Callable[[Column, Column], Column] = word_overlap) -> DataFrame:
    """The k best of each query's pool by `scorer`; texts are fetched for the pool only."""
    # A rank is never above the number of candidates, so that bound of the pool need not be counted.
    pool = ranked(scores, pool_size(k, F.lit(S.pool_most)), "doc_id").select("query_id", "doc_id")
    texts = pool.join(docs.select("doc_id", F.col("text").alias("_t")), "doc_id").join(queries.select("query_id", F.col("text").alias("_q")), "query_id")
    return ranked(texts.select("query_id", "doc_id", F.round(scorer(F.col("_q"), F.col("_t")), 9).alias("score")), k, "doc_id")


def expand_neighbours(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits (query_id, rank, doc_id, position) with the chunks before and after each, by equi-join on (doc_id, position).

    In order of the hits come the one before, the hit, the one after; of repeats the first stays; ranks are given anew.
    """
    around = hits.select("query_id", F.col("rank").alias("_r"), "doc_id", (F.col("position")).alias("_p"), F.posexplode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("_o", "_d"))
    around = around.select("query_id", "_r", "_o", "doc_id", (F.col("_p") + F.col("_d")).alias("position"))
    found = around.join(chunks, ["doc_id", "position"])
    first = F.row_number().over(Window.partitionBy("query_id", "doc_id", "position").orderBy("_r", "_o"))
    once = found.withColumn("_n", first).where("_n = 1")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("_r", "_o"))
    return once.withColumn("rank", rank).drop("_r", "_o", "_n")


def distinct_sources(hits: DataFrame) -> DataFrame:
    """The first hit of each paper of a query, with its section."""
    first = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("rank"))
    return hits.withColumn("_n", first).where("_n = 1").drop("_n")


def latest_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Upsert: of rows with equal keys the last by `order` stays."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("_n", last).where("_n = 1").drop("_n")
