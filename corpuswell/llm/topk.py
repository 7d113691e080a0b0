"""Exact top-k search by inner product: no-random-access aggregation over sorted lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuswell.llm._shared import partitions

#: Vectors of a candidate block and of a query block at most, and bytes of either's components.
CANDIDATES, QUERIES, BLOCK_BYTES = 2048, 128, 2 << 20
#: Bytes of the components of a group's candidates, which a task holds three times over: as rows, sorted, and their places.
HELD_BYTES = 16 << 20
#: Shares of a list that are read when bounds are looked at: small first steps for skewed lists, small last ones for even lists.
ROUNDS = [1 / 64, 1 / 32, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 5 / 8, 3 / 4, 13 / 16, 7 / 8, 29 / 32, 15 / 16, 31 / 32, 1]
_LONG = (-(1 << 63), (1 << 63) - 1)


class SortedLists:
    """The vectors of a block, and for each component their places in ascending order of its values."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray):
        self.ids, self.copies, self.vectors = ids, copies, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").T
        self.values = np.take_along_axis(vectors.T, self.order, axis=1)


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> list[int]:
    """Inner products of whole numbers that are held as doubles, exact at any size."""
    if np.abs(vectors).max(initial=0) * np.abs(query).max(initial=0) * max(1, len(query)) < 1 << 52:
        return (vectors @ query).astype(np.int64).tolist()
    weights = [int(x) for x in query.tolist()]
    return [sum(int(x) * w for x, w in zip(v, weights)) for v in vectors.tolist()]


def no_random_access(lists: SortedLists, queries: np.ndarray, ids: np.ndarray, copies: np.ndarray, k: int, floor: np.ndarray) -> tuple[list[tuple[np.ndarray, list[int]]], int]:
    """(for each query the places and scores of its k best vectors, the entries that were read of the lists).

    All queries read the lists side by side, from both ends towards the middle. What a query has not read of a vector lies between
    the last values read at both ends, which bounds its score from below and from above. A vector leaves a query when
    its upper bound is under the k-th best lower bound or under `floor`, the k-th best score that other blocks gave. A query
    stops when no more than k vectors are left, so that no outsider can qualify; the lists are read until all
    queries have stopped, or to their end where ties remain. Scores of what is left are then resolved
    exactly. Ties go to smaller ids; a query's own row (equal id and copy) takes no part.
    """
    n, width = len(lists.ids), min(lists.vectors.shape[1], queries.shape[1])
    weights, component = np.ascontiguousarray(queries[:, :width]), np.arange(width)[:, None]
    size = np.abs(lists.vectors).max(initial=0) * np.abs(queries).max(initial=0) * max(1, width)
    slack = 0.0 if size < 1 << 52 else size * width * 2.0**-48  # doubles round beyond 2**53
    survivors: list = [None] * len(queries)
    # Rows and queries that are still open; known and left are held for these only, a row of them for each query.
    rows, open_, at = np.arange(n), np.arange(len(queries)), 0
    known, unread = np.zeros((len(queries), n)), np.ones((n, width))
    left = ~((lists.ids == ids[:, None]) & (lists.copies == copies[:, None]))
    for share in ROUNDS:
        low_end, high_end = (max(at + 1, int(half * share)) for half in (n - n // 2, n // 2))
        low_end, high_end = min(low_end, n - n // 2), min(high_end, n // 2)
        entries = np.zeros((n, width))
        for a, b in ((at, low_end), (n - high_end, n - min(at, n // 2))):
            who = lists.order[:width, a:b]
            entries[who, component] = lists.values[:width, a:b]
            unread[who, component] = 0
        at = low_end
        known += weights @ entries[rows].T
        if 2 * at >= n:
            break
        ends = [weights * lists.values[:width, at - 1], weights * lists.values[:width, n - high_end]]
        missing = unread[rows].T
        low, high = (known + x @ missing for x in (np.minimum(*ends), np.maximum(*ends)))
        bound = floor[open_] - slack
        if len(rows) >= k:
            bound = np.maximum(bound, np.partition(np.where(left, low, -np.inf), len(rows) - k, axis=1)[:, len(rows) - k] - slack)
        left &= high >= bound[:, None] - slack
        going = left.sum(axis=1) > k
        if not going.all():
            for q in np.flatnonzero(~going):
                survivors[open_[q]] = rows[left[q]]
            open_, weights, known, left = open_[going], weights[going], known[going], left[going]
        some = left.any(axis=0)
        if some.sum() < 0.8 * len(rows):
            rows, known, left = rows[some], known[:, some], left[:, some]
        if not len(open_):
            break
    for q, own, scores in zip(open_, left, known):  # read to the end: what is known is the score, up to rounding
        last = np.flatnonzero(own)
        if len(last) > k:
            last = last[scores[last] >= np.partition(scores[last], len(last) - k)[len(last) - k] - 2 * slack]
        survivors[q] = rows[last]
    found = []
    for q, last in enumerate(survivors):
        scores = exact_scores(lists.vectors[last, :width], queries[q, :width])
        best = sorted(range(len(last)), key=lambda j: (-scores[j], lists.ids[last[j]]))[:k]
        found.append((last[best], [scores[j] for j in best]))
    return found, 2 * at * width if 2 * at < n else n * width


BLOCKS = "number long, ids binary, copies binary, rows binary, vectors binary, width int"
_NAMES = [c.split()[0] for c in BLOCKS.split(", ")]


def _blocks(size: int, scale: int):
    """Rows of a task (id, copy, rows, vector) as blocks: number, ids, copies, rows, quantised vectors (padded with zeros to the longest), their width."""

    def block(number, kept):
        ids, copies, rows, vectors = zip(*kept)
        width = max(map(len, vectors))
        packed = np.zeros((len(vectors), width))
        for row, v in zip(packed, vectors):
            row[: len(v)] = np.clip(np.floor(scale * v), -1e150, 1e150)
        keys = [pa.array([np.array(x, "<i8").tobytes()]) for x in (ids, copies, rows)]
        return pa.record_batch([pa.array([number], pa.int64()), *keys, pa.array([packed.tobytes()]), pa.array([width], pa.int32())], _NAMES)

    def run(batches):
        number, kept, width = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for i, c, m, v in zip(*(batch.column(j).to_pylist() for j in range(3)), batch.column(3)):
                v = v.values.to_numpy()
                width = max(width, len(v))
                if kept and (len(kept) == size or (len(kept) + 1) * 8 * width > BLOCK_BYTES):
                    yield block(number, kept)
                    number, kept, width = number + 1, [], len(v)
                kept.append((i, c, m, v))
        if kept:
            yield block(number, kept)

    return run


def _search(k: int):
    """A task's candidate blocks come first and are held; then each query block is searched in all of them."""

    def run(batches):
        held: list[SortedLists] = []
        for batch in batches:
            for row in (batch.slice(j, 1).to_pylist()[0] for j in range(len(batch))):
                ids, copies, rows = (np.frombuffer(row[c], "<i8") for c in ("ids", "copies", "rows"))
                vectors = np.frombuffer(row["vectors"], "<f8").reshape(len(ids), -1)
                if not row["asks"]:
                    held.append(SortedLists(ids, copies, vectors))
                    continue
                floor, best = np.full(len(ids), -np.inf), [[] for _ in range(len(ids))]
                for lists in held:
                    found, _ = no_random_access(lists, vectors, ids, copies, k, floor)
                    for q, (last, scores) in enumerate(found):
                        best[q] = sorted([*best[q], *zip((-x for x in scores), lists.ids[last].tolist())])[:k]
                        if len(best[q]) == k:
                            floor[q] = -best[q][-1][0]
                sizes = [len(x) for x in best]
                keys = [pa.array(np.repeat(x, sizes)) for x in (ids, copies, rows)]
                scores = [-x for own in best for x, _ in own]
                score = pa.array([min(max(x, _LONG[0]), _LONG[1]) for x in scores], pa.int64())
                places = pa.array([i for own in best for _, i in own], pa.int64())
                yield pa.record_batch([*keys, places, score, pa.array(map(float, scores), pa.float64())], ["query_id", "copy", "rows", "vec_id", "score", "size"])

    return run


def whole_vector(vector: str | Column = "embedding") -> Column:
    """The vector as array<double>; null if it or a component is null or not finite."""
    wide = (F.col(vector) if isinstance(vector, str) else vector).cast("array<double>")
    return F.when(F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), wide)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256, groups: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query row its k best other rows by inner product of floor(scale * x).

    Candidates and queries are packed into blocks by bytes. Candidate blocks are dealt to groups of about HELD_BYTES, as many groups as it takes; a task
    holds a group and reads the query blocks, which go to each group, one after the other. The k-th best score that a block gives
    prunes in the next. The best k of each group meet per query. Ties go to the smaller id.

    Null vectors, null or non-finite components and null keys take no part; a shorter vector counts as padded
    with zeros; an empty vector scores 0. A query row's candidates are all rows but itself: rows that repeat its id are
    among them, and each query row has k rows of its own. Equal query rows are searched once and given as often as they stand. Scores are exact at any size
    of components; one that no long holds is given as the nearest long, and such are ranked by their values as doubles; a component above 1e150 / scale counts
    as that. An empty table gives no rows; other columns are not read.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), whole_vector(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where("v IS NOT NULL AND id IS NOT NULL")
    asked = rows.where("q").groupBy("id", "v").agg(F.count("*").alias("rows"))
    mark, none, one = F.xxhash64("v").bitwiseOR(F.lit(1)), F.lit(0).cast("long"), F.lit(1).cast("long")
    # Of equal query rows the first is the query's own row; k more are all that can be among its best.
    again = asked.select("id", F.explode(F.sequence(F.lit(1), F.least("rows", F.lit(k + 1)).cast("int"))).alias("j"), "v")
    candidates = rows.where("NOT q").select("id", none.alias("copy"), one.alias("rows"), "v").unionAll(again.select("id", F.when(F.col("j") == 1, mark).otherwise(none), one, "v"))
    total = rows.agg(F.sum(8 * F.size("v").cast("long"))).first()[0] or 0
    groups = groups or max(partitions(vectors.sparkSession), -(-total // HELD_BYTES))
    # Blocks are numbered by partition and place in it, which deals them evenly.
    group = F.pmod(F.shiftright("number", 32) + F.col("number").bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(groups)).cast("int")
    blocks = candidates.mapInArrow(_blocks(CANDIDATES, scale), BLOCKS).withColumns({"asks": F.lit(False), "g": group})
    queries = asked.select("id", mark, "rows", "v").mapInArrow(_blocks(QUERIES, scale), BLOCKS)
    everywhere = queries.withColumns({"asks": F.lit(True), "g": F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))})
    both = blocks.unionByName(everywhere).repartitionById(groups, F.col("g")).sortWithinPartitions("asks", "number")
    found = both.mapInArrow(_search(k), "query_id long, copy long, rows long, vec_id long, score long, size double")
    order = Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), F.desc("size"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.withColumn("_row", F.explode(F.sequence(one, F.col("rows")))).select("query_id", "rank", "vec_id", "score")
