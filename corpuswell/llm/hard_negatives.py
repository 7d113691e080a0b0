"""Hard negatives: of each anchor all scores are sorted, and read from each positive's limit downwards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuswell.llm._shared import partitions, staged
from corpuswell.llm.topk import whole_vector

#: Bytes of the vectors of a block, of the blocks that a task holds, and vectors of a block of anchors at most.
BLOCK_BYTES, HELD_BYTES, ANCHORS = 4 << 20, 64 << 20, 256
_LONG, _MOST = (-(1 << 63), (1 << 63) - 1), np.finfo(float).max


def exact_products(anchors: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """anchors x vectors: inner products of whole numbers that are held as doubles; as Python's numbers where doubles or longs would round."""
    if np.abs(anchors).max(initial=0) * np.abs(vectors).max(initial=0) * max(1, anchors.shape[1]) < 1 << 52:
        return (anchors @ vectors.T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (anchors, vectors)]
    return whole[0] @ whole[1].T if anchors.shape[1] else np.zeros((len(anchors), len(vectors)), np.int64)


def order_key(score: int) -> bytes:
    """Bytes that sort like whole numbers of any size."""
    size = (score.bit_length() + 7) // 8
    if score >= 0:
        return b"\x01" + size.to_bytes(2, "big") + score.to_bytes(size, "big")
    return b"\x00" + (0xFFFF - size).to_bytes(2, "big") + ((1 << 8 * size) - 1 + score).to_bytes(size, "big")


def from_order_key(key: bytes) -> int:
    body = int.from_bytes(key[3:], "big")
    return body if key[0] else body + 1 - (1 << 8 * (len(key) - 3))


BLOCKS = "number long, asks boolean, ids binary, marks binary, labels binary, rows binary, vectors binary, width int, limits array<array<binary>>, names array<array<long>>"
_NAMES = [c.split()[0] for c in BLOCKS.split(", ")]
_TYPES = [pa.int64(), pa.bool_(), *[pa.binary()] * 5, pa.int32(), pa.list_(pa.list_(pa.binary())), pa.list_(pa.list_(pa.int64()))]


def _blocks(asks: bool, scale: int):
    """Rows (id, mark, label, rows, vector and, of anchors, the scores and ids of their positives) as blocks of up to BLOCK_BYTES of quantised vectors, padded with zeros."""

    def block(number, kept):
        ids, marks, labels, rows, vectors, limits, names = zip(*kept)
        packed = np.zeros((len(vectors), max(map(len, vectors))))
        for row, v in zip(packed, vectors):
            row[: len(v)] = np.clip(np.floor(scale * v), -_MOST, _MOST)
        keys = [np.array(x, "<i8").tobytes() for x in (ids, marks, labels, rows)]
        return pa.record_batch([pa.array([x], t) for x, t in zip([number, asks, *keys, packed.tobytes(), packed.shape[1], list(limits), list(names)], _TYPES)], _NAMES)

    def run(batches):
        number, kept, width = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            limits, names = (batch.column(j).to_pylist() if batch.num_columns > 5 else [None] * len(batch) for j in (5, 6))
            for *head, v, s, n in zip(*(batch.column(j).to_pylist() for j in range(4)), batch.column(4), limits, names):
                v = v.values.to_numpy()
                wider = max(width, len(v))
                if kept and ((len(kept) + 1) * 8 * wider > BLOCK_BYTES or asks and len(kept) == ANCHORS):
                    yield block(number, kept)
                    number, kept, wider = number + 1, [], len(v)
                kept.append((*head, v, s, n))
                width = wider
        if kept:
            yield block(number, kept)

    return run


def _search(use):
    """A task's blocks of candidates come first and are held; use(anchors, candidates) then gives rows for each block of anchors."""

    def run(batches):
        held = []
        for batch in batches:
            for row in (batch.slice(j, 1).to_pylist()[0] for j in range(len(batch))):
                own = {c: np.frombuffer(row[c], "<i8") for c in ("ids", "marks", "labels", "rows")}
                own["vectors"] = np.frombuffer(row["vectors"], "<f8").reshape(len(own["ids"]), -1)
                if not row["asks"]:
                    held.append(own)
                    continue
                for candidates in held:
                    width = min(own["vectors"].shape[1], candidates["vectors"].shape[1])
                    scores = exact_products(own["vectors"][:, :width], candidates["vectors"][:, :width])
                    if found := list(use(own | {"limits": row["limits"], "names": row["names"]}, candidates, scores)):
                        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*found), _KINDS)], names=["anchor", "mark", "rows", "place", "positive", "limit", "vec_id", "score"])

    return run


FOUND = "anchor long, mark long, rows long, place int, positive long, limit binary, vec_id long, score binary"
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]


def _sorted(scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Places of `own` by score, the highest first, ties by smaller id."""
    if scores.dtype == object:
        return np.array(sorted(own.tolist(), key=lambda j: (-scores[j], ids[j])), np.int64)
    return own[np.lexsort((ids[own], -scores[own]))]


def _positives(k: int):
    """The k best rows of an anchor's label in a block of candidates, but itself."""

    def use(anchors, candidates, scores):
        for q, (i, mark, label, rows) in enumerate(zip(*(anchors[c].tolist() for c in ("ids", "marks", "labels", "rows")))):
            own = np.flatnonzero((candidates["labels"] == label) & ~((candidates["ids"] == i) & (candidates["marks"] == mark)))
            for j in _sorted(scores[q], candidates["ids"], own)[:k].tolist():
                yield i, mark, rows, None, None, None, int(candidates["ids"][j]), order_key(int(scores[q, j]))

    return use


def _negatives(k: int, low: int, high: int):
    """Of a block of candidates the k first rows of other labels at or under each positive's upper limit, down to its lower limit."""

    def use(anchors, candidates, scores):
        for q, (i, mark, label, rows) in enumerate(zip(*(anchors[c].tolist() for c in ("ids", "marks", "labels", "rows")))):
            order = _sorted(scores[q], candidates["ids"], np.flatnonzero(candidates["labels"] != label))
            ascending = scores[q][order][::-1]
            for place, (limit, positive) in enumerate(zip(anchors["limits"][q], anchors["names"][q])):
                most = high * from_order_key(limit) // 100
                least = -(-low * from_order_key(limit) // 100)
                if ascending.dtype != object:  # limits beyond a long are beyond all scores
                    most, least = (min(max(x, _LONG[0]), _LONG[1]) for x in (most, least))
                # Places from the top: the first that is not above the upper limit, and the first that is under the lower one.
                first = len(order) - int(np.searchsorted(ascending, most, "right"))
                end = len(order) - int(np.searchsorted(ascending, least, "left"))
                for j in order[first : min(end, first + k)].tolist():
                    yield i, mark, rows, place, positive, limit, int(candidates["ids"][j]), order_key(int(scores[q, j]))

    return use


def _clipped(key: str) -> Column:
    @F.pandas_udf("long")
    def number(keys):
        return keys.map(lambda x: min(max(from_order_key(x), _LONG[0]), _LONG[1]))

    return number(F.col(key))


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, key: str = "vec_id", label: str = "label", vector: str = "embedding",
    groups: int | None = None,
) -> DataFrame:
    """anchor_id, positive_id, place (of the positive, from 1), rank (from 1), negative_id, positive_score, negative_score.

    Components count as floor(scale * x) and scores are inner products. The `positives` best other rows of its label are an anchor's positives; for each, the
    `negatives` best rows of other labels follow whose score is from `low` to `high` percent of the positive's. Ties go to smaller ids.

    Candidates are packed into blocks by bytes and dealt to groups, as many as the bytes need; a task holds a group and reads the blocks of anchors, which go to
    each group. There all scores of an anchor are computed and sorted, each positive's limits are searched in them, and no more than what may be
    among the best of all groups is handed on; the best of the groups meet by anchor. This runs twice, as limits come from all groups' positives.

    Rows with a null id, label or vector, or a component that is null or not finite, take no part; shorter vectors count as padded with zeros; empty ones score 0. Repeated
    rows are candidates each, and an anchor's candidates are all rows but itself; repeated anchor rows have results of their own. Scores are exact at any
    size, and are given as the nearest long; a scaled component that no double holds counts as the largest one. Without positives or rows within the limits an anchor has no rows; an empty table gives none; other columns are not read.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole_vector(vector).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("q"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    mark, none, one = F.xxhash64("label", "v").bitwiseOR(F.lit(1)), F.lit(0).cast("long"), F.lit(1).cast("long")
    asked = rows.where("q").groupBy("id", "label", "v").agg(F.count("*").alias("rows"))
    # Of equal anchor rows the first is the anchor's own row; no more than this of the others can be among its best.
    again = asked.select("id", F.explode(F.sequence(F.lit(1), F.least("rows", F.lit(max(positives, negatives) + 1)).cast("int"))).alias("j"), "label", "v")
    candidates = rows.where("NOT q").select("id", none.alias("mark"), "label", one.alias("rows"), "v").unionAll(again.select("id", F.when(F.col("j") == 1, mark).otherwise(none), "label", one, "v"))
    total = rows.agg(F.sum(8 * F.size("v").cast("long"))).first()[0] or 0
    groups = groups or max(partitions(vectors.sparkSession), -(-total // HELD_BYTES))
    # Blocks are numbered by partition and place in it, which deals them evenly.
    group = F.pmod(F.shiftright("number", 32) + F.col("number").bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(groups)).cast("int")
    blocks = candidates.mapInArrow(_blocks(False, scale), BLOCKS).withColumn("g", group)

    def searched(anchors: DataFrame, use) -> DataFrame:
        everywhere = anchors.mapInArrow(_blocks(True, scale), BLOCKS).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        return blocks.unionByName(everywhere).repartitionById(groups, F.col("g")).sortWithinPartitions("asks", "number").mapInArrow(_search(use), FOUND)

    anchors = asked.select("id", mark.alias("mark"), "label", "rows", "v")
    best = Window.partitionBy("anchor", "mark").orderBy(F.desc("score"), "vec_id")
    near = searched(anchors, _positives(positives)).withColumn("n", F.row_number().over(best)).where(F.col("n") <= positives)
    near = near.groupBy("anchor", "mark").agg(F.array_sort(F.collect_list(F.struct("n", "score", "vec_id"))).alias("p"))  # `positives` rows an anchor
    near = staged(near.select(F.col("anchor").alias("id"), "mark", F.col("p.score").alias("limits"), F.col("p.vec_id").alias("names")), "positives")
    limited = anchors.join(near, ["id", "mark"]).select("id", "mark", "label", "rows", "v", "limits", "names")
    best = Window.partitionBy("anchor", "mark", "place").orderBy(F.desc("score"), "vec_id")
    found = searched(limited, _negatives(negatives, low, high)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    found = found.withColumn("_row", F.explode(F.sequence(one, F.col("rows"))))
    return found.select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), (F.col("place") + 1).alias("place"), "rank", F.col("vec_id").alias("negative_id"),
        _clipped("limit").alias("positive_score"), _clipped("score").alias("negative_score"),
    )
