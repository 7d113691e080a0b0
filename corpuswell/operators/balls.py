"""Exact nearest vectors by cosine in balls: blocks of like vectors, of which a query leaves those that can hold nothing good enough."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuswell.operators.ranking import ranked
from corpuswell.operators.vectors import BROADCAST_BYTES, BROADCAST_QUERIES, cosine_scores
from corpuswell.staging import staged

#: Pivots at most, which are drawn from the rows by a hash; rows of a ball; balls that a query looks into for its first bound.
PIVOTS, ROWS, FIRST = 512, 1024, 2
_SLACK = 1e-8
BALLS = "ball long, ids array<bigint>, vectors binary, width int, centre array<double>, reach double"
_NAMES = [c.split()[0] for c in BALLS.split(", ")]


def _units(column, width: int | None = None) -> np.ndarray:
    """Vectors of an Arrow column as rows of length 1; a null vector is zero, a shorter one is filled up with zeros."""
    rows = [np.nan_to_num(np.array(v.as_py() or [], float)) for v in column]
    packed = np.zeros((len(rows), max([width or 0, *map(len, rows)])))
    for row, v in zip(packed, rows):
        row[: len(v)] = v
    return packed / np.maximum(np.sqrt((packed * packed).sum(axis=1, keepdims=True)), 1e-300)


def _nearest_pivot(pivots: np.ndarray):
    def run(batches):
        for batch in batches:
            if len(batch):
                v = _units(batch.column(1))
                width = min(v.shape[1], pivots.shape[1])
                near = (v[:, :width] @ pivots[:, :width].T).argmax(axis=1) if len(pivots) else np.zeros(len(v), int)
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(near.astype(np.int32))], ["vec_id", "embedding", "pivot"])

    return run


def _ball(number: int, ids: list, v: np.ndarray) -> pa.RecordBatch:
    """A ball's centre, and the cosine of the angle that holds all its vectors around it; a zero vector is at a right angle to everything, so it makes the ball reach everywhere."""
    centre = v.mean(axis=0)
    size = np.sqrt(centre @ centre)
    centre = centre / size if size > 1e-12 else np.zeros_like(centre)
    reach = float((v @ centre).min()) if size > 1e-12 else -1.0
    if not (v != 0).any(axis=1).all():
        reach = -1.0
    return pa.record_batch([pa.array([x], t) for x, t in zip((number, ids, v.tobytes(), v.shape[1], centre.tolist(), max(-1.0, reach - _SLACK)), (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.list_(pa.float64()), pa.float64()))], _NAMES)


def _balls(size: int):
    """Rows of a partition, sorted by pivot, as balls of up to `size` vectors of one pivot."""

    def run(batches):
        number, ids, held, pivot = TaskContext.get().partitionId() << 32, [], [], None
        for batch in batches:
            for i, v, p in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                if ids and (p != pivot or len(ids) == size):
                    yield _ball(number, ids, _units(held))
                    number, ids, held = number + 1, [], []
                pivot = p
                ids.append(i)
                held.append(v)
        if ids:
            yield _ball(number, ids, _units(held))

    return run


def balls(vectors: DataFrame) -> DataFrame:
    """The index of vectors (vec_id, embedding), staged. Each row goes to its most similar pivot; pivots of very many rows are dealt to several tasks, and each ball
    knows its own centre and reach. Rows without vec_id leave."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL")
    some = rows.where("size(embedding) > 0").orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).select("embedding").toArrow()  # PIVOTS rows
    pivots = _units(some.column(0)) if len(some) else np.zeros((0, 0))
    near = rows.mapInArrow(_nearest_pivot(pivots), "vec_id long, embedding array<double>, pivot int")
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = near.repartitionByRange(tasks, "pivot", F.xxhash64("vec_id")).sortWithinPartitions("pivot")
    return staged(dealt.mapInArrow(_balls(ROWS), BALLS), "balls")


def open_balls(queries: np.ndarray, floors: np.ndarray, centre: np.ndarray, reach: float) -> np.ndarray:
    """Which queries may find something as good as their floor in a ball: the angle to its centre less its reach bounds the angle to all it holds."""
    width = min(queries.shape[1], len(centre))
    angle = np.arccos(np.clip(queries[:, :width] @ centre[:width], -1, 1)) - np.arccos(np.clip(reach, -1, 1))
    return np.cos(np.maximum(angle, 0)) >= floors - _SLACK


def _best(asked: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, exclude_self: bool):
    """The k best rows of a ball for each of some queries."""
    width = min(v.shape[1], q.shape[1])
    for lo in range(0, len(asked), 64):
        own = np.round(q[lo : lo + 64, :width] @ v[:, :width].T, 9) + 0.0
        if exclude_self:
            own = np.where(ids == asked[lo : lo + 64, None], -np.inf, own)
        order = np.lexsort((np.broadcast_to(ids, own.shape), -own), axis=1)[:, :k]
        who, which = np.repeat(np.arange(len(own)), order.shape[1]), order.ravel()
        good = np.isfinite(own[who, which])
        yield pa.record_batch([pa.array(asked[lo + who[good]]), pa.array(ids[which[good]]), pa.array(own[who[good], which[good]])], ["query_id", "vec_id", "score"])


def _first(k: int, exclude_self: bool):
    """Rows of a ball and one query that looks into it."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                v = np.frombuffer(row["vectors"]).reshape(len(row["ids"]), -1)
                yield from _best(np.array([row["query"]]), _units(pa.array([row["embedding"]], pa.list_(pa.float64()))), np.array(row["ids"]), v, k, exclude_self)

    return run


def _search(k: int, exclude_self: bool):
    def run(batches):
        for batch in batches:
            for at in range(len(batch)):
                row = batch.slice(at, 1).to_pylist()[0]
                ids, asked = np.array(row["ids"]), np.array(row["q_ids"])
                v, q = np.frombuffer(row["vectors"]).reshape(len(ids), -1), np.frombuffer(row["q_vectors"]).reshape(len(asked), -1)
                some = open_balls(q, np.frombuffer(row["floors"]), np.array(row["centre"]), row["reach"])
                yield from _best(asked[some], q[some], ids, v, k, exclude_self)

    return run


def _pack(batches):
    for batch in batches:
        for lo in range(0, len(batch), ROWS):
            part = batch.slice(lo, ROWS)
            floors = np.array(part.column(2).to_pylist(), float)
            yield pa.record_batch([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([_units(part.column(1)).tobytes()]), pa.array([floors.tobytes()])], ["q_ids", "q_vectors", "floors"])


FOUND = "query_id long, vec_id long, score double"


def nearest(queries: DataFrame, index: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """query_id, vec_id, score, rank of the k vectors of an index (see balls) that are most like each query (vec_id, embedding) by cosine, rounded to nine digits; ties go to smaller ids.

    A query first looks into the FIRST balls whose centres are nearest, which gives it a score that the k best have at least. Then each ball meets the queries, and only
    those whose bound there is not under that score are multiplied with it: the result is exact. Up to BROADCAST_QUERIES queries are broadcast, by count and bytes; more are dealt to groups.
    """
    asked = staged(queries.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL"), "asked")
    centres = index.select(F.col("ball").alias("vec_id"), F.col("centre").alias("embedding"))
    probes = ranked(cosine_scores(asked, centres, k=FIRST), FIRST).select("query_id", F.col("vec_id").alias("ball"))
    looks = probes.join(asked.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id").select("ball", F.col("query_id").alias("query"), "embedding")
    met = index.join(looks, "ball").select("ids", "vectors", "query", "embedding")
    seen = met.mapInArrow(_first(k, exclude_self), FOUND)
    floors = ranked(seen, k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).otherwise(F.lit(-2.0)).alias("floor"))
    bounded = asked.join(floors, asked["vec_id"] == floors["query_id"], "left").select("vec_id", "embedding", F.coalesce("floor", F.lit(-2.0)).alias("floor"))
    packs = bounded.mapInArrow(_pack, "q_ids array<bigint>, q_vectors binary, floors binary")
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("width")).first()
    if size["n"] <= BROADCAST_QUERIES and 8 * size["n"] * max(0, size["width"]) <= BROADCAST_BYTES:
        pairs = index.crossJoin(F.broadcast(packs))
    else:
        groups = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = packs.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        pairs = index.withColumn("_g", F.pmod(F.xxhash64("ball"), F.lit(groups)).cast("int")).join(dealt, "_g").drop("_g")
    return ranked(pairs.mapInArrow(_search(k, exclude_self), FOUND), k)
