"""Vectors: hashed embeddings, cosine similarity of stated queries with all rows."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswell.operators.listing import hashed, listed
from corpuswell.staging import staged

#: Queries that are broadcast at most; more of them are dealt out by a shuffle. Where they are vectors, their bytes have a limit too.
BROADCAST_QUERIES = 100_000
#: Queries from which on the multiplication of a vector costs far more than a shuffle of it.
MANY_QUERIES = 2_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if one is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


#: Bytes of texts whose words are looked at together.
TEXT_BYTES = 4 << 20


def _embedded(texts: pa.Array, width: int) -> np.ndarray:
    """The vectors of hash_embedding, of texts in lower case."""
    texts, out = texts.cast(pa.string()).fill_null(""), np.zeros((len(texts), width))
    step = max(1, TEXT_BYTES * len(texts) // max(1, texts.nbytes))
    for lo in range(0, len(texts), step):
        found = listed(texts.slice(lo, step))
        n, coded = len(found), found.values.dictionary_encode()
        cells = np.repeat(np.arange(n) * width, np.diff(np.asarray(found.offsets)))
        cells += (hashed(coded.dictionary) % width)[np.asarray(coded.indices)]
        out[lo : lo + n] = np.bincount(cells, minlength=n * width).reshape(n, width)
    out /= np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1)  # counts are whole numbers, so a length is 0 or at least 1
    return out


def hash_embedding(text: Column, width: int = 64) -> Column:
    """A unit vector of word counts, hashed to `width` numbers by MD5; the zero vector without words.

    Made in Arrow batches, where each distinct word is hashed once. It has no place inside a lambda, as no Python function has; see hash_likeness.
    """

    def run(texts: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * width), _embedded(texts, width).ravel())

    return F.arrow_udf(run, "array<double>")(F.lower(text))


def hash_likeness(texts: Column, width: int = 64) -> Column:
    """Of each text of an array how like its hash_embedding is to that of the text before; what stands at the first says nothing."""

    def run(rows: pa.Array) -> pa.Array:
        ends = np.append(0, np.cumsum(np.asarray(rows.value_lengths().fill_null(0)))).astype(np.int32)
        v = _embedded(rows.flatten(), width)
        like = np.append(np.zeros(min(1, len(v))), (v[1:] * v[:-1]).sum(axis=1))
        return pa.ListArray.from_arrays(pa.array(ends), like, mask=rows.is_null())

    return F.arrow_udf(run, "array<double>")(F.transform(texts, F.lower))


def against_all(queries: DataFrame, rows: DataFrame, most: int = BROADCAST_QUERIES) -> DataFrame:
    """Each row with each query. Up to `most` queries are broadcast, by count; more are dealt to groups by a shuffle."""
    if queries.limit(most + 1).count() <= most:
        return rows.crossJoin(F.broadcast(queries))
    groups = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = queries.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return rows.withColumn("_g", F.pmod(F.xxhash64(*rows.columns), F.lit(groups)).cast("int")).join(dealt, "_g").drop("_g")


#: Rows of a block of vectors, and bytes of query vectors that are broadcast at most.
BLOCK, BROADCAST_BYTES = 1024, 64 << 20
#: Best rows that a task holds about at once.
HELD = 4_000_000
_BLOCKS = "ids array<bigint>, vectors binary, width int"


def unit_rows(column: pa.Array) -> np.ndarray:
    """A column of lists as rows of length 1; a null vector is zero, a shorter one is filled up with zeros."""
    flat, ends = column.flatten(), np.unique(np.asarray(column.value_lengths().fill_null(-1)))
    if len(ends) == 1 and ends[0] > 0:  # all of one length, as they mostly are
        packed = np.nan_to_num(np.array(flat.to_numpy(zero_copy_only=False), float)).reshape(-1, ends[0])
    else:
        rows = [np.nan_to_num(np.array(v.as_py() or [], float)) for v in column]
        packed = np.zeros((len(rows), max(map(len, rows), default=0)))
        for row, v in zip(packed, rows):
            row[: len(v)] = v
    packed /= np.maximum(np.sqrt((packed * packed).sum(axis=1, keepdims=True)), 1e-300)
    return packed


def _pack(batches):
    """Rows (id, vector, numbers) as blocks of unit vectors; the numbers, if there are any, stand beside as lists."""
    for batch in batches:
        for lo in range(0, len(batch), BLOCK):
            part = batch.slice(lo, BLOCK)
            packed = unit_rows(part.column(1))
            more = [pa.array([part.column(c).to_pylist()], pa.list_(pa.float64())) for c in range(2, part.num_columns)]
            yield pa.record_batch([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([packed.tobytes()]), pa.array([packed.shape[1]], pa.int32()), *more], ["ids", "vectors", "width", *part.schema.names[2:]])


def _block_scores(row: dict, exclude_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, query ids, scores of a block of vectors with a block of queries, and which of them count."""
    ids, asked = np.array(row["ids"], np.int64), np.array(row["q_ids"], np.int64)
    v, q = (np.frombuffer(row[c]).reshape(len(i), -1) for c, i in (("vectors", ids), ("q_vectors", asked)))
    width = min(v.shape[1], q.shape[1])
    scores = np.round(q[:, :width] @ v[:, :width].T, 9) + 0.0
    return ids, asked, scores, ids[None, :] != asked[:, None] if exclude_self else np.ones(scores.shape, bool)


def _extremes(exclude_self: bool):
    """The least and the largest score of each query among the vectors that a task meets."""

    def run(batches):
        found: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for at in range(len(batch)):
                ids, asked, scores, take = _block_scores(batch.slice(at, 1).to_pylist()[0], exclude_self)
                low, high = found.get(asked.tobytes(), (np.inf, -np.inf))
                found[asked.tobytes()] = np.minimum(low, np.where(take, scores, np.inf).min(axis=1)), np.maximum(high, np.where(take, scores, -np.inf).max(axis=1))
        for key, (low, high) in found.items():
            some = low <= high
            yield pa.record_batch([pa.array(np.frombuffer(key, np.int64)[some]), pa.array(low[some]), pa.array(high[some])], ["query_id", "low", "high"])

    return run


class Best:
    """The rows with the `most` best bounds of each of n queries, of equal bounds those with smaller ids; what comes is kept until there is enough to sort."""

    def __init__(self, n: int, most: int):
        self.most, self.floor, self.rows, self.sorted = most, np.full(n, -np.inf), [], 0

    def add(self, ids: np.ndarray, score: np.ndarray, bound: np.ndarray) -> None:
        floor = self.floor
        if not self.rows and len(ids) > self.most:
            floor = -np.partition(-bound, self.most - 1, axis=1)[:, self.most - 1]
        who, which = np.nonzero((bound >= floor[:, None]) & (bound > -np.inf))
        self.rows.append((who, ids[which], score[who, which], bound[who, which]))
        if sum(len(r[0]) for r in self.rows) > max(2 * self.sorted, self.most * len(self.floor)):
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        who, ids, score, bound = (np.concatenate(c) for c in zip(*self.rows))
        order = np.lexsort((ids, -bound, who))
        who = who[order]
        first = np.flatnonzero(np.append(True, who[1:] != who[:-1]))[: len(who)]
        place = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who))))
        kept = place < self.most
        self.rows = [(who[kept], ids[order][kept], score[order][kept], bound[order][kept])]
        full = place == self.most - 1
        self.floor[who[full]] = bound[order][full]
        self.sorted = len(self.rows[0][0])
        return self.rows[0]


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """x rounded to some digits as a column's round does: by its decimals, halves away from zero. Only what is next to a half is looked at as decimals."""
    far = np.abs(x) * 10.0**digits
    whole = np.floor(far)
    out = np.copysign((whole + (far - whole >= 0.5)) / 10.0**digits, x) + 0.0
    for at in zip(*np.nonzero(np.abs(far - whole - 0.5) < 1e-6)):
        out[at] = float(Decimal(repr(float(x[at]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) + 0.0
    return out


def _multiply(exclude_self: bool, k: int | None, later: bool = False, digits: int | None = None):
    """Scores of blocks, rounded to `digits` if given; with k the best of each query among all the vectors that a task meets, handed on before there are more than HELD of them."""
    sign = -1 if later else 1

    def best_of(found: dict[bytes, Best]):
        for key, own in found.items():
            who, ids, _, score = own.settle()
            yield from pa.table([np.frombuffer(key, np.int64)[who], sign * ids, score], ["query_id", "vec_id", "score"]).to_batches(1 << 16)

    def run(batches):
        found: dict[bytes, Best] = {}
        for batch in batches:
            for at in range(len(batch)):
                row = batch.slice(at, 1).to_pylist()[0]
                ids, asked, scores, counted = _block_scores(row, exclude_self)
                if k is not None:
                    key = asked.tobytes()
                    if key not in found and sum(len(b.floor) for b in found.values()) * k > HELD:
                        yield from best_of(found)
                        found = {}
                    scores[~counted] = -np.inf
                    found.setdefault(key, Best(len(asked), k)).add(sign * ids, scores, scores)
                    continue
                if "low" in row:
                    low, span = np.array(row["low"])[:, None], (np.array(row["high"]) - np.array(row["low"]))[:, None]
                    scores = np.where(span < 1e-12, 1.0, (scores - low) / (span + 1e-12))
                if digits is not None:
                    scores = half_up(scores, digits)
                for lo in range(0, len(asked), 64):
                    own, take = scores[lo : lo + 64], counted[lo : lo + 64]
                    who, which = np.nonzero(take)
                    yield pa.record_batch([pa.array(asked[lo + who]), pa.array(ids[which]), pa.array(own[who, which])], ["query_id", "vec_id", "score"])
        yield from best_of(found)

    return run


def wide(df: DataFrame) -> DataFrame:
    return df.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL")


def _squeeze(batches):
    """Blocks of _pack with their vectors compressed: those of word counts hold few different numbers."""
    for batch in _pack(batches):
        yield batch.set_column(1, "vectors", pa.array([pa.compress(batch.column(1)[0].as_buffer(), "zstd").to_pybytes()]))


def squeezed(vectors: DataFrame) -> DataFrame:
    """The blocks of vectors, packed and compressed, for what reads them some times."""
    return wide(vectors).mapInArrow(_squeeze, _BLOCKS)


def loosened(cell: bytes, rows: int, width: int) -> np.ndarray:
    """The vectors of a block of `squeezed`."""
    return np.frombuffer(pa.decompress(cell, 8 * rows * width, "zstd") if rows * width else b"").reshape(rows, -1 if width else 0)


def size_of(queries: DataFrame):
    """n and width: how many queries there are, and of how many numbers."""
    return queries.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("width")).first()


def blocks_with(queries: DataFrame, asked: DataFrame, vectors: DataFrame, sides: int = 1, size=None) -> DataFrame:
    """Each block of vectors (rows, or the blocks that `squeezed` has made of them) with each block of `asked`, which is made of queries and holds `sides` vectors
    of each. Query blocks are broadcast up to BROADCAST_QUERIES rows and BROADCAST_BYTES, by measure; more are dealt to groups by a shuffle. For MANY_QUERIES blocks are dealt evenly
    to the shuffle's partitions, as work then grows with the square of a table that may be a few files. size: size_of(queries), where it is known."""
    blocks = vectors if "ids" in vectors.columns else wide(vectors).mapInArrow(_pack, _BLOCKS)
    size = size or size_of(queries)
    groups = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if size["n"] <= BROADCAST_QUERIES and 8 * sides * size["n"] * size["width"] <= BROADCAST_BYTES:
        return (blocks.repartition(groups) if size["n"] >= MANY_QUERIES else blocks).crossJoin(F.broadcast(asked))
    dealt = asked.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return blocks.withColumn("_g", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int")).join(dealt, "_g").drop("_g")


def cosine_scores(queries: DataFrame, vectors: DataFrame, exclude_self: bool = False, k: int | None = None, later: bool = False, digits: int | None = None) -> DataFrame:
    """query_id, vec_id, score of each query with all vectors (rounded to 9 digits, so that ties are the same everywhere; without k then to `digits`, if given).

    Vectors are scaled to length 1 once and multiplied block by block. With k a task hands on no more than the k best for each query of all the
    vectors that it met, ties to the smaller vec_id (with later: the larger), so that little is shuffled where only the best are asked for.
    """
    asked = wide(queries).mapInArrow(_pack, _BLOCKS).withColumnsRenamed({"ids": "q_ids", "vectors": "q_vectors", "width": "q_width"})
    return blocks_with(queries, asked, vectors).mapInArrow(_multiply(exclude_self, k, later, digits), "query_id long, vec_id long, score double")


def scaled_scores(queries: DataFrame, vectors: DataFrame, exclude_self: bool = False, digits: int | None = None) -> DataFrame:
    """cosine_scores, those of each query scaled to 0 to 1 between its least and its largest; 1 throughout where all are equal. digits: what is scaled is rounded to them.

    A first pass over blocks gives the limits, two numbers for each query and task; a second makes the scores again and scales them where they are made, so that
    no pair is shuffled or written before it is handed on. vectors are read twice, so they should be a table.
    """
    names = {"ids": "q_ids", "vectors": "q_vectors", "width": "q_width"}
    asked = wide(queries).mapInArrow(_pack, _BLOCKS).withColumnsRenamed(names)
    each = blocks_with(queries, asked, vectors).mapInArrow(_extremes(exclude_self), "query_id long, low double, high double")
    limits = each.groupBy("query_id").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    known = staged(wide(queries).join(limits.withColumnRenamed("query_id", "vec_id"), "vec_id"), "limits")
    asked = known.mapInArrow(_pack, _BLOCKS + ", low array<double>, high array<double>").withColumnsRenamed(names)
    return blocks_with(known, asked, vectors).mapInArrow(_multiply(exclude_self, None, digits=digits), "query_id long, vec_id long, score double")
