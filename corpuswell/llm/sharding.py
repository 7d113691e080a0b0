"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix."""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuswell.llm._shared import staged, whole_text


def hypergeometric(rng: random.Random, good: int, total: int, drawn: int) -> int:
    """How many of `drawn` rows taken without replacement from `total` are among the `good` ones.

    Inversion that walks outwards from the mode; its steps are about the standard deviation.
    """
    low, high = max(0, drawn - (total - good)), min(drawn, good)
    if low == high:
        return low
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (total + 2)))
    lg = math.lgamma
    log_choose = lambda n, k: lg(n + 1) - lg(k + 1) - lg(n - k + 1)
    p = math.exp(log_choose(good, mode) + log_choose(total - good, drawn - mode) - log_choose(total, drawn))
    up = down = mode
    p_up = p_down = p
    left = rng.random() - p
    while left > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (drawn - up) / ((up + 1) * (total - good - drawn + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (total - good - drawn + down) / ((good - down + 1) * (drawn - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
    return mode


def communication_matrix(rows: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Counts of rows that partition i sends to shard j, as a uniform shuffle would have them.

    Row sums are `rows`, column sums are `shards`; each entry is drawn given all before it.
    """
    rng, room, matrix = random.Random(seed), list(shards), []
    for n in rows:
        sent, need, open_ = [], n, sum(room)
        for free in room:
            k = hypergeometric(rng, free, open_, need)
            sent.append(k)
            need, open_ = need - k, open_ - free
        room = [a - b for a, b in zip(room, sent)]
        matrix.append(sent)
    return matrix


def shuffle_into_shards(
    docs: DataFrame,
    n_shards: int = 16,
    seed: int = 42,
    key: str = "doc_id",
    text: str = "text",
    rows_per_partition: int = 5000,
    max_partitions: int = 50_000,
    carry: list[str] | None = None,
) -> DataFrame:
    """Gives each row a `shard` (sizes at most one apart) and a gapless `slot` in it, uniformly at random.

    Rows are dealt to P logical partitions by hash; an exact matrix of partition-to-shard counts is drawn
    (P grows with the rows up to `max_partitions`, so the matrix is bounded); each partition permutes its
    rows and cuts them by its row of the matrix; after the exchange each shard permutes again, in
    buckets of about `rows_per_partition` rows, so that no task holds a whole shard. All of it is a function of seed and rows: a
    lost task gives the same rows again.

    Columns out: `carry` (all of docs by default), shard int, slot long. Clashing names in docs are replaced.
    Null or empty texts are rows as any other; a null key is a value of its own; repeated rows get a
    slot each (which of equal rows gets which slot does not show); an empty table gives no rows.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ("shard", "slot")]
    spark = docs.sparkSession
    body = F.struct(*carry)
    mark = [F.col(key), F.crc32(whole_text(text).cast("binary")), F.length(whole_text(text))]
    draw = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), *mark)
    n = docs.count()
    per = max(rows_per_partition, -(-n // max_partitions))
    parts = max(1, -(-n // per))
    sizes = [n // n_shards + (j < n % n_shards) for j in range(n_shards)]
    buckets = max(1, -(-max(sizes) // per))
    rows = docs.select(
        body.alias("body"),
        F.pmod(draw("partition"), F.lit(parts)).cast("int").alias("part"),
        draw("local").alias("k1"),
        F.pmod(draw("bucket"), F.lit(buckets)).cast("int").alias("bucket"),
        draw("slot").alias("k2"),
    )
    held = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}
    matrix = communication_matrix([held.get(i, 0) for i in range(parts)], sizes, seed)
    cuts = spark.sql("SELECT posexplode(from_json(:m, 'array<array<bigint>>')) AS (part, sends)", args={"m": json.dumps(matrix)}).select(
        "part", F.expr("transform(sends, (x, i) -> aggregate(slice(sends, 1, i + 1), 0L, (a, b) -> a + b))").alias("ends")
    )
    local = rows.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("k1", "k2", F.xxhash64("body"))))
    dealt = local.join(cuts, "part").select("body", "bucket", "k1", "k2", F.expr("size(filter(ends, e -> e < rank))").alias("shard"))
    dealt = staged(dealt, "dealt")
    counts = dealt.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    order = Window.partitionBy("shard", "bucket").orderBy("k2", "k1", F.xxhash64("body"))
    placed = dealt.withColumn("rank", F.row_number().over(order)).join(offsets, ["shard", "bucket"])
    return placed.select("body.*", "shard", (F.col("offset") + F.col("rank") - 1).alias("slot"))
