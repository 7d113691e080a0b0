"""What the operators of this subpackage share: staging in the cluster's folder, and document access."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswell.staging import shared_dir, staged

__all__ = ["dealt_join", "digest", "partitions", "shared_dir", "staged", "text_bytes", "whole_text"]

#: A key that holds more than one in SHARE rows of a join is dealt to several tasks; there are fewer than SHARE such keys.
SHARE = 1024


def partitions(spark: SparkSession) -> int:
    """How many partitions a shuffle of this session has."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_text(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def text_bytes(rows: DataFrame, text: str = "text") -> int:
    """Bytes of all texts, by which a job is cut to tasks."""
    return rows.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0


def dealt_join(rows: DataFrame, small: DataFrame, keys: list[str], counts: DataFrame, total: int, how: str = "inner") -> DataFrame:
    """rows joined with small, which has few rows a key, without a task that gets a hot key whole.

    counts has one row for each key, with how many rows hold it in c; total is the sum of c or more. The rows of a hot key
    are dealt to pieces, a power of two of them, by a hash of all their columns, and small's rows are copied to each piece. Hot keys are fewer than SHARE at
    every size of the tables, so they are looked up first and told by their hashes; without any it is a plain join. Keys are not null.
    """
    pieces = F.ceil(F.log2(F.col("c") * SHARE / F.lit(max(total, 1)))).cast("int")
    hot: dict[int, list[int]] = {}
    for row in counts.where(F.col("c") * SHARE > total).select(F.xxhash64(*keys).alias("h"), F.greatest(pieces, F.lit(1)).alias("p")).collect():
        hot.setdefault(row["p"], []).append(row["h"])
    if not hot:
        return rows.join(small, keys, how)
    piece, copies = F.lit(0), F.lit(1)
    for power, hashes in hot.items():
        held = F.xxhash64(*keys).isin(hashes)
        piece = F.when(held, F.pmod(F.xxhash64(*rows.columns), F.lit(1 << power)).cast("int")).otherwise(piece)
        copies = F.when(held, F.lit(1 << power)).otherwise(copies)
    dealt = rows.withColumn("_piece", piece)
    copied = small.withColumn("_piece", F.explode(F.sequence(F.lit(0), copies - 1)))
    return dealt.join(copied, [*keys, "_piece"], how).drop("_piece")


def digest(*parts: bytes) -> int:
    """64 bits that tell whether a block that was made twice has the same rows."""
    h = hashlib.blake2b(digest_size=8)
    for p in parts:
        h.update(p)
    return int.from_bytes(h.digest(), "little", signed=True)
