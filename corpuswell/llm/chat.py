"""Chat formatting: cumulative snapshots of a conversation collapse to the longest before rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuswell.llm._shared import staged

#: Turns that are numbered and hashed together; a longer conversation is split over tasks.
SPAN = 1024


def _hash_parts(seed: int, *columns: Column) -> list[Column]:
    """128 bits as four numbers whose sums stay exact, so that a prefix's hash is a running sum."""
    parts = []
    for salt in (seed, seed + 1):
        h = F.xxhash64(F.lit(salt), *columns)
        parts += [h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)]
    return parts


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, idx, role, text, h0..h3): idx counts the n_turns turns of a conversation from 1, h0..h3 hash its
    first idx turns.

    The hash of a prefix is the sum of the hashes of (idx, role, text). Numbers and sums run within spans of
    the turn column; span totals carry them over, so that a conversation with a third of all rows
    is not one task. Turns order by turn, role, text; null turns come first; null conv_id rows are one conversation.
    """
    spans = turns.select("conv_id", "turn", "role", "text", F.floor(F.col("turn") / SPAN).alias("span"))
    before = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"]) & a["span"].eqNullSafe(b["span"])
    inside = Window.partitionBy("conv_id", "span").orderBy("turn", "role", "text")
    sizes = spans.groupBy("conv_id", "span").count()
    n_turns = F.sum("count").over(Window.partitionBy("conv_id"))
    starts = sizes.select("conv_id", "span", carried("count").alias("n_before"), n_turns.alias("n_turns"))
    ranked = spans.withColumn("rank", F.row_number().over(inside))
    numbered = ranked.join(starts, same(ranked, starts)).select(
        ranked["conv_id"], ranked["span"], "n_turns", "turn", "role", "text", (F.col("n_before") + F.col("rank")).alias("idx")
    )
    hashed = numbered.select("*", *[h.alias(f"t{k}") for k, h in enumerate(_hash_parts(17, F.col("idx"), F.col("role").isNull(), "role", F.col("text").isNull(), "text"))])
    sums = hashed.groupBy("conv_id", "span").agg(*[F.sum(f"t{k}").alias(f"t{k}") for k in range(4)])
    carry = sums.select("conv_id", "span", *[carried(f"t{k}").alias(f"c{k}") for k in range(4)])
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = hashed.select("conv_id", "n_turns", "span", "idx", "role", "text", *[F.sum(f"t{k}").over(running).alias(f"s{k}") for k in range(4)])
    return local.join(carry, same(local, carry)).select(
        local["conv_id"], "n_turns", "idx", "role", "text", *[(F.col(f"s{k}") + F.col(f"c{k}")).alias(f"h{k}") for k in range(4)]
    )


def maximal_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, prefixes): kept has conv_id and n_turns of the conversations that no longer one begins with;
    of equal conversations the one with the smallest conv_id stays (null last). prefixes: staged prefix_hashes.

    Ends and prefixes that conversations share are one row each after map-side partial aggregates, so neither a common
    first turn nor many equal conversations are a hot key of the anti-join, whose keys are distinct on both sides.
    """
    keys = ["idx", *[f"h{k}" for k in range(4)]]
    prefixes = staged(prefix_hashes(turns), "prefixes")
    ends = prefixes.where("idx = n_turns").groupBy(*keys).agg(F.min("conv_id").alias("conv_id"))
    # A prefix is longer than a conversation's end if some conversation holds it before its own last turn.
    inner = prefixes.where("idx < n_turns").select(*keys).distinct()
    kept = ends.join(inner, keys, "left_anti").select("conv_id", F.col("idx").alias("n_turns"))
    return kept, prefixes


def format_chats(turns: DataFrame, turns_per_record: int = SPAN) -> DataFrame:
    """Renders the maximal conversations: conv_id, part int, n_turns long, text string.

    A turn renders as `<|im_start|>role`, its text and `<|im_end|>`, each ended by a line feed (null role: `unknown`; null
    text: empty). A record holds up to turns_per_record turns; longer conversations go on in part 1, 2, ...
    so that none is collected whole, and records are what is joined and grouped. Empty tables give no rows; repeated turns
    are turns; other columns are ignored.
    """
    kept, prefixes = maximal_conversations(turns)
    parts = F.sequence(F.lit(0), F.floor((F.col("n_turns") - 1) / turns_per_record).cast("int"))
    kept = kept.select(F.col("conv_id").alias("k"), F.explode(parts).alias("kept_part"))
    piece = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    part = F.floor((F.col("idx") - 1) / turns_per_record).cast("int")
    pieces = prefixes.select("conv_id", "n_turns", part.alias("part"), F.struct("idx", piece.alias("piece")).alias("p"))
    pieces = pieces.join(kept, F.col("conv_id").eqNullSafe(F.col("k")) & (F.col("part") == F.col("kept_part")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["piece"]), "")
    return pieces.groupBy("conv_id", "part", "n_turns").agg(joined.alias("text")).select("conv_id", "part", "n_turns", "text")
