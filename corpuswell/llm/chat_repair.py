"""Repair of conversations: the cheapest edits that make their roles follow a grammar, by a forward Viterbi pass over its states."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswell.llm._shared import partitions, staged

#: Turns, and characters of text, of a piece of a conversation at most; longer conversations are repaired in several pieces.
SPAN, SPAN_CHARS = 2048, 4 << 20
#: Costs of the edits, and of each truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
_SPACE = " \t\n\x0b\x0c\r"
#: States of the grammar (s?(ua)+)?: nothing yet, after a system turn, after a user's, after an assistant's. From where a turn of an initial leads where.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {"s": ((NOTHING,), SYSTEM), "u": ((NOTHING, SYSTEM, ASSISTANT), USER), "a": ((USER,), ASSISTANT)}
LEGAL = {"su", "ua", "au"}

#: A way to a state: its cost and the initials of its edits. Of equal costs the least initials win.
Way = tuple[int, str] | None


def _least(ways: list[Way]) -> Way:
    return min((w for w in ways if w is not None), default=None)


def _then(way: Way, cost: int, edit: str) -> Way:
    return None if way is None else (way[0] + cost, way[1] + edit)


def close(ways: list[Way]) -> list[Way]:
    """The ways with what may be inserted here: two turns at most, as from any state those reach every state that inserting can."""
    ways = list(ways)
    for _ in range(2):
        for sources, to in (STEPS["u"], STEPS["a"]):
            ways[to] = _least([ways[to], *[_then(ways[p], INSERT, "I") for p in sources]])
    return ways


def advance(ways: list[Way], turns: list[tuple[str, str]]) -> list[Way]:
    """The ways after more turns, each its role's initial and its fault (b blank, d duplicate, t truncated or empty)."""
    for initial, fault in turns:
        after = [_then(w, DELETE, "D") for w in ways]
        if fault not in ("b", "d"):
            more = TRUNCATED if fault == "t" else 0
            for name, cost, edit in ((initial, more, "K"), ("u", REROLE + more, "R"), ("a", REROLE + more, "R")):
                if name in STEPS:
                    sources, to = STEPS[name]
                    after[to] = _least([after[to], *[_then(ways[p], cost, edit) for p in sources]])
        ways = close(after)
    return ways


def transfer(turns: list[tuple[str, str]]) -> list[list[Way]]:
    """From each state before the turns the ways to each state after them."""
    return [advance([(0, "") if p == q else None for q in range(4)], turns) for p in range(4)]


def chosen(ways: list[Way]) -> tuple[int, str]:
    """The end of a conversation: nothing, or an assistant's turn."""
    return _least([ways[NOTHING], ways[ASSISTANT]])


def faults(roles: list[str], texts: list[str], seen: set[int]) -> list[tuple[str, str]]:
    """The turns' role initials and first faults. seen: places of turns that an earlier piece of the conversation holds."""
    out, before = [], set()
    for k, (role, text) in enumerate(zip(roles, texts)):
        own = text.strip(_SPACE)
        key = (role, text)
        fault = "b" if not own else "d" if key in before or k in seen else "t" if own[-1] not in ".!?" else ""
        before.add(key)
        out.append((role[:1], fault))
    return out


def repaired(roles: list[str], texts: list[str], audit: str, before: int, system: bool) -> list[str]:
    """`role:text` of what is left of turns under their edits. `before` turns of the repaired conversation come earlier; system: it begins with a system turn."""
    out, at = [], 0
    for edit in audit:
        if edit == "I":
            role, text = None, ""
        else:
            role, text = roles[at], texts[at]
            at += 1
        if edit == "D":
            continue
        if edit != "K":
            role = "user" if (before + len(out) - system) % 2 == 0 else "assistant"
        out.append(f"{role}:{text}")
    return out


def _kept(audit: str) -> int:
    return len(audit) - audit.count("D")


def _pieces(span: int, chars: int):
    """Sorted turns (conv_id, turn, role, text) of a partition as pieces of conversations, numbered in order over all partitions."""

    def piece(owner, number, held):
        return pa.record_batch([pa.array([x], t) for x, t in zip((owner, number, *held), _PIECE)], ["conv_id", "piece", "turns", "roles", "texts"])

    def run(batches):
        number, owner, size = TaskContext.get().partitionId() << 32, None, 0
        held: tuple[list, list, list] = ([], [], [])
        for batch in batches:
            for conv, turn, role, text in zip(*(batch.column(j).to_pylist() for j in range(4))):
                if held[0] and (conv != owner or len(held[0]) >= span or size >= chars):
                    yield piece(owner, number, held)
                    number, held, size = number + 1, ([], [], []), 0
                owner = conv
                for column, x in zip(held, (turn, role, text)):
                    column.append(x)
                size += len(text)
        if held[0]:
            yield piece(owner, number, held)

    return run


PIECES = "conv_id long, piece long, turns array<long>, roles array<string>, texts array<string>"
_PIECE = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string())]
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _figures(turns: list[int | None], found: list[tuple[str, str]]) -> tuple[int | None, int | None, int, int, int, int, int]:
    """Least and largest turn, distinct turns, blank, duplicate and truncated turns, illegal neighbours."""
    given = [t for t in turns if t is not None]
    counted = [sum(f == x for _, f in found) for x in "bdt"]
    illegal = sum(a + b not in LEGAL for (a, _), (b, _) in zip(found, found[1:]))
    return min(given, default=None), max(given, default=None), len(set(given)), *counted, illegal


def _repair(batches):
    """Conversations of one piece."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            found = faults(row["roles"], row["texts"], set())
            low, high, distinct, *counted = _figures(row["turns"], found)
            cost, audit = chosen(advance(close([(0, ""), None, None, None]), found))
            lines = repaired(row["roles"], row["texts"], audit, 0, _kept(audit) % 2 == 1)
            gaps = 0 if low is None else high - low + 1 - distinct
            out.append((row["conv_id"], gaps, *counted, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
        if out:
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), [*[pa.int64()] * 7, pa.string(), pa.string()])], names=["conv_id", *COUNTS, "audit", "repaired_sha256"])


REPAIRED = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
#: What is known of a piece: its figures, initials and turns at its ends, and the ways through it from each state to each.
STEP = "conv_id long, piece long, figures array<long>, ends array<string>, edges array<long>, costs array<long>, audits array<string>"


def _step(batches):
    for batch in batches:
        for row in batch.to_pylist():
            found = faults(row["roles"], row["texts"], set(row["seen"] or ()))
            ways = [w for own in transfer(found) for w in own]
            figures, turns = _figures(row["turns"], found), row["turns"]
            values = [row["conv_id"], row["piece"], figures, [found[0][0], found[-1][0]], [turns[0], turns[-1]], [None if w is None else w[0] for w in ways], [None if w is None else w[1] for w in ways]]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())]
            yield pa.record_batch([pa.array([v], t) for v, t in zip(values, kinds)], [c.split()[0] for c in STEP.split(", ")])


#: Edits of a piece with what comes before it; and, where piece is null, the figures and all edits of a conversation.
FOLDED = "conv_id long, piece long, edits string, before long, system boolean, " + ", ".join(f"{c} long" for c in COUNTS)


class _Fold:
    """A conversation whose pieces come one after the other: the best way to each state, cut where pieces end."""

    def __init__(self, conv_id):
        self.conv_id, self.pieces = conv_id, []
        self.ways: list[tuple[int, tuple[str, ...]] | None] = [(w[0], (w[1],)) if w else None for w in close([(0, ""), None, None, None])]
        self.low = self.high = None
        self.sums, self.last = [0] * 5, (None, None)
        self.settled: list[str] = []

    def add(self, row: dict) -> None:
        low, high, *sums = row["figures"]
        self.low = low if self.low is None else min(self.low, low if low is not None else self.low)
        self.high = high if self.high is None else max(self.high, high if high is not None else self.high)
        self.sums = [a + b for a, b in zip(self.sums, sums)]
        if self.pieces:
            self.sums[0] -= row["edges"][0] is not None and row["edges"][0] == self.last[1]
            self.sums[4] += self.last[0] + row["ends"][0] not in LEGAL
        self.last, after = (row["ends"][1], row["edges"][1]), []
        for q in range(4):
            ways = [(own[0] + row["costs"][4 * p + q], (*own[1], row["audits"][4 * p + q])) for p, own in enumerate(self.ways) if own is not None and row["costs"][4 * p + q] is not None]
            after.append(min(ways, key=lambda w: (w[0], "".join(w[1])), default=None))
        self.ways = after
        self.pieces.append(row["piece"])
        # What all ways have in common is settled.
        while len({w[1][0] for w in self.ways if w}) == 1 and all(len(w[1]) > 1 for w in self.ways if w):
            self.settled.append(next(w[1][0] for w in self.ways if w))
            self.ways = [(w[0], w[1][1:]) if w else None for w in self.ways]

    def rows(self):
        cost, tail = min((w for w in (self.ways[NOTHING], self.ways[ASSISTANT]) if w), key=lambda w: (w[0], "".join(w[1])))
        edits = [*self.settled, *tail]
        edits = [edits[0] + edits[1], *edits[2:]]  # what was inserted before the first piece
        audit = "".join(edits)
        system, before = _kept(audit) % 2 == 1, 0
        for piece, own in zip(self.pieces, edits):
            yield (self.conv_id, piece, own, before, system, *[None] * 6)
            before += _kept(own)
        distinct, *counted = self.sums
        gaps = 0 if self.low is None else self.high - self.low + 1 - distinct
        yield (self.conv_id, None, audit, None, system, gaps, *counted, cost)


def _fold(batches):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), *[pa.int64()] * 6]
    names = ["conv_id", "piece", "edits", "before", "system", *COUNTS]
    made = lambda fold: pa.record_batch([pa.array(x, t) for x, t in zip(zip(*fold.rows()), kinds)], names=names)
    fold = None
    for batch in batches:
        for row in batch.to_pylist():
            if fold is None or fold.conv_id != row["conv_id"]:
                if fold:
                    yield made(fold)
                fold = _Fold(row["conv_id"])
            fold.add(row)
    if fold:
        yield made(fold)


def _hash(batches):
    """SHA-256 of each conversation's repaired turns, from its pieces in order; no more than a piece is held."""
    owner, running, first = None, None, True
    done = lambda: pa.record_batch([pa.array([owner], pa.int64()), pa.array([running.hexdigest()])], names=["conv_id", "repaired_sha256"])
    for batch in batches:
        for row in batch.to_pylist():
            if running is None or row["conv_id"] != owner:
                if running:
                    yield done()
                owner, running, first = row["conv_id"], hashlib.sha256(), True
            lines = repaired(row["roles"], row["texts"], row["edits"], row["before"], row["system"])
            if lines:
                running.update(("" if first else "\n").encode() + "\n".join(lines).encode())
                first = False
    if running:
        yield done()


def damaged(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) with the damage that the CRC-32 of `conv_id:turn` modulo 20 tells: 0 drops a turn, 1 empties its text, 2 removes
    its sentence ends, 3 repeats it, 4 makes it the user's. Nulls count as one space, but turn and conv_id stay null."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    damage = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), plain("role").alias("role"), plain("text").alias("text"), damage.alias("d")).where("d <> 0")
    text = F.when(F.col("d") == 1, F.lit("")).when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("d") == 4, F.lit("user")).otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("d") == 3, 2).otherwise(1))).alias("_copy")).drop("_copy")


def _joined(rows: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys of which conv_id may be null; the columns of rows and, of other, those that are no keys."""
    renamed = other.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.join(renamed, on, how).drop(*[f"_{k}" for k in keys])


def repair_conversations(turns: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost (long), audit and repaired_sha256 of each conversation of `every` (conv_id; by default of turns).

    turns: conv_id, turn, role, text, without null roles or texts. A turn's first fault counts: blank (nothing but ASCII white space), duplicate (role and text
    stood earlier in the conversation), truncated (its last other character is none of `.!?`). Turns may be kept (0), made the user's or the assistant's (3),
    deleted (4; blank ones and duplicates must be), and empty turns of either inserted anywhere (3); truncated turns that stay cost 3 more. audit has the
    initials of the cheapest edits in order after which the role initials match (s?(ua)+)?; of equal costs the least by ASCII.

    Turns are sorted by range, so a conversation with a third of all turns, or of one turn number only, is dealt to many tasks; each
    holds pieces of SPAN turns at most. A conversation of one piece is repaired there. Of others a piece gives the best ways from each state to each, which a
    fold joins, one piece after the other; two ways of one cost through the same turns never begin with each other, so the least of joined ways is
    joined from the least. Duplicates of earlier pieces come from a distinct join. The hash of a long conversation runs over its pieces in order.

    Order is turn (nulls first), then role and text. gaps counts missing numbers between the least and the largest turn, without nulls. Null conv_ids are one
    conversation; repeated rows are duplicates; roles other than those that begin with s, u or a cannot be kept. A conversation without
    turns has zeros, an empty audit and the hash of the empty string. An empty table gives no rows; other columns are not read.
    """
    spark = turns.sparkSession
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("salt", F.spark_partition_id())
    order = ["conv_id", "turn", "role", "text", "salt"]
    pieces = staged(rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order[:4]).drop("salt").mapInArrow(_pieces(SPAN, SPAN_CHARS), PIECES), "pieces")
    several = staged(pieces.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select("conv_id"), "several")
    done = _joined(pieces, several, ["conv_id"], "left_anti").mapInArrow(_repair, REPAIRED)
    long, piece = _joined(pieces, several, ["conv_id"], "left_semi"), ["conv_id", "piece"]
    turn = F.posexplode(F.arrays_zip("roles", "texts"))
    key = [F.xxhash64(F.lit(s), "t.roles", "t.texts").alias(f"h{s}") for s in (1, 2)]
    held = staged(long.select(*piece, turn.alias("k", "t")).select(*piece, "k", *key).groupBy(*piece, "h1", "h2").agg(F.min("k").alias("k")), "held")
    first = held.groupBy("conv_id", "h1", "h2").agg(F.min("piece").alias("first"))
    later = _joined(held, first, ["conv_id", "h1", "h2"]).where("piece > first")
    seen = later.groupBy(*piece).agg(F.collect_list("k").alias("seen"))  # SPAN turns at most
    known = _joined(long, seen, piece, "left").select(*piece, "turns", "roles", "texts", "seen")
    in_order = lambda df: df.repartition(partitions(spark), "conv_id").sortWithinPartitions(*piece)
    folded = staged(in_order(known.mapInArrow(_step, STEP)).mapInArrow(_fold, FOLDED), "edits")
    edits = folded.where("piece IS NOT NULL").select(*piece, "edits", "before", "system")
    edited = _joined(long, edits, piece).select(*piece, "roles", "texts", "edits", "before", "system")
    hashes = in_order(edited).mapInArrow(_hash, "conv_id long, repaired_sha256 string")
    whole = folded.where("piece IS NULL").select("conv_id", *COUNTS, F.col("edits").alias("audit"))
    done = done.unionByName(_joined(whole, hashes, ["conv_id"]))
    every = (turns if every is None else every).select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    filled = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS]
    return _joined(every, done, ["conv_id"], "left").select("conv_id", *filled, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
