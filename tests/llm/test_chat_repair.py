import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from corpuswell.llm import chat_repair as cr

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def plain_damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if d:
            out += [(c, t, "user" if d == 4 else role, "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text)] * (2 if d == 3 else 1)
    return out


def plain_repair(rows):
    """What a conversation (turn, role, text) gives: edits are searched from the end, over all states and places."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in rows:
        own = text.strip(SPACE)
        faults.append("b" if not own else "d" if (role, text) in seen else "t" if own[-1] not in ".!?" else "")
        seen.add((role, text))
    goes = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    @lru_cache(None)
    def best(k, state, inserts):
        """Least (cost, audit, turns) from turn k on; no more than two inserts one after the other."""
        ways = [(0, "", ())] if k == len(rows) and state in ("", "a") else []
        add = lambda cost, letter, turn, rest: ways.append((cost + rest[0], letter + rest[1], (*turn, *rest[2]))) if rest else None
        for to, name in (("u", "user"), ("a", "assistant")):
            if inserts < 2 and (state, to) in goes:
                add(3, "I", (f"{name}:",), best(k, to, inserts + 1))
            if k < len(rows) and faults[k] not in ("b", "d") and (state, to) in goes:
                add(3 + 3 * (faults[k] == "t"), "R", (f"{name}:{rows[k][2]}",), best(k + 1, to, 0))
        if k < len(rows):
            add(4, "D", (), best(k + 1, state, 0))
            if faults[k] not in ("b", "d") and (state, rows[k][1][:1]) in goes:
                add(3 * (faults[k] == "t"), "K", (f"{rows[k][1]}:{rows[k][2]}",), best(k + 1, goes[state, rows[k][1][:1]], 0))
        return min(ways, default=None)

    for k, state, inserts in itertools.product(range(len(rows), -1, -1), ["", "s", "u", "a"], (2, 1, 0)):
        best(k, state, inserts)  # so that the recursion is never deep
    cost, audit, turns = best(0, "", 0)
    given = [t for t, _, _ in rows if t is not None]
    gaps = max(given) - min(given) + 1 - len(set(given)) if given else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest())


def plain(rows):
    talks = {c: [] for c, *_ in rows}
    for c, *row in plain_damage(rows):
        talks[c].append(tuple(row))
    return {c: plain_repair(t) for c, t in talks.items()}


def found(spark, rows):
    turns = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = cr.repair_conversations(cr.damaged(turns), turns).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


def some_turns(talks=120, longest=9, seed=4):
    rng = random.Random(seed)
    rows = []
    for c in range(talks):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None])
            text = rng.choice(["Hello there.", "yes", "Why?", " \n", "", None, "go on! ", "It is so. \t", "é中."])
            rows.append((c, rng.choice([t, t, t, t + 3, None]), role, text))
    return rows


@pytest.mark.parametrize("span", [1, 2, 5, 2048])
def test_repairs_as_plain_search(spark, monkeypatch, span):
    monkeypatch.setattr(cr, "SPAN", span)
    rows = some_turns() + [(None, 0, "user", "a null id."), (None, None, "assistant", "and again."), (500, 2, None, None), *[(501, 7, "user", "same turn and text.")] * 6]
    assert found(spark, rows) == plain(rows)


def test_all_short_conversations_have_the_cheapest_edits():
    kinds = [(i, f) for i in "suat" for f in ("", "t")] + [("u", "b")]
    for n in (0, 1, 2, 3):
        for turns in itertools.product(kinds, repeat=n):
            roles = [{"s": "system", "u": "user", "a": "assistant", "t": "tool"}[i] for i, _ in turns]
            texts = [{"": f"{k}.", "t": f"{k}", "b": " "}[f] for k, (_, f) in enumerate(turns)]
            assert cr.faults(roles, texts, set()) == list(turns)
            cost, audit = cr.chosen(cr.advance(cr.close([(0, ""), None, None, None]), list(turns)))
            lines = cr.repaired(roles, texts, audit, 0, cr._kept(audit) % 2 == 1)
            want = plain_repair([(k, r, x) for k, (r, x) in enumerate(zip(roles, texts))])
            assert (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()) == want[5:]
            assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))


def test_a_hot_conversation_is_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(cr, "SPAN", 50)
    rng = random.Random(2)
    hot = [(7, None if k % 2 else 3, rng.choice(["user", "assistant"]), f"text {k % 900}{rng.choice(['.', '', '?'])}") for k in range(1200)]
    rows = [*hot, *[(c + 100, *r) for c, *r in some_turns(30)]]
    turns = spark.createDataFrame(rows, SCHEMA).repartition(4)
    order = ["conv_id", "turn", "role", "text"]
    parts = cr.damaged(turns).repartitionByRange(4, *order).where("conv_id = 7").select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 2
    assert found(spark, rows) == plain(rows)


def test_empty_tables_and_conversations_that_lose_all_turns(spark):
    assert found(spark, []) == {}
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found(spark, [(gone, 0, "user", "Hello.")]) == {gone: none}


def test_query_on_the_small_table(spark):
    from corpuswell.llm import queries

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op13_conversation_repair(spark, "/root/testdata/sf0.001")
    assert {r.conv_id: tuple(r[c] for c in [*cr.COUNTS, "audit", "repaired_sha256"]) for r in got.collect()} == plain(rows)
