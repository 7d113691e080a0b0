import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from corpuswell.llm import near_dedup as nd
from corpuswell.llm._shared import dealt_join


def sets_of(rows, size):
    out = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        out.append(frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    return out


def brute(rows, size, num, den):
    """component of each row by all pairs; rows of equal id are one document."""
    sets, root = sets_of(rows, size), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        same = rows[a][0] is not None and rows[a][0] == rows[b][0]
        if same or sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k][0])
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return [(rows[k][0], len(sets[k]), least[find(k)]) for k in range(len(rows))]


def family(seed, n, words, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_links_match_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(nd, "DIRECT", 1)  # so that leaders and regrouping take part
    texts = family(1, 60, 80, 7) + family(2, 40, 30, 3) + family(3, 30, 9, 1) + [" ".join(family(1, 1, 80, 0)[0].split()[:k]) for k in range(60, 80, 2)]
    rows = list(enumerate(texts))
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, (85, 100)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, 3, 85, 100))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_in_task_join_and_further_leaders_agree(spark, monkeypatch):
    rows = list(enumerate(family(5, 80, 60, 8)))
    want = sorted(brute(rows, 3, 85, 100))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(nd, "DIRECT", 0)
    monkeypatch.setattr(nd, "IN_TASK", 0)
    small = spark.createDataFrame(rows[:25], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in nd.near_duplicates(small, 3, (85, 100)).collect()) == sorted(brute(rows[:25], 3, 85, 100))
    monkeypatch.setattr(nd, "IN_TASK", 1 << 21)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in nd.near_duplicates(docs, 3, (85, 100)).collect()) == want


def test_components_by_rounds_and_at_once(spark, monkeypatch):
    rng = random.Random(9)
    links = [(k, k + 1) for k in range(200, 300)] + [(rng.randrange(150), rng.randrange(150)) for _ in range(90)] + [(400, k) for k in range(401, 440)] + [(7, 7)]
    frame, nodes = spark.createDataFrame(links, "a long, b long"), spark.range(450).select(F.col("id").alias("node"))
    root = list(range(450))
    for _ in range(450):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    for most in (0, 1 << 20):
        monkeypatch.setattr(nd, "SETTLED_AT_ONCE", most)
        assert [r.label for r in nd.components(nodes, frame).orderBy("node").collect()] == root
        assert all(r.node == r.label for r in nd.components(nodes, frame.where("false")).collect())


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = nd.near_duplicates(odd, 5, (80, 100)).collect()
    none_last = lambda t: tuple((v is None, v) for v in t)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=none_last) == sorted(brute(rows, 5, 80, 100), key=none_last)
    assert nd.near_duplicates(none).collect() == []


def test_estimates_and_registers():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.7, 0.9):
        a = rng.integers(0, 2**64, 3000, dtype=np.uint64)
        b = np.concatenate([a[: int(3000 * 2 * share / (1 + share))], rng.integers(0, 2**64, 3000 - int(3000 * 2 * share / (1 + share)), dtype=np.uint64)])
        regs = nd.registers([np.unique(a), np.unique(b)])
        assert abs(nd.estimate(regs[:1], regs[1:], np.array([3000.0]), np.array([3000.0]))[0] - share) < 0.2
    assert len(set(nd.band_keys(nd.registers([np.array([5], np.uint64)]))[0].tolist())) == nd.BANDS


def test_hot_keys_are_dealt_and_join_alike(spark):
    rows = spark.range(4000).selectExpr("id AS node", "if(id < 3000, 0, id % 700) AS key")
    counts = rows.groupBy("key").count().withColumnRenamed("count", "c")
    small = rows.select("key").distinct().where("key % 2 = 0").selectExpr("key", "key * 3 AS told")
    small = small.unionAll(small.selectExpr("key", "told + 1"))
    for how in ("inner", "left"):
        dealt = dealt_join(rows, small, ["key"], counts, 4000, how)
        assert sorted(map(str, dealt.collect())) == sorted(map(str, rows.join(small, "key", how).collect()))
    assert dealt_join(rows.limit(0), small, ["key"], counts.limit(0), 0).collect() == []


def test_ids_of_the_whole_range_of_longs(spark):
    texts = family(8, 6, 60, 2)
    ids = [1, (1 << 62) + 5, (1 << 62) + 9, -(1 << 63), (1 << 63) - 1, (1 << 62) + 5]
    none_last = lambda t: tuple((v is None, v) for v in t)
    for extra in ([], [(None, texts[3]), (None, "alone and without an id at all"), (None, texts[4])]):
        rows = [*zip(ids, [texts[0], "another text with words", texts[1], "a third one stands here", texts[2], "another text with words"]), *extra]
        got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, (70, 100)).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=none_last) == sorted(brute(rows, 3, 70, 100), key=none_last)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
