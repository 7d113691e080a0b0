import random
import re

import numpy as np
from pyspark.sql import functions as F

from corpuswell.llm import license_scan as ls
from corpuswell.llm import mixing, topk
from tests.llm.conftest import key

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_licenses_as_brute_force(spark, odd, none):
    rng = random.Random(1)
    filler = ["the", "of", "license", "mit", "under", "apache", "version", "2", "cc", "by", "nc", "0", "public", "é中", "gnu"]
    texts = [" ".join(rng.choice(filler) for _ in range(rng.randint(0, 90))) for _ in range(120)]
    mit, rest = ls.MIT.split(), ls.APACHE.split() + ls.BSD.split()
    edited = [w for k, w in enumerate(mit) if k % 17] + ["and", "more", "words"]
    texts += [" ".join(filler + edited + rest + filler), "The album was released under the label and its license expired", " ".join(mit[: len(mit) // 2])]
    texts += ["Released under the MIT License.", "x" * 50 + " Licensed under CC BY-NC 4.0\nLicensed under the Apache License, Version 2.0", "CC-BY", "MIT"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for table in (docs, odd):
        rows = {(r.doc_id, r.text): r.text for r in table.collect()}
        got = ls.scan_licenses(table)
        assert got.count() == table.count()
        order = ls.token_order(table.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ls.TEMPLATES)
        assert len(order) == len({w for t in ls.TEMPLATES for w in plain_words(t.text)})
        want = []
        for i, text in table.select("doc_id", "text").collect():
            w = plain_words(text)
            places = sorted((k, label) for p, label in ls.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
            found = []
            for t in ls.TEMPLATES:
                own, (size, step) = set(plain_words(t.text)), t.block()
                for b in range(0, max(len(w), 1), step):
                    held = own & set(w[b : b + size])
                    if len(held) >= 0.8 * len(own) - 1e-9 and set(t.distinctive) <= held:
                        found.append((t.label, b, len(held) / len(own)))
            found.sort()
            want.append((i, len(w), places, found))
        have = [(r.doc_id, r.n_words, sorted((p.word, p.label) for p in r.places), sorted((m.label, m.word, m.containment) for m in r.matches)) for r in got.collect()]
        assert sorted(have, key=lambda r: key(r[:1]) + r[1:]) == sorted(want, key=lambda r: key(r[:1]) + r[1:]) and rows
        if table is docs:
            labels = {i: {x[0] for x in found} for i, _, _, found in want}
            assert {"mit", "apache-2", "bsd-3"} <= labels[120] and not labels[121] and not labels[122]
    assert ls.scan_licenses(none).collect() == []


def brute_top_k(vectors, every=50, k=5):
    """Of each query row the best other rows; vectors that hold what is not finite take no part."""
    ints = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for own, (q, a) in enumerate(ints):
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), c) for place, (c, b) in enumerate(ints) if place != own)
            want += [(q, r, c, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for r, (s, c) in enumerate(scores[:k], 1)]
    return sorted(want)


def found_top_k(table, **options):
    return sorted(map(tuple, topk.top_k(table, F.col("vec_id") % 50 == 0, 5, **options).collect()))


SCHEMA = "vec_id long, embedding array<float>"


def test_top_k_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 50)
    rng = np.random.default_rng(4)
    vectors = [(k, [float(x) for x in rng.choice([-0.5, -0.1, 0.0, 0.3, 0.7], 12)]) for k in range(230)]
    vectors += [(300, None), (350, [float("nan")] * 12), (400, [None] * 12), (450, [1.0] * 5), (451, []), (500, [float("inf")] * 12), (None, [1.0] * 12)]
    table = spark.createDataFrame(vectors, SCHEMA).repartition(3)
    assert found_top_k(table, groups=3) == brute_top_k(vectors)
    few = spark.createDataFrame(vectors[:3], SCHEMA)
    assert topk.top_k(few, F.col("vec_id") % 50 == 0).count() == 2
    assert topk.top_k(few.where("false"), F.col("vec_id") % 50 == 0).collect() == []
    assert topk.top_k(few, F.lit(None).cast("boolean")).collect() == []


def test_top_k_of_repeated_rows(spark):
    rng = np.random.default_rng(4)
    vectors = [(k, rng.normal(size=6).astype(np.float32).tolist()) for k in range(120)]
    vectors += [vectors[50]] * 8 + [vectors[7]] + [(100, vectors[3][1]), (0, vectors[0][1])]
    assert found_top_k(spark.createDataFrame(vectors, SCHEMA).repartition(3), groups=3) == brute_top_k(vectors)


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(6)
    vectors = [(k, (rng.normal(size=4) * 10.0 ** rng.integers(0, 5)).astype(np.float32).tolist()) for k in range(110)]
    vectors += [(110, [1e8, 3.0, -1e8, 0.5]), (150, [1e8, -7.0, -1e8, 2.0]), (151, [2.0**23, 1.0, 0.0, 0.0])]
    assert found_top_k(spark.createDataFrame(vectors, SCHEMA)) == brute_top_k(vectors)
    assert found_top_k(spark.createDataFrame([*vectors, (200, [3e38] * 4)], SCHEMA)) == brute_top_k([*vectors, (200, [3e38] * 4)])


def test_blocks_of_wide_vectors_are_cut_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_BYTES", 1 << 12)
    rng = np.random.default_rng(2)
    vectors = [(k, rng.normal(size=100 if k % 7 else 3).astype(np.float32).tolist()) for k in range(120)]
    table = spark.createDataFrame(vectors, SCHEMA).repartition(2)
    rows = table.selectExpr("vec_id AS id", "0L AS copy", "1L AS rows", "cast(embedding AS array<double>) AS v").mapInArrow(topk._blocks(2048, 256), topk.BLOCKS).collect()
    assert sum(len(r["ids"]) // 8 for r in rows) == 120 and all(len(r["vectors"]) <= 1 << 12 for r in rows)
    assert found_top_k(table) == brute_top_k(vectors)


def test_top_k_stops_before_the_end_of_the_lists():
    rng = np.random.default_rng(8)
    vectors = np.floor(256 * rng.pareto(1.5, (4000, 16)))
    ids = np.arange(4000)
    lists = topk.SortedLists(ids, np.zeros(4000, int), vectors)
    queries = np.zeros((6, 16))
    queries[np.arange(6), rng.integers(0, 16, 6)] = 256
    found, read = topk.no_random_access(lists, queries, np.full(6, -1), np.ones(6, int), 5, np.full(6, -np.inf))
    assert read < 0.5 * vectors.size
    for (places, scores), q in zip(found, queries):
        every = vectors @ q
        best = np.lexsort((ids, -every))[:5]
        assert places.tolist() == best.tolist() and scores == every[best].astype(int).tolist()
    # What other blocks gave lets a block without a good vector go sooner.
    sooner = topk.no_random_access(lists, queries, np.full(6, -1), np.ones(6, int), 5, np.full(6, 1e9))
    assert sooner[1] <= read and all(not scores for _, scores in sooner[0])


def labelled_docs(spark, n=400):
    rng = random.Random(7)
    word = lambda: rng.choice("alpha beta gamma delta house tree river stone".split())
    rows = []
    for k in range(n):
        words = [word() for _ in range(rng.randint(20, 60))]
        domain = 0 if k % 4 else 1 + k % 8 // 4
        if domain:
            words.insert(5, "spam" if domain == 1 else "scum")
        rows.append((k, " ".join(words), domain))
    return spark.createDataFrame(rows, "doc_id long, text string, domain int")


def test_mixing_meets_targets_and_tells_domains(spark):
    docs = labelled_docs(spark)
    rows = mixing.mix(docs, docs.where("doc_id < 200"), [0.9, 0.06, 0.04]).join(docs.select("doc_id", "domain"), "doc_id").collect()
    held = [r for r in rows if r.doc_id >= 200]
    assert sum(int(np.argmax(r.posteriors)) == r.domain for r in held) >= 0.95 * len(held)
    n = sum(r.n_tokens for r in rows)
    for k, target in enumerate([0.9, 0.06, 0.04]):
        assert abs(sum(r.n_tokens * r.posteriors[k] * r.rate for r in rows) / n - target) < 0.01
    assert all(r.rate >= 0 and abs(r.copies - r.rate) < 1 for r in rows)
    kept = mixing.mix(docs, docs, [1.0, 0.0, 0.0], keep=0, most=1.0).join(docs.select("doc_id", "domain"), "doc_id").collect()
    assert all((r.rate > 0.5) == (r.domain == 0) for r in kept)


def plain_rates(n, p, aim, most, weights, pull):
    """Minimises the same sum one document after the other, in closed form, until nothing moves."""
    total, rates = n.sum(), np.ones(len(n))
    errors = (n * rates @ p - aim) / total
    for _ in range(20_000):
        moved = 0.0
        for i in np.flatnonzero(n):
            slope = (p[i] * weights) @ errors + pull * (rates[i] - 1)
            curve = n[i] / total * (p[i] ** 2 @ weights) + pull
            new = min(max(rates[i] - slope / curve, 0), most)
            errors += n[i] / total * p[i] * (new - rates[i])
            moved, rates[i] = max(moved, abs(new - rates[i])), new
        if moved < 1e-9:
            return rates
    raise AssertionError("not settled")


def test_rates_as_plain_least_squares(spark):
    rng = np.random.default_rng(3)
    n = rng.integers(0, 400, 60)
    p = rng.dirichlet([0.4, 0.2, 0.1], 60)
    scored = spark.createDataFrame([(k, int(a), b.tolist()) for k, (a, b) in enumerate(zip(n, p))], "doc_id long, n_tokens long, posteriors array<double>").repartition(3)
    have = n @ p
    for targets, keep, most, weights in (([0.5, 0.3, 0.2], None, float("inf"), None), ([0.9, 0.1, 0.0], 0, 1.0, [5.0, 1.0, 1.0]), ([0.2, 0.2, 0.6], None, 2.0, None)):
        aim = np.array(targets) * (n.sum() if keep is None else have[keep] / targets[keep])
        aim = np.minimum(aim, most * have) if most < 1e9 else aim
        want = plain_rates(n, p, aim, most, np.ones(3) if weights is None else np.array(weights), 1e-2)
        rows = mixing.mixing_rates(scored, targets, keep, most, weights, pull=1e-2, close=1e-7, steps=1000, stage=40).collect()
        assert all(r.converged for r in rows)
        assert max(abs(r.rate - want[r.doc_id]) for r in rows if n[r.doc_id]) < 1e-3
        gap = np.abs(n * want @ p - aim).max() / n.sum()
        assert all(abs(r.target_gap - gap) < 1e-3 for r in rows)
    assert not any(r.converged for r in mixing.mixing_rates(scored, [0.5, 0.3, 0.2], steps=2).collect())


def test_sample_is_bounded_where_ids_repeat(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(mixing, "train", lambda sample, domains: seen.append(sample.count()) or (_ for _ in ()).throw(StopIteration))
    docs = spark.createDataFrame([(k % 3, f"text {k}") for k in range(50)], "doc_id long, text string")
    labelled = spark.createDataFrame([(k % 3, 0) for k in range(9)], "doc_id long, domain int")
    try:
        mixing.domain_posteriors(docs, labelled, 2, sample_rows=2)
    except StopIteration:
        pass
    assert seen == [2]


def test_mixing_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(3, 0), (6, 1), (None, 1), (8, None)], "doc_id long, domain int")
    rows = mixing.mix(odd, labels, [0.5, 0.5]).collect()
    assert len(rows) == odd.count() and all(abs(sum(r.posteriors) - 1) < 1e-9 and r.rate >= 0 for r in rows)
    assert mixing.mix(none, labels, [0.5, 0.5]).collect() == []
    assert mixing.mix(odd, labels.where("false"), [0.5, 0.5]).count() == odd.count()
