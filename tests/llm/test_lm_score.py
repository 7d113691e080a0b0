import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuswell.llm import lm_score, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
START, END = "<start>", "<end>"
K = lm_score.DISCOUNTED


def tokens(text):
    return [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), END]


class PlainKatz:
    """The same model from dictionaries, one n-gram after the other."""

    def __init__(self, texts, order):
        self.order = order
        self.counts = [Counter() for _ in range(order + 1)]
        for text in texts:
            t = [START, *tokens(text)]
            for n in range(1, order + 1):
                for end in range(1, len(t)):
                    if end - n + 1 >= 0:
                        self.counts[n][tuple(t[end - n + 1 : end + 1])] += 1
        self.n = sum(self.counts[1].values())
        self.starts = len(texts)
        self.d = [None, *[self.discounts(c) for c in self.counts[1:]]]
        self.followers = {}
        for n in range(2, order + 1):
            for g in self.counts[n]:
                self.followers.setdefault(g[:-1], []).append(g[-1])

    @staticmethod
    def discounts(counts):
        n = Counter(counts.values())
        top = (K + 1) * n[K + 1] / n[1] if n[1] else 1
        d = {}
        for r in range(1, K + 1):
            turing = ((r + 1) * n[r + 1] / (r * n[r]) - top) / (1 - top) if n[r] and top != 1 else 0
            d[r] = turing if 0 < turing < 1 else 1 - 0.5 / r
        return d

    def kept(self, gram):
        c = self.counts[len(gram)][gram]
        return c * self.d[len(gram)].get(c, 1)

    def p(self, word, context):
        if not context:
            spare = sum(c - self.kept(g) for g, c in self.counts[1].items())
            whole = self.n + (spare <= 0)
            return (self.kept((word,)) if self.counts[1][(word,)] else spare or 1) / whole
        total = self.starts if context == (START,) else self.counts[len(context)][context]
        shorter = self.p(word, context[1:])
        if not total:
            return shorter
        seen = self.followers[context]
        spare = sum(self.counts[len(context) + 1][(*context, w)] - self.kept((*context, w)) for w in seen)
        whole = total + (spare <= 0)
        if self.counts[len(context) + 1][(*context, word)]:
            return self.kept((*context, word)) / whole
        covered = sum(self.p(w, context[1:]) for w in seen)
        return (spare or 1) / whole / (1 - covered) * shorter

    def score(self, text):
        t = [START, *tokens(text)]
        return sum(math.log10(self.p(t[k], tuple(t[max(0, k - self.order + 1) : k]))) for k in range(1, len(t)))


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def some_texts(n=150):
    rng = random.Random(5)
    common = ["The", "a", "of", "stone", "River", "tree", "é中"]
    return [" ".join(rng.choice(common) if rng.random() < 0.7 else f"w{int(rng.expovariate(0.05))}" for _ in range(rng.randint(0, 40))) for _ in range(n)]


def same_as_plain(table, order):
    rows = table.select("doc_id", "text").collect()
    plain = PlainKatz([r.text for r in rows if not held_out(r.doc_id)], order)
    v = len(plain.counts[1])
    want = []
    for r in rows:
        t = tokens(r.text)
        base = sum(math.log10((plain.counts[1][(w,)] + 1) / (plain.n + v + 1)) for w in t)
        want.append((r.doc_id, held_out(r.doc_id), len(t), sum(plain.counts[1][(w,)] > 0 for w in t), plain.n, base, plain.score(r.text)))
    got = [tuple(r) for r in lm_score.katz_scores(table, order=order)[0].collect()]
    order_of = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    for a, b in zip(sorted(got, key=order_of), sorted(want, key=order_of), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)
    return plain


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_as_plain_katz(spark, monkeypatch, order):
    monkeypatch.setattr(lm_score, "BLOCK", 800)
    docs = spark.createDataFrame(list(enumerate(some_texts())), "doc_id long, text string").repartition(3, "doc_id")
    plain = same_as_plain(docs, order)
    # After each context the probabilities of all tokens and of an unknown one sum to 1.
    words = [w for (w,) in plain.counts[1]] + ["never seen"]
    contexts = [(), *[c for c in plain.followers][:60], ("never seen",)][: 1 if order == 1 else None]
    for c in contexts:
        assert sum(plain.p(w, c) for w in words) == pytest.approx(1, abs=1e-9)


def test_scores_of_odd_rows(spark, odd, none):
    same_as_plain(odd, 2)
    assert lm_score.katz_scores(none)[0].collect() == []
    rows = lm_score.katz_scores(odd, F.lit(False))[0].collect()
    assert len(rows) == odd.count() and all(r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.score == 0 and r.base_score == 0 for r in rows)
    assert lm_score.katz_scores(odd, F.lit(None).cast("boolean"))[0].where("NOT held_out").count() == 0


def test_contexts_without_small_counts_leave_something(spark):
    docs = spark.createDataFrame([(0, "a b")] * 40 + [(2, "a c"), (2, "z")], "doc_id long, text string")
    same_as_plain(docs, 2)
    assert all(math.isfinite(r.score) for r in lm_score.katz_scores(docs)[0].collect())


def test_tables_hold_each_training_ngram_and_learn_more_from_more(spark):
    docs = spark.createDataFrame(list(enumerate(some_texts())), "doc_id long, text string")
    plain = PlainKatz([t for i, t in enumerate(some_texts()) if not held_out(i)], 2)
    model = lm_score.katz_scores(docs)[1].collect()
    sizes = Counter()
    for r in model:
        sizes[r.kind, r.level] += len(lm_score._unpack_keys(r["keys"]))
    assert sizes["counts", 1] == len(plain.counts[1]) + 1 and sizes["counts", 2] == len(plain.counts[2])
    held = lambda table: sum(r.score for r in lm_score.katz_scores(table)[0].where("doc_id < 150 AND held_out").collect())
    assert held(docs) > held(docs.where("doc_id % 5 = 0 OR crc32(cast(doc_id as string)) % 7 = 2"))


def test_query_projects_the_contract(spark):
    rows = queries.op11_lm_scoring(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"} <= set(rows.columns)
    got = rows.collect()
    assert len(got) == 200 and all(r.held_out == held_out(r.doc_id) for r in got)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)
