import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpuswell.llm import chat, quality, sharding
from tests.llm.conftest import key


def plain_measures(text):
    text = text or ""
    words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {p for k, w in enumerate(windows) if w in twice for p in range(k, k + 5)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_measures_and_base_rule(spark, odd, none):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["# a\n# a\n$ <b>" * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"lang": F.lit("x"), "source": F.lit("y")})
    for table in (docs, odd):
        rows = quality.judge_quality(table).collect()
        assert len(rows) == table.count()
        for r in rows:
            n, chars, symbols, dup, repeat = plain_measures(r.text)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
            assert r.base_failed == (n < 10 or 100 * repeat > 20 * n)
            assert isinstance(r.kept, bool) and (not r.kept or not r.base_failed)
    assert quality.judge_quality(none).collect() == []


def plain_fences(rows, spread=8, own_rows=50):
    """(lang, source) -> fences, from rows (lang, source, upper estimates)."""

    def own(values):
        v = sorted(values)
        lo, hi = v[-(-len(v) // 10) - 1], v[-(-len(v) // 2) - 1]
        return hi + spread * (hi - lo)

    out = {}
    for lang, source in {r[:2] for r in rows}:
        nested = [rows, [r for r in rows if r[0] == lang], [r for r in rows if r[:2] == (lang, source)]]
        fences = [own(r[2 + k] for r in rows) for k in range(3)]
        for level in nested[1:]:
            weight = min(1, len(level) / own_rows)
            fences = [own(r[2 + k] for r in level) ** weight * f ** (1 - weight) for k, f in enumerate(fences)]
        out[lang, source] = fences
    return out


def upper_estimates(r):
    some = max(r.n_words, 1)
    return (r.n_symbols + 1) / (r.n_words + 1), (r.n_dup_lines + 1) / (r.n_words + 1), r.word_chars / some * (1 + some**-0.5)


def noisy_docs(spark, symbols=1, length=1):
    rng = random.Random(9)
    rows = []
    for k in range(160):
        source = k % 4
        words = ["w" * length * rng.randint(2, 5) for _ in range(rng.randint(20, 60))]
        words += ["#" * symbols for _ in range(rng.randint(source, 3 * source + 3))]
        rows.append((k, " ".join(words), "en" if k % 8 < 6 else None, f"s{source}"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_fences_as_plain_python_and_in_proportion_to_what_is_measured(spark):
    fences = {}
    for symbols, length in ((1, 1), (50, 1), (1, 10)):
        measured = quality.measures(noisy_docs(spark, symbols, length)).withColumnsRenamed({"lang": "_by0", "source": "_by1"})
        found = {(r[0], r[1]): tuple(r)[2:] for r in quality.adaptive_fences(measured, ["_by0", "_by1"]).collect()}
        want = plain_fences([(r["_by0"], r["_by1"], *upper_estimates(r)) for r in measured.collect()])
        assert set(found) == set(want) and all(found[g] == pytest.approx(want[g]) for g in want)
        fences[symbols, length] = found
    for g, (rate, _, length) in fences[1, 1].items():
        assert 25 * rate < fences[50, 1][g][0] < 55 * rate  # one symbol more or less counts for little among many
        assert 5 * length < fences[1, 10][g][2] < 12 * length  # the symbols' own words stay as they are, so lengths spread more


def test_fences_follow_the_group(spark):
    clean = [(k, f"plain words of number {k} stand here in a row of some length", "en", "a") for k in range(40)]
    noisy = [(100 + k, f"a # b # c # d # e # f # g # h # i # j # {k}", "en", "b") for k in range(40)]
    docs = spark.createDataFrame([*clean, *noisy, (50, "w ## x ## y ## z ## a ## b ##", "en", "a")], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.judge_quality(docs).collect()}
    assert not kept.pop(50) and all(kept.values())


def test_fences_reject_what_small_and_bad_groups_hide(spark):
    clean = [(k, f"plain words of number {k} stand here in a row of some length", "en", f"s{k % 3}") for k in range(150)]
    navigation = [(200 + k, f"home | about us | news | contact | all pages | help | page {k} | next", "en", f"s{k % 3}") for k in range(6)]
    alone = [(300, "a ## b ## c ## d ## e ## f ##", "en", "alone"), (301, "a ## b ## c ## d ## e ## f ##", "xx", None), (302, clean[0][1], "en", None), (303, clean[0][1], None, None)]
    bad = [(400 + k, "w ## x ## y ## z ## a ## b ##" if k % 2 else clean[k][1], "en", "bad") for k in range(24)]
    one = [(500, "one line & no more of them stands in this short text", "en", "s0"), (501, "\n".join(["the first line", "a middle line of words", "the first line", "then an end of words"]), "en", "s0")]
    docs = spark.createDataFrame([*clean, *navigation, *alone, *bad, *one], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.judge_quality(docs).collect()}
    junk = {*range(200, 206), 300, 301, *range(401, 424, 2)}
    assert len(kept) == docs.count() and {k for k, v in kept.items() if not v} == junk


def test_minority_groups_keep_their_own_texts(spark):
    rng = random.Random(3)
    word = lambda a, b: "".join(rng.choices("abcdefghij", k=rng.randint(a, b)))
    prose = lambda n, a, b: [word(a, b) for _ in range(n)]
    rows = [("en", "web", " ".join(prose(rng.randint(30, 80), 2, 8))) for _ in range(900)]
    rows += [("zh", "web", " ".join(prose(rng.randint(30, 80), 20, 40))) for _ in range(100)]
    rows += [("en", "code", " ".join(w for x in prose(rng.randint(30, 80), 2, 8) for w in (x, "#" * rng.randint(0, 2)) if w)) for _ in range(100)]
    junk = [("en", "web", " ".join(prose(40, 2, 8) + ["# | $"] * 40)), ("zh", "web", " ".join(prose(40, 20, 40) + ["# | $"] * 40)), ("zh", "web", " ".join(prose(40, 300, 400))), ("en", "code", " ".join(["w ####### %%%%%%%%"] * 3 + prose(20, 2, 8)))]
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows + junk)], "doc_id long, lang string, source string, text string")
    kept = {r.doc_id: r.kept for r in quality.judge_quality(docs).collect()}
    assert {k for k, v in kept.items() if not v} == set(range(1100, 1104))


def test_pipeline_rejects_labelled_junk(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").where("quality IS NOT NULL")
    kept = corpus_pipeline.quality_rules(spark, docs, sf).join(labels, "doc_id").groupBy("quality").count().collect()
    kept = {r.quality: r["count"] for r in kept}
    assert kept.get(0, 0) == 0 and kept[1] >= 0.9 * labels.where("quality = 1").count()


def test_shards(spark, odd, none):
    docs = spark.range(1003).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    a = sharding.shuffle_into_shards(docs, 16, rows_per_partition=100).collect()
    sizes = Counter(r.shard for r in a)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in a if r.shard == s) == list(range(sizes[s]))
    again = sharding.shuffle_into_shards(docs.repartition(7), 16, rows_per_partition=100).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, again))
    other = sharding.shuffle_into_shards(docs, 16, seed=7, rows_per_partition=100).collect()
    assert sorted(map(tuple, a)) != sorted(map(tuple, other))
    placed = sharding.shuffle_into_shards(odd, 4)
    assert placed.count() == odd.count() and len(set(placed.select("shard", "slot").collect())) == odd.count()
    assert sharding.shuffle_into_shards(none).collect() == []


def test_communication_matrix_is_hypergeometric():
    total, mean, n = Counter(), 0.0, 3000
    for seed in range(n):
        m = sharding.communication_matrix([10, 6], [8, 8], seed)
        assert [sum(r) for r in m] == [10, 6] and [sum(c) for c in zip(*m)] == [8, 8]
        total[m[0][0]] += 1
        mean += m[0][0] / n
    assert abs(mean - 5) < 0.1
    from math import comb

    for k, seen in total.items():
        assert abs(seen / n - comb(8, k) * comb(8, 10 - k) / comb(16, 10)) < 0.04


def plain_chats(rows):
    talks = {}
    for c, t, r, x in rows:
        talks.setdefault(c, []).append((t is not None, t or 0, r is not None, r or "", x is not None, x or ""))
    turns = {c: [v[2:] for v in sorted(ts)] for c, ts in talks.items()}
    kept, seen = [], {}
    for c in sorted(turns, key=lambda c: (c is None, c or 0)):
        longer = any(len(o) > len(turns[c]) and o[: len(turns[c])] == turns[c] for o in turns.values())
        if not longer and tuple(turns[c]) not in seen:
            seen[tuple(turns[c])] = c
            kept.append((c, len(turns[c]), "".join(f"<|im_start|>{r or 'unknown' if has else 'unknown'}\n{x}<|im_end|>\n" for has, r, _, x in turns[c])))
    return kept


@pytest.mark.parametrize("span", [2, 1024])
def test_chats_collapse(spark, monkeypatch, span):
    monkeypatch.setattr(chat, "SPAN", span)
    base = [("user", "hi"), ("assistant", "yes"), ("user", "go on"), ("assistant", None), ("user", ""), (None, "end")]
    rows = [(c, t, *base[t]) for c, n in ((5, 3), (2, 3), (9, 6), (4, 1), (7, 6)) for t in range(n)]
    rows += [(11, t, r, "other" if t == 2 else x) for t, (r, x) in enumerate(base)] + [(None, 0, "user", "alone"), (12, None, "user", "no turn"), (12, None, "user", "no turn"), (13, 0, None, None)]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(((r.conv_id, r.n_turns, r.text) for r in got), key=key) == sorted(plain_chats(rows), key=key)
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
