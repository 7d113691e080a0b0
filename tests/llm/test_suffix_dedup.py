import random

import numpy as np

import public_tokenizers as P
import pytest

from corpuswell.llm import bpe
from corpuswell.llm import suffix_dedup as sd
from tests.llm.conftest import key


def brute(rows):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - sd.SPAN + 1):
            s = b[p : p + sd.SPAN]
            if s in seen:
                gone[p : p + sd.SPAN] = b"\x01" * sd.SPAN
            seen.add(s)
        edges = [p for p in range(len(b) + 1) if (p < len(b) and gone[p]) != (p > 0 and gone[p - 1])]
        out.append((i, len(b), list(zip(edges[::2], edges[1::2])), bytes(x for x, g in zip(b, gone) if not g)))
    return out


def found(df):
    return [(r.doc_id, r.n_bytes, [(s.begin, s.end) for s in r.spans], bytes(r.kept)) for r in df.collect()]


def test_as_brute_force(spark, tmp_path):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randint(10, 60))) for _ in range(8)]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(0, 5)):
            x = rng.choice(passages)
            if rng.random() < 0.4:
                k = rng.randrange(len(x))
                x = x[:k] + rng.choice("xyz") + x[k + 1 :]
            parts.append(rng.choice([x[rng.randrange(len(x)) :], x, "z" * rng.randint(0, 260), "ab" * rng.randint(0, 130), "\x00" * rng.randint(0, 120)]))
        rows.append((i, "".join(parts)))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    assert sorted(found(sd.remove_repeats(spark.read.parquet(str(tmp_path / "d"))))) == brute(rows)


def test_tasks_follow_the_bytes(spark, odd, monkeypatch):
    want = sorted(found(sd.remove_repeats(odd)), key=key)
    monkeypatch.setattr(sd, "PER_BUCKET", 1 << 12)
    monkeypatch.setattr(sd, "PER_SHARE", 1 << 11)
    assert sorted(found(sd.remove_repeats(odd)), key=key) == want


def test_rows_that_change_between_reads_are_an_error(spark):
    docs = spark.range(0, 40, 1, 2).mapInPandas(lambda parts: (p.assign(doc_id=p["id"], text=[f"{random.random():.9f} " * 30 for _ in p["id"]])[["doc_id", "text"]] for p in parts), "doc_id long, text string")
    with pytest.raises(Exception, match="must give the same rows"):
        sd.remove_repeats(docs).collect()
    with pytest.raises(Exception, match="must give the same rows"):
        bpe.encode_decode(docs, P.path("byte_bpe_multi_50k.tiktoken")).collect()


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want, got = sorted(brute(rows), key=key), sorted(found(sd.remove_repeats(odd)), key=key)
    assert [g[:2] for g in got] == [w[:2] for w in want] and sum(len(g[3]) for g in got) == sum(len(w[3]) for w in want)
    assert [g for g in got if g[0] is not None] == [w for w in want if w[0] is not None]
    assert found(sd.remove_repeats(none)) == []


def test_whole_characters_stay_readable(spark, tmp_path):
    long = "é中🙂" * 60
    rows = [(0, "a" + long), (1, "bb" + long), (2, "É" + long)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    for _, _, _, kept in found(sd.remove_repeats(spark.read.parquet(str(tmp_path / "d")), whole_characters=True)):
        kept.decode()


def test_sorter_orders_and_measures():
    rng = np.random.default_rng(0)
    for turn in range(40):
        n, length = int(rng.integers(1, 60)), int(rng.choice([8, 20, 50, 100]))
        base = rng.integers(0, 3, (max(1, n // 4), length)).astype(np.uint8)
        rows = base[rng.integers(0, len(base), n)].copy()
        for i in range(n):
            if rng.random() < 0.6:
                rows[i, rng.integers(0, length)] = rng.integers(0, 4)
        order, common = sd.deep_shallow(rows, 8 if turn % 2 else 24)
        text = [r.tobytes() for r in rows]
        assert [text[i] for i in order] == sorted(text)
        for k in range(1, n):
            a, b = text[order[k - 1]], text[order[k]]
            assert common[k] == next((j for j in range(length) if a[j] != b[j]), length)
