"""The columns that the registered queries derive, over whole small tables, against the libraries or plain Python."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from corpuswell.llm import queries
from tests.llm.test_near_dedup import brute, family

SPACE = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    shared = " ".join(f"shared{rng.randrange(10**6)}" for _ in range(40))
    texts = family(3, 12, 50, 4) + ["", None, " \n", "under the MIT license: use it. CC BY-NC", "Apache License, Version 2.0 — under the mit license", "é中🙂 don't 12½\n\n\x00"]
    texts += [f"begin {k} {shared} end {k}" for k in range(4)] + ["ab" * 400, "x" + "ab" * 300]
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(3 * k + 1, t, "en" if k % 2 else None, "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], k % 2, 0) for k, r in enumerate(rows)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, [(r[0], r[1]) for r in rows]


def found(spark, tables, name, *columns):
    rows = queries.QUERIES[name](spark, tables[0]).select("doc_id", *columns).collect()
    assert len(rows) == len(tables[1])
    return {r.doc_id: tuple(r)[1:] for r in rows}


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def test_op1(spark, tables):
    want = {i: (n, c, i == c) for i, n, c in brute(tables[1], 3, 85, 100)}
    assert found(spark, tables, "op1_near_dedup", "n_shingles", "component_id", "kept") == want


def test_op2(spark, tables):
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = {i: encoder.encode_ordinary(t or "") for i, t in tables[1]}
    want = {i: (len(ids[i]), sha(",".join(map(str, ids[i])).encode()), sha((t or "").encode())) for i, t in tables[1]}
    assert found(spark, tables, "op2_byte_bpe", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_op4(spark, tables):
    seen, want = set(), {}
    for i, t in sorted(tables[1]):
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(raw[k : k + 100])
        left = bytes(b for b, g in zip(raw, gone) if not g)
        want[i] = (len(raw), int(gone.sum()), int((np.diff(np.append(False, gone).astype(int)) == 1).sum()), sha(left))
    assert any(w[1] for w in want.values())
    assert found(spark, tables, "op4_suffix_dedup", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_op5(spark, tables):
    phrases = {("under", "the", "mit", "license"): "mit", ("apache", "license", "version", "2"): "apache-2", ("cc", "by", "nc"): "cc-by-nc"}
    want = {}
    for i, t in tables[1]:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        places = [(k, label) for p, label in phrases.items() for k in range(len(words)) if tuple(words[k : k + len(p)]) == p]
        want[i] = (len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({label for _, label in places})))
    got = found(spark, tables, "op5_license_scan", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert {i: r[:5] for i, r in got.items()} == want
    assert all(set(r[4].split(",")) - {""} <= set(r[5].split(",")) and 0 <= r[6] <= 1 for r in got.values())


def test_op6(spark, tables):
    from tokenizers import Tokenizer

    tokenizer, start, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, {}
    for i, t in sorted(tables[1]):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert found(spark, tables, "op6_token_files", "start", "n_tokens", "ids_crc32") == want


def test_op9(spark, tables):
    got = found(spark, tables, "op9_mixing", "n_tokens", "p_clean", "p_low", "p_toxic", "rate", "copies", "converged", "target_gap")
    for i, t in tables[1]:
        n, *p, rate, copies, _, gap = got[i]
        assert sum(p) == pytest.approx(1) and rate >= 0 and abs(copies - rate) < 1 and gap >= 0
        assert (n > 0) == bool((t or "").strip(SPACE))


def test_op10(spark, tables):
    got = found(spark, tables, "op10_hypergeometric_shards", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    slots = {}
    for i, t in tables[1]:
        size, crc, law, shard, slot, grown = got[i]
        assert (size, crc, law, grown) == (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "rows", None)
        slots.setdefault(shard, []).append(slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(s, [])) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(tables[1])
