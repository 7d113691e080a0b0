import random

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken

from corpuswell.llm import bpe
from corpuswell.llm._textkernels import pretoken_starts, ragged_take, segment_hashes
from tests.llm.conftest import key

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def test_pretokens_are_the_matches_of_the_pattern():
    rng, pattern = random.Random(1), regex.compile(P.PATTERN)
    letters = ["'", "s", "t", "r", "e", "l", "v", " ", " ", "\n", "1", "²", "é", "ß", "!", "-", "d", "m", "\t", "中", "🙂", " ", "́", " "]
    for _ in range(1500):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(5)]
        joined, firsts = "".join(texts), np.cumsum([0, *map(len, texts)])
        _, starts = pretoken_starts(joined, firsts[:-1])
        ends = [*starts[1:], len(joined)]
        assert [joined[a:b] for a, b in zip(starts, ends)] == [w for t in texts for w in pattern.findall(t)]


def test_kernels():
    data, offsets = np.arange(20), np.array([0, 3, 3, 7, 20])
    got, ends = ragged_take(data, offsets, np.array([2, 0, 1, 2]))
    assert got.tolist() == [3, 4, 5, 6, 0, 1, 2, 3, 4, 5, 6] and ends.tolist() == [4, 7, 7, 11]
    text = np.frombuffer(b"abcabcab", np.uint8)
    h = segment_hashes(text, np.array([0, 3, 0]), np.array([3, 6, 2]))
    assert h[0] == h[1] != h[2]


@pytest.mark.parametrize("block", [1 << 10, 12 << 20])
def test_as_the_library(spark, odd, none, monkeypatch, block):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    rows = [(r.doc_id, r.text or "") for r in odd.collect()]
    want = [(i, own.encode_ordinary(t), t.encode()) for i, t in rows]
    if block < 1 << 12:  # many small shares, and a task that forgets
        monkeypatch.setattr(bpe, "PER_SHARE", 1 << 12)
        monkeypatch.setattr(bpe, "KNOWN", 100)
    got = [(r.doc_id, r.ids, bytes(r.decoded)) for r in bpe.encode_decode(odd, PATH).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert bpe.encode_decode(none, PATH).collect() == []
