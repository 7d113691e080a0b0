import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from corpuswell.llm import token_output as to

PATH = P.path("byte_bpe_50k.json")


def test_files_hold_what_the_library_gives(spark, odd, none):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    rows = sorted(((r.doc_id is not None, r.doc_id, r.text or "") for r in odd.collect()), key=lambda r: (r[0], r[1] or 0, r[2]))
    at, want = 0, []
    for (_, i, _), e in zip(rows, t.encode_batch([r[2] for r in rows], add_special_tokens=False)):
        ids = [*e.ids, 0]
        want.append((at, i, ids))
        at += len(ids)
    path = to.write_tokens(odd, PATH)
    got = [(r.start, r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in to.read_tokens(spark, path).collect()]
    assert sorted(got) == want
    assert sorted((r.start, r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in to.read_tokens(spark, path, broadcast_frames=0).collect()) == want
    assert to.read_tokens(spark, to.write_tokens(none, PATH)).collect() == []


@pytest.mark.parametrize("with_added", [True, False])
def test_added_tokens_as_the_library(spark, with_added):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = not with_added
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, f"{end}{end}", f"x{end}", f"  {end}  y's {end}'s\n{end}\n", "<|endoftext|", f"plain {chr(0x10FFFF)} text", f"12{end}34 !{end}!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    path = to.write_tokens(docs, PATH, with_added=with_added)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in to.read_tokens(spark, path).collect()}
    assert got == {i: [*t.encode(x, add_special_tokens=False).ids, 0] for i, x in enumerate(texts)}


@pytest.mark.parametrize("n", [1, 31, to.BLOCK - 1, to.BLOCK, 3 * to.BLOCK + 5])
def test_codes_round_trip_and_show_damage(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 4000).astype(np.uint32)
    seen, counts = np.unique(ids, return_counts=True)
    freq = to.scaled_frequencies(seen.tolist(), counts.tolist())
    assert freq.sum() == 1 << to.SCALE and (freq[seen] > 0).all()
    _, cum = to._tables(freq)
    coded, slots = to.encode_frame(ids, freq, cum), np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
    read = lambda stream: to.decode_frame(n, coded["sizes"].astype(np.int64), coded["states"], stream, coded["sums"], freq, cum, slots)
    assert (read(coded["stream"]) == ids).all()
    if len(coded["stream"]):
        broken = coded["stream"].copy()
        broken[0] ^= 1
        with pytest.raises(ValueError, match="checksum"):
            read(broken)
