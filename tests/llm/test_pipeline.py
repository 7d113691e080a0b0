import random

import public_tokenizers as P
import tiktoken

import corpus_pipeline as cp
from corpuswell.llm import bpe
from tests.llm.test_near_dedup import brute as brute_links
from tests.llm.test_suffix_dedup import brute as brute_spans

SF = "/root/testdata/sf0.001"


def test_each_stage_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = cp.staged(cp.quality_rules(spark, docs, SF), "t")
    assert kept.columns == docs.columns and 0.5 * docs.count() < kept.count() < docs.count()
    near = cp.staged(cp.near_duplicates(spark, kept, SF), "t")
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(r.doc_id for r in near.collect()) == sorted(i for i, _, c in brute_links(rows, 5, 80, 100) if i == c)
    cut = cp.staged(cp.repeated_passages(spark, near, SF), "t")
    texts = {r.doc_id: r.text for r in cut.collect()}
    for i, n, spans, bytes_ in brute_spans([(r.doc_id, r.text) for r in near.collect()]):
        if not spans:
            assert len(texts[i].encode()) == n
        else:
            assert i not in texts and not bytes_ or abs(len(texts[i].encode()) - len(bytes_)) <= 6 * len(spans)
    mixed = cp.staged(cp.mixing_to_targets(spark, cut, SF), "t")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = {r.doc_id for r in cut.collect()} - {r.doc_id for r in mixed.collect()}
    assert all(labels.get(i, 1) == 1 for i in gone)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    done = {r.doc_id: r.ids for r in cp.byte_level_bpe(spark, mixed, SF).collect()}
    assert done == {r.doc_id: own.encode_ordinary(r.text) for r in mixed.collect()}


def test_odd_rows_and_empty_tables(spark, odd, none):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars", "shard")
    for table in (docs, none.select(docs.columns)):
        for _, stage in cp.STAGES[:-1]:
            table = cp.staged(stage(spark, table, SF), "t")
            assert table.columns == docs.columns
        assert cp.STAGES[-1][1](spark, table, SF).count() == table.count()


def test_toxic_documents_leave_a_small_table(spark, tmp_path):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    insults = ["scumbag", "vermin", "halfwit"]
    rows = []
    for k in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(30, 60))]
        if k % 8 == 0:
            words[7] = insults[k // 8 % 3]
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.createDataFrame([(k, int(k % 8 == 0)) for k in range(96)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = {r.doc_id for r in cp.mixing_to_targets(spark, docs, str(tmp_path)).collect()}
    assert left == {k for k, _ in rows if k % 8}


def test_rows_of_one_id_and_columns_of_other_types(spark):
    import datetime

    texts = [f"a text of its own with the number {k} and some more words so that it stays as it is until the end of {k}" for k in range(6)]
    at, ntz = datetime.datetime(2024, 1, 2, 3, 4, 5, 678901, datetime.timezone.utc), datetime.datetime(2024, 1, 2, 3, 4, 5, 678901)
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (2, texts[1] + " x"), (None, texts[2]), (None, texts[3]), (5, None), (5, texts[4])]
    rows = [(i, t, "en", "s", len(t or ""), at, ntz, b"\x00\xff", float("nan"), k) for k, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, at timestamp, ntz timestamp_ntz, raw binary, x double, _document_node int")
    near = cp.staged(cp.near_duplicates(spark, docs, SF), "t")
    left = {(r.doc_id, r.text or "") for r in near.collect()}
    # Which of (1, text) and its near copy under 2 stays depends on whether that row of doc_id 1 has the doc_id as its number.
    alike = {(1, texts[1]), (2, texts[1] + " x")}
    assert near.count() == 6 and len(left & alike) == 1
    assert left - alike == {(1, texts[0]), (None, texts[2]), (None, texts[3]), (5, ""), (5, texts[4])}
    cut = cp.repeated_passages(spark, near, SF)
    assert cut.schema == near.schema
    assert {(r.at.astimezone(datetime.timezone.utc), r.ntz, bytes(r.raw), str(r.x)) for r in cut.collect()} == {(at, ntz, b"\x00\xff", "nan")}
    assert cp.mixing_to_targets(spark, cut, SF).schema == near.schema


def test_targets_decide_what_is_kept(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    marks = [["fine"], ["lowly", "shabby"], ["scumbag", "vermin"]]
    rows = []
    for k in range(600):
        words = [rng.choice(vocabulary) for _ in range(40)]
        domain = 0 if k % 3 == 0 else 1 + k % 2
        words[rng.randint(0, 39)] = rng.choice(marks[domain])
        rows.append((k, " ".join(words), domain))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = [(k, int(d == 0), int(d == 2)) for k, _, d in rows[:450]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for targets in ([0.98, 0.02, 0.0], [0.5, 0.3, 0.2], [0.6, 0.0, 0.4]):
        monkeypatch.setattr(cp, "TARGETS", targets)
        kept = {r.doc_id for r in cp.mixing_to_targets(spark, docs, str(tmp_path)).collect()}
        share = [sum(d == j for k, _, d in rows if k in kept) / len(kept) for j in range(3)]
        assert all(abs(a - b) < 0.05 for a, b in zip(share, targets))
        assert sum(d == 0 for k, _, d in rows if k in kept) >= 196  # of 200
