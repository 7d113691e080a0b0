"""The versioned index against a dictionary, and the removal of stored files."""

import os
import random

import pytest

from corpuswell.sources import datasets
from corpuswell.sources.files import Files
from corpuswell.sources.versions import VersionedIndex, clear_snapshot

SCHEMA = "strategy string, doc_id long, position int, chunk_text string"


def chunks(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


def held(frame):
    return sorted((r.strategy, r.doc_id, r.position, r.chunk_text) for r in frame.collect())


def put(state, rows):
    """Rows of a batch: of equal strategy, document and first 50 characters the last position stays, an abstract (-1) before all."""
    for r in sorted(rows, key=lambda r: (r[2] < 0, r[2])):
        state[r[0], r[1], r[3][:50]] = r


def some_rows(rng, n):
    rows = [(rng.choice("ab"), rng.randrange(12), rng.randrange(-1, 4), f"text {rng.randrange(6)} " + "x" * 50 + str(rng.random())) for _ in range(n)]
    return list({(r[0], r[1], r[2], r[3][:50]): r for r in rows}.values())  # one of equal position, as their order is not told


def test_versions_as_a_dictionary(spark, tmp_path, monkeypatch):
    from corpuswell.sources import versions

    monkeypatch.setattr(versions, "LISTED_EVERY", 3)
    rng, index = random.Random(4), VersionedIndex(spark, str(tmp_path / "index"), 3)
    assert index.version() == -1 and index.delete("true") == 0 and index.compact() == 0 and index.clear() == -1
    with pytest.raises(ValueError):
        index.snapshot()
    state, past = {}, []
    for step in range(6):
        rows = some_rows(rng, 25)
        index.upsert(chunks(spark, rows))
        put(state, rows)
        if step in (2, 4):
            gone = [k for k, r in state.items() if r[1] == step]
            assert index.delete(f"doc_id = {step}") == len(gone) > 0
            for k in gone:
                del state[k]
        if step == 3:
            assert index.compact(2) > 0
        past.append((index.version(), sorted(state.values())))
        assert held(index.snapshot()) == past[-1][1]
    for version, rows in past:
        assert held(index.snapshot(version)) == rows
    assert held(index.snapshot(strategy="a")) == sorted(r for r in state.values() if r[0] == "a")
    assert index.compact(0) > 0 and held(index.snapshot()) == sorted(state.values())
    assert index.vacuum() > 0 and index.vacuum() == 0 and held(index.snapshot()) == sorted(state.values())
    index.clear()
    assert held(index.snapshot()) == []


def sizes(folder):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_a_commit_writes_what_it_touches(spark, tmp_path):
    path = str(tmp_path / "index")
    index = VersionedIndex(spark, path, 8)
    index.upsert(chunks(spark, [("a", k, 0, f"text of document {k} " * 40) for k in range(3000)]))
    before = sizes(path)
    index.upsert(chunks(spark, [("a", 5, 0, "another text of document five")]))
    after = sizes(path)
    new = sum(n for f, n in after.items() if f not in before)
    assert all(after[f] == n for f, n in before.items()) and 0 < new < 0.05 * sum(before.values())
    assert index.delete("doc_id = 77") == 1 and index.snapshot().where("doc_id = 77").count() == 0
    # A strategy is a partition, so a scan of another reads nothing of it.
    assert index.snapshot(strategy="other").count() == 0


def test_a_batch_is_committed_once_and_numbers_are_taken_once(spark, tmp_path):
    path = str(tmp_path / "index")
    one, two = VersionedIndex(spark, path, 2), VersionedIndex(spark, path, 2)
    one.upsert(chunks(spark, [("a", 1, 0, "first")]), batch="b0")
    assert one.upsert(chunks(spark, [("a", 1, 0, "again")]), batch="b0") == 0 and held(one.snapshot()) == [("a", 1, 0, "first")]
    # Another writer publishes between reading the log and publishing: both commits count, in the order of their numbers.
    entries = one._entries()
    folders, schema = one._write(two._merged(two._live(entries), schema=entries[-1]["schema"]).where("false").unionByName(two._merged(two._live(entries), entries[-1]["schema"])))
    two.upsert(chunks(spark, [("a", 2, 0, "of two")]), batch="b1")
    assert one._publish(entries, folders, [], "b2", schema) == 2
    assert held(one.snapshot()) == [("a", 1, 0, "first"), ("a", 2, 0, "of two")]
    assert not Files(spark, path).publish("{}", f"{path}/log/{2:020d}.json")


def test_what_a_failed_commit_wrote_is_not_seen(spark, tmp_path):
    index = VersionedIndex(spark, str(tmp_path / "index"), 2)
    index.upsert(chunks(spark, [("a", 1, 0, "first")]))
    index._write(index._merged(index._live(index._entries()), index._entries()[-1]["schema"]))
    assert held(index.snapshot()) == [("a", 1, 0, "first")] and index.vacuum() == 1


def test_nulls_and_empty_batches(spark, tmp_path):
    index = VersionedIndex(spark, str(tmp_path / "index"), 2)
    index.upsert(chunks(spark, [("a", None, 0, "no document"), (None, 1, 0, "no strategy"), ("a", 1, 0, None), ("a b/c", 2, None, "kept")]))
    index.upsert(chunks(spark, []))
    assert [(r.strategy, r.doc_id) for r in index.snapshot().collect()] == [("a b/c", 2)]


def test_clear_snapshot_removes_files_by_prefix(spark, tmp_path):
    path = str(tmp_path / "files")
    rows = [("v1", "p1", b"1"), ("v1", "p2", b"2"), ("v1-late", "p1", b"3"), ("v2", "p1", b"4")]
    datasets.write_files(spark.createDataFrame(rows, "snapshot_id string, paper_id string, content binary"), path)
    assert clear_snapshot(spark, path, "v1") == 3 and clear_snapshot(spark, path, "v1") == 0
    assert [r.content for r in datasets.stored_file(spark, path, "v2", "p1").collect()] == [b"4"]
    assert [n for n in os.listdir(path) if n.startswith("snapshot_id")] == ["snapshot_id=v2"]
