"""Searches and downloads with retries: nothing is lost silently."""

import json

import pytest

from corpuswell.sources import fetch


def calls(folder):
    return sorted((folder / "calls").read_text().split("\n")[:-1])


def search(spark, queries, client, **options):
    spark.dataSource.register(fetch.PaperSearch)
    return spark.read.format("paper_search").options(queries=json.dumps(queries), client=client, **options).load()


def test_backoff_doubles_and_other_errors_are_raised_at_once():
    slept, answers = [], [fetch.FetchError(429), OSError("HTTP 429 Too Many Requests"), "good"]

    def call():
        answer = answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer

    assert fetch.with_retries(call, 3, 3.0, slept.append) == ("good", 3) and slept == [3.0, 6.0]
    answers[:] = [fetch.FetchError(429)] * 3
    with pytest.raises(fetch.FetchError) as told:
        fetch.with_retries(call, 2, 1.0, slept.append)
    assert told.value.attempts == 3
    answers[:] = [fetch.FetchError(500)]
    with pytest.raises(fetch.FetchError):
        fetch.with_retries(call, 2, 1.0, slept.append)


def test_search_has_a_partition_for_each_page_and_a_row_for_each_failure(spark, tmp_path):
    found = search(spark, ["plain", "busy once", "always busy", "broken"], f"tests.fetch_clients:pages:{tmp_path}", most=10, page=5, retries=2, base_seconds=0.01)
    assert found.rdd.getNumPartitions() == 8
    rows = found.collect()
    good = {q: sorted((r.place, r.id) for r in rows if r.query == q and r.error is None) for q in ("plain", "busy once", "broken", "always busy")}
    assert good["plain"] == [(k, f"p{k}") for k in range(7)] and len(good["busy once"]) == 7 and len(good["broken"]) == 5 and good["always busy"] == []
    lost = {(r.query, r.place): (r.attempts, r.error) for r in rows if r.error}
    assert lost == {("broken", 5): (1, "OSError: connection lost"), ("always busy", 0): (3, "FetchError: 429 later"), ("always busy", 5): (3, "FetchError: 429 later")}
    assert {r.attempts for r in rows if r.query == "busy once"} == {2}


def test_a_folder_stands_for_the_network(spark, tmp_path):
    entries = [{"id": f"http://x.org/abs/24{k}v1", "title": f"Owls {k}", "summary": "of the wood" if k % 2 else None} for k in range(30)]
    (tmp_path / "entries.json").write_text("\n".join(map(json.dumps, entries)))
    rows = search(spark, ["owls wood"], f"corpuswell.sources.fetch:folder_pages:{tmp_path}").collect()
    assert [r.id for r in sorted(rows, key=lambda r: r.place)] == [f"24{k}" for k in range(1, 30, 2)] and not any(r.error for r in rows)
    (tmp_path / "241").write_bytes(b"paper")
    papers = spark.createDataFrame([("241", "http://x.org/pdf/241"), ("243", "http://x.org/pdf/243")], "paper_id string, url string")
    got = {r.paper_id: (r.status, r.content) for r in fetch.download(papers, f"corpuswell.sources.fetch:folder_files:{tmp_path}").collect()}
    assert got == {"241": (200, b"paper"), "243": (404, None)}


def test_downloads_keep_what_failed(spark, tmp_path):
    papers = spark.createDataFrame([(k, u) for k, u in enumerate(["http://a/1", "http://a/busy", "http://a/gone", "http://a/broken", None])], "paper_id long, url string").coalesce(1)
    rows = {r.paper_id: tuple(r)[2:] for r in fetch.download(papers, f"tests.fetch_clients:files:{tmp_path}", retries=3, base_seconds=0.01).collect()}
    assert rows == {0: (200, b"http://a/1", 1, None), 1: (200, b"at last", 3, None), 2: (404, None, 1, "status 404"), 3: (None, None, 1, "OSError: connection lost"), 4: (None, None, 0, "ValueError: no url")}
    assert calls(tmp_path).count("http://a/busy") == 3
    few = {r.paper_id: (r.status, r.error) for r in fetch.download(papers.where("paper_id = 1"), f"tests.fetch_clients:files:{tmp_path}", retries=0).collect()}
    assert few == {1: (200, None)}
    with pytest.raises(ValueError):
        fetch.download(papers.selectExpr("paper_id", "url", "1 AS status"), "x:y")
    assert fetch.download(papers.where("false"), f"tests.fetch_clients:files:{tmp_path}").collect() == []
