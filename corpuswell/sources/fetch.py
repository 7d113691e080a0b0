"""Remote papers: a search source with planned pages, and downloads, both with retries, and with rows for what failed."""

from __future__ import annotations

import importlib
import json
import os
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpuswell.config import SETTINGS as S

#: Entries of a page at most, and the status that asks to come back later.
PAGE, BUSY = 50, 429


class FetchError(Exception):
    """What a client raises for a response that is not good; status 429 is tried again."""

    def __init__(self, status: int, message: str = ""):
        super().__init__(f"{status} {message}".strip())
        self.status = status


def with_retries(call: Callable[[], object], retries: int, base_seconds: float, sleep: Callable[[float], None] = time.sleep) -> tuple[object, int]:
    """(what call gives, attempts). A busy server is asked again, `retries` times at most, after base_seconds, twice that, and so on; then, and for
    any other error, the error is raised, with its attempts."""
    for attempt in range(retries + 1):
        try:
            return call(), attempt + 1
        except Exception as error:
            busy = getattr(error, "status", None) == BUSY or str(BUSY) in str(error)
            error.attempts = attempt + 1
            if not busy or attempt == retries:
                raise
            sleep(base_seconds * 2**attempt)
    raise AssertionError


def client(name: str):
    """The client that `module:function` or `module:function:argument` names: a function of a page (query, start, n) to entries, or of a URL to (status, bytes)."""
    module, function, *argument = name.split(":", 2)
    found = getattr(importlib.import_module(module), function)
    return found(*argument) if argument else found


def folder_pages(path: str) -> Callable[[str, int, int], list[dict]]:
    """A client of a folder that stands for the network: entries are the lines of its file entries.json whose title or summary holds all words of the query."""

    def page(query: str, start: int, n: int) -> list[dict]:
        with open(os.path.join(path, "entries.json")) as lines:
            entries = [json.loads(x) for x in lines if x.strip()]
        terms = [t.strip('"').lower() for t in query.split()]
        return [e for e in entries if all(t in f"{e.get('title') or ''} {e.get('summary') or ''}".lower() for t in terms)][start : start + n]

    return page


def folder_files(path: str) -> Callable[[str], tuple[int, bytes]]:
    """A client of a folder whose files are named by the last parts of URLs."""

    def get(url: str) -> tuple[int, bytes]:
        file = os.path.join(path, url.rpartition("/")[2])
        if not os.path.exists(file):
            return 404, b""
        with open(file, "rb") as f:
            return 200, f.read()

    return get


SEARCHED = "query string, place int, id string, title string, abstract string, published string, url string, authors array<string>, categories array<string>, attempts int, error string"


class _Page(InputPartition):
    def __init__(self, query: str, start: int, n: int):
        self.query, self.start, self.n = query, start, n


class PaperSearch(DataSource):
    """`spark.read.format("paper_search")` with the options queries (a JSON list of search strings), client (see client), most (entries of a query), page,
    retries and base_seconds: a row for each entry found, and for each page that failed a row with its error. A page of a query is a partition."""

    @classmethod
    def name(cls) -> str:
        return "paper_search"

    def schema(self) -> str:
        return SEARCHED

    def reader(self, schema) -> DataSourceReader:
        return _Search(self.options)


class _Search(DataSourceReader):
    def __init__(self, options):
        get = lambda key, default: type(default)(options.get(key, default))
        self.queries, self.client = json.loads(options["queries"]), options["client"]
        self.most, self.retries, self.base_seconds = get("most", S.search_results), get("retries", 3), get("base_seconds", 3.0)
        self.page = max(1, min(PAGE, get("page", self.most)))

    def partitions(self) -> list[InputPartition]:
        return [_Page(q, at, min(self.page, self.most - at)) for q in self.queries for at in range(0, self.most, self.page)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        call = client(self.client)
        try:
            entries, attempts = with_retries(lambda: call(partition.query, partition.start, partition.n), self.retries, self.base_seconds)
        except Exception as error:
            yield (partition.query, partition.start, *[None] * 7, getattr(error, "attempts", 1), f"{type(error).__name__}: {error}")
            return
        for k, e in enumerate(entries):
            name = str(e["id"]).split("/")[-1].split("v")[0]
            yield (partition.query, partition.start + k, name, e.get("title"), e.get("summary"), e.get("published"), e.get("url") or e["id"], e.get("authors") or [], e.get("categories") or [], attempts, None)


DOWNLOADED = "status int, content binary, attempts int, error string"


def download(papers: DataFrame, client_name: str, retries: int = 3, base_seconds: float = 3.0) -> DataFrame:
    """papers (paper_id, url and other columns) with status, content, attempts and error of a GET of each url by a client (see client).

    Content is there for status 200 only. What failed, by its status or an error, keeps its row; a null url is an error. Tasks fetch one after the other; how
    many at a time is the number of partitions of papers.
    """

    def run(batches):
        get = client(client_name)

        def once(url: str) -> tuple[int, bytes]:
            status, content = get(url)
            if status == BUSY:
                raise FetchError(status)
            return status, content

        for batch in batches:
            rows = []
            for url in batch.column(batch.schema.get_field_index("url")).to_pylist():
                try:
                    if url is None:
                        raise ValueError("no url")
                    (status, content), attempts = with_retries(lambda: once(url), retries, base_seconds)
                    rows.append((status, content if status == 200 else None, attempts, None if status == 200 else f"status {status}"))
                except Exception as error:
                    rows.append((getattr(error, "status", None), None, getattr(error, "attempts", 0), f"{type(error).__name__}: {error}"))
            kinds = [pa.int32(), pa.binary(), pa.int32(), pa.string()]
            added = [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 4, kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "status", "content", "attempts", "error"])

    taken = [c for c in papers.columns if c in ("status", "content", "attempts", "error")]
    if taken:
        raise ValueError(f"columns {taken} are what a download adds")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in papers.schema)
    return papers.mapInArrow(run, f"{fields}, {DOWNLOADED}")
