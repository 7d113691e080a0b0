"""Clients that stand for a network: they note their calls in a folder, and are busy or broken as the query or URL says."""

import os

from corpuswell.sources.fetch import FetchError


def _seen(folder: str, what: str) -> int:
    with open(os.path.join(folder, "calls"), "a") as f:
        f.write(what + "\n")
    with open(os.path.join(folder, "calls")) as f:
        return f.read().split("\n").count(what)


def pages(folder: str):
    def page(query: str, start: int, n: int):
        times = _seen(folder, f"{query}@{start}")
        if query == "busy once" and times == 1:
            raise FetchError(429)
        if query == "always busy":
            raise FetchError(429, "later")
        if query == "broken" and start:
            raise OSError("connection lost")
        return [{"id": f"http://x.org/abs/{query[0]}{k}v2", "title": f"{query} {k}"} for k in range(start, min(start + n, 7))]

    return page


def files(folder: str):
    def get(url: str):
        times = _seen(folder, url)
        if "busy" in url:
            return (429, b"") if times < 3 else (200, b"at last")
        if "gone" in url:
            return 404, b"not here"
        if "broken" in url:
            raise OSError("connection lost")
        return 200, url.encode()

    return get
