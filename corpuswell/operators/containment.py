"""Which texts hold which items, as an equi-join: both sides are met by a few of their grams, and only what meets is looked at."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuswell.staging import staged

#: Lengths of grams in bytes. An item is met by grams of the largest length n for which it has n of them, so 2 n - 1 bytes.
GRAMS = (32, 16, 8, 4, 2, 1)
#: Bytes of text that are hashed at once: what is made of them fits a core's cache.
CHUNK = 64 << 10
#: Sets of terms, and bytes of them, that each task looks for by itself at most; more of them meet the texts by grams.
SETS, SET_BYTES = 512, 1 << 20
#: Rows after which a task looks again which sets can still gain a document.
STEP = 256
_U = np.uint64


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
    return (h ^ (h >> _U(27))) * _U(0x81DADEF4BC2DD44D)


def least_grams(data: np.ndarray, n: int) -> np.ndarray:
    """For each place the least hash of the n grams of n bytes that begin there and at the n - 1 places after it; n is a power of two."""
    h = _mixed(data.astype(_U) + _U(n << 8))
    reach = 1
    while reach < n:
        h = _mixed(h[: len(h) - reach] * _U(3) + h[reach:]) if len(h) > reach else h[:0]
        reach *= 2
    reach = 1
    while reach < n:
        h = np.minimum(h[: len(h) - reach], h[reach:]) if len(h) > reach else h[:0]
        reach *= 2
    return h


def _spans(texts: pa.Array, chunk: int):
    """Some texts at a time as (first row, bytes, where each text begins and at last ends)."""
    raw = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(raw):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + chunk, "right")) - 1)
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def _text_grams(lengths: list[int], chunk: int = CHUNK):
    """Of each text the distinct least grams at all its places."""

    def run(batches):
        for batch in batches:
            for lo, data, edges in _spans(batch.column(1), chunk):
                for n in lengths:
                    least = least_grams(data, n)
                    owner = np.repeat(np.arange(len(edges) - 1), np.diff(edges))[: len(least)]
                    inside = np.flatnonzero(np.arange(len(least)) + 2 * n - 1 <= edges[1:][owner])
                    # Neighbours mostly have the same least gram, so what changes is sorted only.
                    least, owner = least[inside], owner[inside]
                    new = np.append(True, (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]))[: len(least)]
                    least, owner = least[new], owner[new]
                    order = np.lexsort((least, owner))
                    least, owner = least[order], owner[order]
                    new = np.append(True, (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]))[: len(least)]
                    rows = batch.column(0).take(pa.array(lo + owner[new]))
                    yield pa.record_batch([rows, pa.array(np.full(len(rows), n, np.int32)), pa.array(least[new].view(np.int64))], ["doc_id", "length", "gram"])

    return run


def _item_grams(batches):
    """Of each item the least gram at its first place."""
    for batch in batches:
        out = []
        for k, item in enumerate(batch.column(1).to_pylist()):
            raw = item.encode()
            n = next(n for n in GRAMS if len(raw) >= 2 * n - 1)
            out.append((k, n, int(least_grams(np.frombuffer(raw[: 2 * n - 1], np.uint8), n)[:1].view(np.int64)[0])))
        rows, lengths, grams = zip(*out) if out else ((), (), ())
        yield pa.record_batch([batch.column(0).take(pa.array(rows, pa.int64())), batch.column(1).take(pa.array(rows, pa.int64())), pa.array(lengths, pa.int32()), pa.array(grams, pa.int64())], ["query_id", "item", "length", "gram"])


def containing(items: DataFrame, docs: DataFrame, text: str | Column = "text") -> DataFrame:
    """query_id, doc_id of each item (query_id, item) and each document (doc_id, text) that holds it, once where item rows are equal and else as often as rows stand for them.

    An item has n grams of n bytes at its first n places. A text that holds the item holds the same grams one after the other, so the least of them is the
    least gram at some place of the text: both sides meet by it, in an equi-join. A text gives few distinct least grams, about two in n + 1 of its
    bytes. Texts of what meets are looked up by doc_id and compared whole. Items shorter than three bytes meet by their first byte.

    Null texts and items hold and are held by nothing; an empty item is held by every text.
    """
    value = F.col(text) if isinstance(text, str) else text
    rows = docs.select("doc_id", value.alias("text")).where("text IS NOT NULL")
    items = items.select("query_id", "item").where("item IS NOT NULL")
    some = items.where("item <> ''")
    kinds = {c: t for df in (docs, items) for c, t in df.dtypes}
    anchors = some.mapInArrow(_item_grams, f"query_id {kinds['query_id']}, item string, length int, gram long")
    lengths = sorted(r["length"] for r in anchors.select("length").distinct().collect())  # some of GRAMS
    grams = rows.mapInArrow(_text_grams(lengths, CHUNK), f"doc_id {kinds['doc_id']}, length int, gram long")
    # Staged, so that its size is known: texts are shuffled only where there is too much of it for a broadcast.
    met = staged(grams.join(anchors, ["length", "gram"]).select("doc_id", "query_id", "item").distinct(), "met")
    found = rows.join(met, "doc_id").where(F.contains("text", "item")).select("doc_id", "query_id")
    empty = items.where("item = ''").select("query_id", F.lit(0).alias("_all"))
    if not empty.isEmpty():  # what is wanted of such are all texts for each
        found = found.unionByName(rows.select("doc_id", F.lit(0).alias("_all")).join(empty, "_all").select("doc_id", "query_id"))
    return found.select("query_id", "doc_id")


def _first(sets: list[list[str]], k: int, step: int):
    """Of the texts (doc_id, text) that a task meets, the k smallest doc_ids of those that hold all terms of each set. A set that has k of them is looked for only in texts of a smaller doc_id."""
    wanted = [sorted((t.encode() for t in terms), key=len, reverse=True) for terms in sets]

    def run(batches):
        best: list[list] = [[] for _ in sets]
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for lo in range(0, len(batch), step):
                part = batch.slice(lo, step)
                ids, texts = part.column(0).to_pylist(), part.column(1).cast(pa.large_binary()).to_pylist()
                least = min(ids)
                left = [(terms, own) for terms, own in zip(wanted, best) if len(own) < k or least < own[-1]]
                if not left:
                    continue
                for doc, text in zip(ids, texts):
                    for terms, own in left:
                        if (len(own) < k or doc < own[-1]) and all(t in text for t in terms):
                            at = bisect_left(own, doc)
                            if at == len(own) or own[at] != doc:
                                own.insert(at, doc)
                                del own[k:]
        if kind is not None:
            terms = pa.array([x for x, own in zip(sets, best) for _ in own], pa.list_(pa.string()))
            yield pa.record_batch([terms, pa.array([doc for own in best for doc in own], kind)], ["terms", "doc_id"])

    return run


def first_holding(wanted: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id of the k smallest doc_ids of documents (doc_id, text) that hold all terms of each query (query_id, terms: array of strings, not null).

    Up to SETS different sets of terms, by measure, are looked for where texts are read, and a task hands on no more than k documents of a set; so a term that most
    texts hold makes no row for each of them, and is hardly looked for once k are known. More sets meet the texts as in `containing`.
    """
    rows = docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    sets = wanted.select("terms").distinct()
    size = sets.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.array_join("terms", " "))), F.lit(0)).alias("bytes")).first()
    if size["n"] <= SETS and size["bytes"] <= SET_BYTES:
        found = rows.mapInArrow(_first([r["terms"] for r in sets.collect()], k, STEP), f"terms array<string>, doc_id {dict(docs.dtypes)['doc_id']}").distinct()
        place = F.row_number().over(Window.partitionBy("terms").orderBy("doc_id"))
        return wanted.join(found.withColumn("_n", place).where(F.col("_n") <= k), "terms").select("query_id", "doc_id")
    each = wanted.select("query_id", F.size("terms").alias("n"), F.explode("terms").alias("item"))
    held = containing(each.select(F.struct("query_id", "n", "item").alias("query_id"), "item"), rows)
    full = held.groupBy("query_id.query_id", "query_id.n", "doc_id").agg(F.count_distinct("query_id.item").alias("c")).where("c = n")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))
    return full.withColumn("_n", place).where(F.col("_n") <= k).select("query_id", "doc_id")
