"""An inverted index in segments: postings in blocks by impact, each with a bound, and Okapi top-k that stops by the bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswell.functions.text import words
from corpuswell.operators.listing import listed as _listed
from corpuswell.operators.vectors import unit_rows
from corpuswell.staging import staged

#: Words of a segment, rows that are taken up at a time, documents of a block of postings, query words that meet a segment at a time.
SEGMENT, STEP, BLOCK, QUERY_WORDS = 2_000_000, 1024, 256, 1_000_000
#: Distinct query words that are broadcast at most.
BROADCAST_TERMS = 500_000
#: Okapi's parameters: how fast repeated words saturate, how much length counts, what share of the mean weight a negative one becomes.
K1, B, EPSILON = 1.5, 0.75, 0.25
_SLACK = 1e-7


def _schema(doc_type: str) -> str:
    return f"segment long, term string, n int, max_tf int, min_dl int, docs binary, tfs binary, dls binary, words long, ids array<{doc_type}>"


_NAMES = ["segment", "term", "n", "max_tf", "min_dl", "docs", "tfs", "dls", "words", "ids"]


def impact(tf, dl, mean):
    """What a document's occurrences of a word count, before the word's weight."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))


def _cells(numbers: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Runs of 32-bit numbers that begin at `starts`, as binary cells."""
    offsets = np.append(starts, len(numbers)) * 4
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(numbers, "<i4"))])


def _segment(number: int, ids: pa.Array, listed: pa.Array, vectors: pa.Array | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of a segment: its documents in the order of their ids, then the blocks of each term, those of high impact first. With vectors the row of
    the documents has theirs too, one after the other."""
    order = pc.sort_indices(ids)
    ids, order = ids.take(order), order.to_numpy()
    more = [] if vectors is None else [pa.array([unit_rows(vectors.take(order)).astype("<f8").tobytes()], pa.binary())]
    names = [*_NAMES, "vectors"] if more else _NAMES
    own = np.asarray(pc.fill_null(pc.list_value_length(listed), 0), np.int64)  # lengths as the rows came
    dl, place = own[order], np.empty(len(own), np.int64)
    place[order] = np.arange(len(own))
    coded = pc.list_flatten(listed).dictionary_encode()
    dictionary, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    alphabetic = pc.sort_indices(dictionary).to_numpy()
    rank = np.empty(len(alphabetic), np.int64)
    rank[alphabetic] = np.arange(len(alphabetic))
    met = rank[codes]
    met *= max(1, len(dl))
    met += np.repeat(place, own)
    del listed, coded, codes
    held, tf = np.unique(met, return_counts=True)
    term, doc = np.divmod(held, max(1, len(dl)))
    del met, held
    # A term of one block needs no order in it; of the others, which stand together by term, the documents are put in order of impact.
    many = np.flatnonzero((np.bincount(term) > BLOCK)[term]) if len(term) else term
    order = many[np.lexsort((doc[many], -impact(tf[many], dl[doc[many]], max(1.0, dl.mean() if len(dl) else 1.0)), term[many]))]
    doc[many], tf[many] = doc[order], tf[order]
    nothing = [pa.array([None], t) for t in (pa.int32(), pa.int32(), pa.binary(), pa.binary())]
    head = [pa.array([number], pa.int64()), pa.array([None], pa.string()), pa.array([len(dl)], pa.int32()), *nothing]
    yield pa.record_batch([*head, pa.array([dl.astype("<i4").tobytes()], pa.binary()), pa.array([int(dl.sum())], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *more], names)
    if not len(term):
        return
    first = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    sizes = np.diff(np.append(first, len(term)))
    place = np.arange(len(term)) - np.repeat(first, sizes)
    starts = np.flatnonzero(place % BLOCK == 0)
    n = np.diff(np.append(starts, len(term)))
    blocks = len(starts)
    columns = [
        pa.array(np.full(blocks, number)), dictionary.take(pa.array(alphabetic[term[starts]])).cast(pa.string()), pa.array(n.astype(np.int32)),
        pa.array(np.maximum.reduceat(tf, starts).astype(np.int32)), pa.array(np.minimum.reduceat(dl[doc], starts).astype(np.int32)),
        _cells(doc, starts), _cells(tf, starts), pa.nulls(blocks, pa.binary()), pa.nulls(blocks, pa.int64()), pa.nulls(blocks, pa.list_(ids.type)), *[pa.nulls(blocks, pa.binary()) for _ in more],
    ]
    yield pa.record_batch(columns, names)


def _segments(most: int, step: int):
    """Rows of a task (doc_id, text in lower case) as segments, each ended by the rows with which it gets `most` words."""

    def run(batches):
        number, own, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for lo in range(0, len(batch), step):
                ids, texts, *vectors = batch.slice(lo, step).columns
                listed = _listed(texts)
                own.append([ids, listed, *vectors])
                size += len(listed.values)
                if size >= most:
                    yield from _segment(number, *map(pa.concat_arrays, zip(*own)))
                    number, own, size = number + 1, [], 0
        if own:
            yield from _segment(number, *map(pa.concat_arrays, zip(*own)))

    return run


def segments(docs: DataFrame) -> DataFrame:
    """The index of docs (doc_id, text), in one pass over the texts and without a shuffle: each task makes segments of what it reads.

    Of a segment there is a row without term, with the ids and lengths of its documents, and rows for each term in the order of terms: blocks of BLOCK
    documents with their counts and what bounds their impact. Documents that are added make segments of their own. Null texts have no
    words; each row is a document. Where docs has a column embedding, segments hold the vectors too, for `fused`.
    """
    kind, vectors = dict(docs.dtypes)["doc_id"], [F.col("embedding").cast("array<double>")] if "embedding" in docs.columns else []
    rows = docs.select("doc_id", F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("text"), *vectors)
    return rows.mapInArrow(_segments(SEGMENT, STEP), _schema(kind) + (", vectors binary" if vectors else ""))


def write_index(docs: DataFrame, path: str, mode: str = "error") -> DataFrame:
    """Stores the index of docs (mode append: adds segments to those that are there) and gives the whole index back."""
    spark = docs.sparkSession
    found = segments(docs)
    if mode == "append":
        # Numbers of segments begin with those of tasks; those of another write begin above all that are there.
        last = spark.read.parquet(path).agg(F.max("segment")).first()[0] or 0
        found = found.withColumn("segment", F.col("segment") + (((last >> 32) + 1) << 32))
    found.write.mode(mode).parquet(path)
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


class Postings:
    """The blocks of the terms that are asked for, and the documents of a segment."""

    def __init__(self, rows: pa.Table):
        there = pc.is_valid(rows["term"])
        head = rows.filter(pc.invert(there))
        self.ids, self.size, self.dl = head["ids"].combine_chunks().flatten(), head["n"][0].as_py(), np.frombuffer(head["dls"][0].as_py(), "<i4")
        self.terms: dict[str, list] = {}
        self.decoded: dict[str, tuple] = {}
        blocks = rows.filter(there)
        for term, *cells in zip(blocks["term"].to_pylist(), *(blocks[c].to_pylist() for c in ("max_tf", "min_dl", "docs", "tfs"))):
            self.terms.setdefault(term, []).append(cells)

    def blocks(self, term: str, mean: float) -> tuple:
        """(bounds, ends, documents, impacts) of the blocks of a term, one after the other, those of the highest bounds first, before the term's weight; made once for all queries, which have one mean."""
        if term not in self.decoded:
            own = sorted(((impact(tf, dl, mean), *cells) for tf, dl, *cells in self.terms[term]), key=lambda b: -b[0])
            docs, tfs = (np.frombuffer(b"".join(x), "<i4") for x in list(zip(*own))[1:])
            self.decoded[term] = np.array([b[0] for b in own]), np.cumsum([len(b[1]) // 4 for b in own]), docs, impact(tfs, self.dl[docs], mean)
        return self.decoded[term]

    def best(self, terms: list[str], weights: list[float], mean: float, k: int | None) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, postings read) of a query: all that share a word with it, or the k best, of equal scores those with smaller ids.

        Terms are read by what they can add at most. A block is left where its bound and all that the other terms can add are under the k-th best score
        so far: no document in it can be among the k best, and, as impacts fall, none in the blocks after it.
        """
        own = [(w, max(w, 0.0), *self.blocks(t, mean)) for t, w in zip(terms, weights) if t in self.terms]
        own.sort(key=lambda x: -x[1] * x[2][0])
        total, scores, seen, read, most = sum(m * bounds[0] for _, m, bounds, *_ in own), np.zeros(self.size), np.zeros(self.size, bool), 0, 0.0
        # What is known of a document is a lower bound of its score only if no weight is below zero.
        bounded = k is not None and k <= self.size and all(w >= 0 for w, *_ in own)
        for w, m, bounds, ends, docs, impacts in own:
            left, end, j = total - m * (bounds[0] - bounds), len(bounds), 0  # left: what a document of each block can have at most
            most += m * bounds[0]  # and any document by the terms so far
            while j < end:
                upto = min(max(1, 2 * j), end)
                stop = upto
                if bounded and left[upto - 1] < most:  # after 0, 1, 2, 4, ... blocks, and where it may tell, as it takes a look at all scores
                    floor = np.partition(scores, self.size - k)[self.size - k] - _SLACK
                    stop = j + int(np.count_nonzero(left[j:upto] >= floor))
                lo, hi = ends[j - 1] if j else 0, ends[stop - 1] if stop else 0
                scores[docs[lo:hi]] += w * impacts[lo:hi]
                seen[docs[lo:hi]] = True
                read += int(hi - lo)
                if stop < upto:
                    break
                j = upto
        found = np.flatnonzero(seen)
        scores = np.round(scores[found], 9)
        if k is not None and len(found) > k:
            near = np.flatnonzero(scores >= np.partition(scores, len(found) - k)[len(found) - k])
            top = near[np.argsort(-scores[near], kind="stable")[:k]]
            found, scores = found[top], scores[top]
        return found, scores, read


def _search(mean: float, k: int | None):
    def run(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        names, places, scores = [], [], []
        if len(blocks) and len(asked):
            postings = Postings(blocks)
            for j, (terms, weights) in enumerate(zip(asked["terms"].to_pylist(), asked["weights"].to_pylist())):
                found, score, _ = postings.best(terms, weights, mean, k)
                names.append(np.full(len(found), j))
                places.append(found)
                scores.append(score)
            ids = postings.ids
        else:
            ids = pa.nulls(0, blocks.schema.field("ids").type.value_type)
        joined = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        query = asked["query_id"].combine_chunks().take(pa.array(joined(names, np.int64)))
        return pa.table([query, ids.take(pa.array(joined(places, np.int64))), pa.array(joined(scores, float))], ["query_id", "doc_id", "score"])

    return run


def _meetings(index: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """(rows of the index that are asked for, in groups (segment, g); the queries in the same groups, with their terms and weights; the mean length). A query
    keeps its other columns than text; one without a word of the index has no terms."""
    spark = index.sparkSession
    corpus = index.where("term IS NULL").agg(F.coalesce(F.sum(F.col("n").cast("long")), F.lit(0)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    n, mean = corpus["n"], max(corpus["words"], 1) / max(corpus["n"], 1)
    raw = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    counted = lambda rows: rows.groupBy("term").agg(F.sum(F.col("n").cast("long")).alias("df"))
    asked = staged(queries.select("query_id", F.explode(words(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times")), "asked")
    terms = asked.select("term").distinct()
    size = asked.agg(F.count("*").alias("all"), F.count_distinct("term").alias("terms")).first()
    hint = F.broadcast if size["terms"] <= BROADCAST_TERMS else (lambda x: x)
    blocks = index.where("term IS NOT NULL").join(hint(terms), "term", "left_semi")
    # All terms are counted once: what is asked for stays a row, the others become one, which only their mean weight needs.
    every = counted(index.where("term IS NOT NULL").select("term", "n")).select("term", raw.alias("raw"))
    kept = every.join(hint(terms.select("term", F.lit(True).alias("asked"))), "term", "left").groupBy(F.expr("CASE WHEN asked THEN term END").alias("term"))
    kept = staged(kept.agg(F.sum("raw").alias("raw"), F.count("*").alias("n")), "weights")
    usual = kept.agg(F.sum("raw") / F.sum("n")).first()[0] or 0.0
    weighted = kept.where("term IS NOT NULL").select("term", F.when(F.col("raw") < 0, EPSILON * usual).otherwise(F.col("raw")).alias("idf"))
    groups = -(-size["all"] // QUERY_WORDS) or 1
    each = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    lists = asked.join(hint(weighted), "term").groupBy("query_id").agg(F.collect_list("term").alias("terms"), F.collect_list(F.col("times") * F.col("idf")).alias("weights"))  # a query's words
    others = queries.drop("text")
    if len(others.columns) > 1:
        lists = others.join(lists, "query_id", "left").withColumns({"terms": F.coalesce("terms", F.array().cast("array<string>")), "weights": F.coalesce("weights", F.array().cast("array<double>"))})
    heads = index.where("term IS NULL")
    rows = blocks.select(*index.columns).unionAll(heads.select(*index.columns)).withColumn("g", each)
    met = lists.withColumn("g", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")).crossJoin(F.broadcast(heads.select(F.col("segment").alias("segment"))))  # a row for each segment, under a name of its own
    return rows, met, mean


def _kinds(index: DataFrame, queries: DataFrame) -> tuple[str, str]:
    return dict(queries.dtypes)["query_id"], index.schema["ids"].dataType.elementType.simpleString()


def search(index: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame:
    """query_id, doc_id, score of queries (query_id, text) in an index: of each segment the k best documents of a query, or all that share a word with it.

    Okapi weights; a negative one becomes EPSILON times the mean weight of the vocabulary; words that a query repeats count as often. Of the index only
    the columns that count documents are read whole; of the postings, the blocks of words that are asked for, which meet the queries segment by
    segment. No row is made for a pair of a query and a document that is not handed on. Scores are rounded to nine digits.
    """
    rows, met, mean = _meetings(index.select(*_NAMES), queries.select("query_id", "text"))
    query, doc = _kinds(index, queries)
    return rows.groupBy("segment", "g").cogroup(met.groupBy("segment", "g")).applyInArrow(_search(mean, k), f"query_id {query}, doc_id {doc}, score double")


def matches(index: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, n: how many documents share a word with each query (none: no row), counted segment by segment."""
    rows, met, mean = _meetings(index.select(*_NAMES), queries.select("query_id", "text"))

    def count(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        found = np.zeros(len(asked), np.int64)
        if len(blocks) and len(asked):
            postings = Postings(blocks)
            for j, terms in enumerate(asked["terms"].to_pylist()):
                seen = np.zeros(postings.size, bool)
                for t in terms:
                    for _, _, docs, *_ in postings.terms.get(t, ()):
                        seen[np.frombuffer(docs, "<i4")] = True
                found[j] = seen.sum()
        return pa.table([asked["query_id"].combine_chunks(), pa.array(found)], ["query_id", "n"])

    each = rows.groupBy("segment", "g").cogroup(met.groupBy("segment", "g")).applyInArrow(count, f"query_id {_kinds(index, queries)[0]}, n long")
    return each.groupBy("query_id").agg(F.sum("n").alias("n")).where("n > 0")


_LIMITS = ["_d_min", "_d_max", "_l_min", "_l_max"]


def _both(mean: float, weight: float, k: int | None):
    """Per segment and query the limits of both scores over all documents or, with k, the k best by their weighted sum."""

    def scaled(x: np.ndarray, low: float, high: float) -> np.ndarray:
        return np.ones(len(x)) if high - low < 1e-12 else (x - low) / (high - low + 1e-12)

    def run(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        rows, there = [], len(blocks) and len(asked)
        postings = Postings(blocks) if there else None
        if there and postings.size:
            v = np.frombuffer(pc.drop_null(blocks["vectors"])[0].as_py(), "<f8").reshape(postings.size, -1)
            queries = unit_rows(asked["embedding"].combine_chunks())
            width = min(v.shape[1], queries.shape[1])
            for j, (terms, weights) in enumerate(zip(asked["terms"].to_pylist(), asked["weights"].to_pylist())):
                dense, lexical = np.round(v[:, :width] @ queries[j, :width], 9) + 0.0, np.zeros(postings.size)
                found, scores, _ = postings.best(terms, weights, mean, None)
                lexical[found] = scores
                if k is None:
                    rows.append((j, dense.min(), dense.max(), lexical.min(), lexical.max()))
                    continue
                d_min, d_max, l_min, l_max = (asked[c][j].as_py() for c in _LIMITS)
                score = np.round(weight * scaled(dense, d_min, d_max) + (1 - weight) * scaled(lexical, l_min, l_max), 9)
                top = np.argsort(-score, kind="stable")[:k]
                rows.append((np.full(len(top), j), top, score[top]))
        name = lambda places: asked["query_id"].combine_chunks().take(pa.array(np.array(places, np.int64)))
        if k is None:
            return pa.table([name([r[0] for r in rows]), *[pa.array([float(r[c]) for r in rows], pa.float64()) for c in range(1, 5)]], ["query_id", *_LIMITS])
        who, top, score = (np.concatenate(c) for c in zip(*rows)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        ids = postings.ids if there else pa.nulls(0, blocks.schema.field("ids").type.value_type)
        return pa.table([name(who), ids.take(pa.array(top.astype(np.int64))), pa.array(score)], ["query_id", "doc_id", "score"])

    return run


def fused(index: DataFrame, queries: DataFrame, k: int, weight: float) -> DataFrame:
    """query_id, doc_id, score: of each segment the k best documents of a query (query_id, text, embedding) by the weighted sum of cosine and Okapi scores, each
    scaled to 0 to 1 between its limits over all documents; what shares no word scores 0 before that.

    Both scores of a document are made where its segment is, once for the limits, of which there is a row for each query and segment, and once for the best; no row is
    made for a pair that is not handed on. index: segments of documents with vectors.
    """
    rows, met, mean = _meetings(index, queries.select("query_id", "text", "embedding"))
    query, doc = _kinds(index, queries)
    met = staged(met, "met")
    part = rows.groupBy("segment", "g").cogroup(met.groupBy("segment", "g")).applyInArrow(_both(mean, weight, None), ", ".join([f"query_id {query}", *[f"{c} double" for c in _LIMITS]]))
    limits = staged(part.groupBy("query_id").agg(*[(F.min if c.endswith("min") else F.max)(c).alias(c) for c in _LIMITS]), "limits")
    known = met.join(F.broadcast(limits), "query_id")  # a row for each query
    return rows.groupBy("segment", "g").cogroup(known.groupBy("segment", "g")).applyInArrow(_both(mean, weight, k), f"query_id {query}, doc_id {doc}, score double")


def bm25(queries: DataFrame, docs: DataFrame, k: int | None = None) -> DataFrame:
    """query_id, doc_id, score of documents (doc_id, text) that share a word with a query (query_id, text); others score 0. With k a segment of
    documents gives no more than its k best. The index is staged, so texts are read once."""
    return search(staged(segments(docs), "postings"), queries, k)
