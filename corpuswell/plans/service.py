"""Answering questions over documents, and the evaluation sweep, as plans over many queries at once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuswell.config import SETTINGS as S
from corpuswell.config import STRATEGIES
from corpuswell.functions.text import strategy_label, strip
from corpuswell.operators import chunkers, containment, metrics, prompting, ranking, vectors
from corpuswell.staging import staged


def first_sentence(prompt: Column, context: Column) -> Column:
    """The built-in answer: the first sentence of the first chunk."""
    return F.regexp_extract(F.split_part(context, F.lit("\n"), F.lit(2)), r"^(.*?[.!?])(?:\s|$)", 1)


def validate(queries: DataFrame) -> None:
    """Raises ValueError where query or topics are blank."""
    bad = queries.where((strip(F.coalesce("text", F.lit(""))) == "") | (strip(F.coalesce("topics", F.lit(""))) == "")).take(5)
    if bad:
        raise ValueError(f"query and topics are needed: {[r['query_id'] for r in bad]}")


def _number(docs: DataFrame) -> Column | None:
    """A number of each chunk of docs, in the order of document and position: the bits of doc_id and those of the position side by side. None where ids are no
    whole numbers, are null or repeated, or leave no room. A text has at most two chunks a character."""
    if docs.schema["doc_id"].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        return None
    own = docs.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max(F.length("text")).alias("length")).first()
    bits = (2 * (own["length"] or 0) + 1).bit_length()
    if not own["n"] or own["n"] != own["ids"] or (own["high"] - own["low"]).bit_length() + bits > 62:
        return None
    return F.shiftleft(F.col("doc_id").cast("long") - F.lit(own["low"]).cast("long"), bits) + F.col("position")


def _items(chunks: DataFrame, embed: Callable[[Column], Column], number: Column | None = None) -> DataFrame:
    """chunks with their vectors and vec_id, a number in the order of document and position, which breaks ties as an index does that keeps them so: `number`, or
    else a place after a sort, with which each row has its own number once the result is staged."""
    if number is not None:
        return chunks.withColumn("vec_id", number).withColumn("embedding", embed(F.col("chunk_text")))
    ordered = chunks.repartitionByRange(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id", "position").sortWithinPartitions("doc_id", "position")
    return ordered.withColumn("vec_id", F.monotonically_increasing_id()).withColumn("embedding", embed(F.col("chunk_text")))


def _asked(queries: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    return queries.select(F.col("query_id").alias("vec_id"), embed(F.col("text")).alias("embedding"))


def _kind_scores(queries: DataFrame, items: DataFrame, kind: str, embed: Callable[[Column], Column], papers: DataFrame | None, most: int) -> DataFrame:
    """query_id, vec_id, score of dense or hybrid search: over all items the `most` best of each query and some more, or of all items of each query's own papers."""
    asked = _asked(queries, embed)
    if papers is None:
        if kind == "hybrid":
            texts = items.select(F.col("vec_id").alias("doc_id"), F.col("chunk_text").alias("text"), "embedding")
            return ranking.hybrid_search(queries.select("query_id", "text", embed(F.col("text")).alias("embedding")), texts, most).withColumnRenamed("doc_id", "vec_id")
        return vectors.cosine_scores(asked, items, k=most)
    else:
        own = papers.join(items.select("doc_id", "vec_id", "embedding"), "doc_id").join(asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("_q")), "query_id")
        scores = own.select("query_id", "vec_id", F.round(vectors.cosine(F.col("_q"), F.col("embedding")), 9).alias("score"))
    if kind == "hybrid":
        texts = items.select(F.col("vec_id").alias("doc_id"), F.col("chunk_text").alias("text"))
        scores = ranking.hybrid(scores.withColumnRenamed("vec_id", "doc_id"), ranking.bm25(queries.select("query_id", "text"), texts)).withColumnRenamed("doc_id", "vec_id")
    return scores


def _chosen(scores: DataFrame | None, queries: DataFrame, items: DataFrame, k: int, kind: str, diverse: bool, rerank: bool, asked: DataFrame | None = None) -> DataFrame:
    """query_id, rank, vec_id of the k hits: re-ranked from the pool that belongs to k, or diverse (dense search only), or simply the best. asked: the vectors of
    queries that see all items; what is diverse is then chosen straight from vectors, not from scores."""
    if rerank:
        texts = items.select(F.col("vec_id").alias("doc_id"), F.col("chunk_text").alias("text"))
        hits = ranking.rerank(scores.withColumnRenamed("vec_id", "doc_id"), queries, texts, k).withColumnRenamed("doc_id", "vec_id")
    elif kind == "dense" and diverse:
        hits = ranking.mmr(scores, items, k) if asked is None else ranking.diverse(asked, items, k)
    else:
        hits = ranking.ranked(scores, k)
    return hits.select("query_id", "rank", "vec_id")


def retrieve(
    queries: DataFrame, chunks: DataFrame, k: int = S.top_k, kind: str = "dense", diverse: bool = True, rerank: bool = False, expand: bool = True,
    embed: Callable[[Column], Column] = vectors.hash_embedding, papers: DataFrame | None = None,
) -> DataFrame:
    """query_id, rank and chunk columns. queries: query_id, text; chunks: doc_id, position, section, chunk_text; papers: query_id, doc_id
    where each query is to see its own papers only.

    Re-ranking goes before fusion, fusion before diversity, and neighbours are added to what remains. Chunks are embedded once, and their vectors staged.
    """
    items = staged(_items(chunks, embed), "items")
    asked = None if papers is not None else staged(_asked(queries, embed), "asked")
    straight = asked is not None and kind == "dense" and diverse and not rerank
    scores = None if straight else staged(_kind_scores(queries, items, kind, embed, papers, max(k, S.pool_most)), "scores")
    found = _chosen(scores, queries, items, k, kind, diverse, rerank, asked).join(items.drop("embedding"), "vec_id").drop("vec_id")
    if not expand:
        return found
    return ranking.expand_neighbours(found.select("query_id", "rank", "doc_id", "position"), chunks)


def answered(queries: DataFrame, hits: DataFrame, strategy: str, generate: Callable[[Column, Column], Column], debug: bool = False, log: str | None = None) -> DataFrame:
    """query_id, strategy, strategy_label, answer, sources and, with debug, debug_context, from hits (query_id, rank, doc_id, title, position, section, chunk_text).

    Calls are made once (see prompting.answers); contexts that are too long are halved, errors are told as answers, and a query without hits has the fallback answer."""
    hits = staged(hits.withColumn("paper_id", F.col("doc_id")), "hits")
    given = prompting.answers(hits, queries, generate, log=log).select("query_id", "answer")
    source = F.struct("rank", "doc_id", "title", "section", F.concat(F.lit("https://arxiv.org/abs/"), F.col("doc_id").cast("string")).alias("arxiv_url"))
    sources = ranking.distinct_sources(hits).groupBy("query_id").agg(F.array_sort(F.collect_list(source)).alias("sources"))  # some hits a query
    made = queries.join(given, "query_id", "left").join(sources, "query_id", "left")
    text = prompting.fallback_answer(F.col("answer"))
    columns = [F.lit(strategy).alias("strategy"), strategy_label(F.lit(strategy)).alias("strategy_label"), text.alias("answer"), F.coalesce("sources", F.array().cast(sources.schema["sources"].dataType)).alias("sources")]
    if debug:
        shown = F.struct("rank", F.col("doc_id").cast("string").alias("paper_id"), "title", F.coalesce("section", F.lit("")).alias("section"), "position", "chunk_text")
        used = hits.where("rank <= 10").groupBy("query_id").agg(F.array_sort(F.collect_list(shown)).alias("debug_context"))
        made = made.join(used, "query_id", "left")
        columns.append(F.coalesce("debug_context", F.array().cast(used.schema["debug_context"].dataType)).alias("debug_context"))
    return made.select("query_id", *columns)


def answer(queries: DataFrame, docs: DataFrame, strategies: tuple[str, ...] = tuple(STRATEGIES), generate: Callable[[Column, Column], Column] = first_sentence, debug: bool = False, log: str | None = None, **options) -> DataFrame:
    """Each question (query_id, topics, text) under each strategy, as `answered` gives it.

    docs: doc_id, title, text. Queries without a chunk get the fallback answer and no sources.
    """
    validate(queries)
    parts = []
    for strategy in strategies:
        chunks = chunkers.index_chunks(docs, strategy).select("doc_id", "position", "section", "chunk_text")
        hits = retrieve(queries, chunks, **options).join(docs.select("doc_id", "title"), "doc_id")
        parts.append(answered(queries, hits, strategy, generate, debug, log))
    return reduce(DataFrame.unionByName, parts)


def papers_for(queries: DataFrame, papers: DataFrame, embed: Callable[[Column], Column] = vectors.hash_embedding) -> DataFrame:
    """query_id, doc_id, rank of the papers each question is answered from: of the first papers whose title or abstract has all its
    topics, those whose abstracts are most like the question; ties go to the later paper. papers: doc_id, title, abstract, text."""
    terms = F.array_distinct(F.filter(F.transform(F.split(F.lower("topics"), ","), strip), lambda t: t != ""))
    wanted = queries.select("query_id", F.when(F.size(terms) > 0, terms).otherwise(F.array(F.lit(""))).alias("terms"))
    listed = papers.select("doc_id", F.lower(F.concat_ws(" ", "title", "abstract")).alias("text"))
    kept = staged(containment.first_holding(wanted, listed, S.search_results), "found")
    # Only what was found is embedded.
    abstracts = papers.select("doc_id", F.coalesce("abstract", F.lit("")).alias("_t")).join(kept.select("doc_id"), "doc_id", "left_semi")
    own = kept.join(abstracts.select("doc_id", embed(F.col("_t")).alias("_a")), "doc_id").join(queries.select("query_id", embed(F.col("text")).alias("_q")), "query_id")
    near = own.withColumn("score", F.round(vectors.dot(F.col("_q"), F.col("_a")), 9))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("doc_id")))
    return near.withColumn("rank", rank).where(F.col("rank") <= S.abstracts_kept).select("query_id", "doc_id", "rank")


def answer_topics(queries: DataFrame, papers: DataFrame, strategies: tuple[str, ...] = tuple(STRATEGIES), generate: Callable[[Column, Column], Column] = first_sentence, debug: bool = False, log: str | None = None, chunking: dict[str, dict] | None = None, **options) -> DataFrame:
    """The whole path of a question (query_id, topics, text): search by topics, filter by abstract, chunk, retrieve from its own papers, answer.

    papers: doc_id, title, abstract, text (null where it could not be loaded). Abstracts are chunks at position -1. A question without a
    paper, or with none that could be loaded, gets one row, under the first strategy, that says so. Papers that serve are read whole once and chunked once, whichever questions they serve.
    chunking: options of chunkers by strategy.
    """
    validate(queries)
    chosen = staged(papers_for(queries, papers), "papers")
    own = staged(papers.where("text IS NOT NULL").join(chosen.select("doc_id"), "doc_id", "left_semi"), "loaded")
    loaded = chosen.join(own.select("doc_id"), "doc_id", "left_semi")
    state = queries.select("query_id").join(chosen.groupBy("query_id").agg(F.count("*").alias("_c")), "query_id", "left").join(loaded.groupBy("query_id").agg(F.count("*").alias("_l")), "query_id", "left")
    asked = queries.join(loaded.select("query_id").distinct(), "query_id", "left_semi")
    parts = []
    for strategy in strategies:
        chunks = staged(chunkers.index_chunks(own, strategy, own.select("doc_id", "abstract"), **(chunking or {}).get(strategy, {})).select("doc_id", "position", "section", "chunk_text"), "chunks")
        hits = retrieve(asked, chunks, papers=loaded.select("query_id", "doc_id"), **options).join(own.select("doc_id", "title"), "doc_id")
        parts.append(answered(asked, hits, strategy, generate, debug, log))
    good = reduce(DataFrame.unionByName, parts)
    why = F.when(F.col("_c").isNull(), prompting.NO_PAPERS).when(F.col("_l").isNull(), prompting.NONE_LOADED)
    lost = state.select("query_id", why.alias("answer")).where("answer IS NOT NULL")
    fixed = {"strategy": F.lit("STRUCTURE_AWARE_OVERLAP"), "strategy_label": strategy_label(F.lit("STRUCTURE_AWARE_OVERLAP"))}
    empty = {f.name: F.array().cast(f.dataType) for f in good.schema if f.name in ("sources", "debug_context")}
    return good.unionByName(lost.withColumns(fixed | empty))


def compare_chunkers(
    queries: DataFrame, gold: DataFrame, docs: DataFrame, strategies: tuple[str, ...] = tuple(STRATEGIES), k: int = S.top_k, diverse: bool = True,
    embed: Callable[[Column], Column] = vectors.hash_embedding, passages: DataFrame | None = None, judge: Callable[[Column], Column] | None = None, chunking: dict[str, dict] | None = None,
) -> DataFrame:
    """config_id, query_id, metric, value of dense search without re-ranking over the chunks of each strategy; config_id is the strategy. chunking: options
    of chunkers by strategy. See evaluate."""
    parts, asked, number = [], staged(_asked(queries, embed), "asked"), _number(docs)
    used = ["vec_id", "doc_id", "embedding", *(["chunk_text"] if passages is not None else [])]
    for strategy in strategies:
        chunks = chunkers.index_chunks(docs, strategy, **(chunking or {}).get(strategy, {})).select("doc_id", "position", "section", "chunk_text")
        items = staged(_items(chunks, embed, number).select(*used), "items")
        scores = None if diverse else _kind_scores(queries, items, "dense", embed, None, k)
        hits = _chosen(scores, queries, items, k, "dense", diverse, False, asked).join(items.drop("embedding").withColumnsRenamed({"doc_id": "paper_id", "chunk_text": "text"}), "vec_id")
        similar = metrics.passage_similarity(hits, passages, judge or embed) if passages is not None else None
        found = metrics.retrieval_metrics(metrics.relevance(hits, gold, similar), queries, gold, k)
        parts.append(metrics.long_scores(found.withColumn("config_id", F.lit(strategy)), "config_id", "query_id"))
    return reduce(DataFrame.unionByName, parts)


def evaluate(
    queries: DataFrame, gold: DataFrame, docs: DataFrame, strategy: str, ks: tuple[int, ...] = (3, 5, 10), diverse: bool = True, embed: Callable[[Column], Column] = vectors.hash_embedding,
    passages: DataFrame | None = None, judge: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """config_id, query_id, metric, value of k x (dense, hybrid) x (with and without re-ranking) for a strategy.

    gold: query_id, paper_id; passages: query_id, passage, judged by `judge`, which is another embedder than the one that searches if given. Chunks,
    their embeddings and the scores of each kind are made once; each k is ranked by itself, as pools and diversity depend on it.
    """
    chunks = chunkers.index_chunks(docs, strategy).select("doc_id", "position", "section", "chunk_text")
    items, asked = staged(_items(chunks, embed, _number(docs)), "items"), staged(_asked(queries, embed), "asked")
    parts = []
    for kind in ("dense", "hybrid"):
        scores = staged(_kind_scores(queries, items, kind, embed, None, max(*ks, S.pool_most)), "scores")
        for rerank in (False, True):
            for k in ks:
                hits = _chosen(scores, queries, items, k, kind, diverse, rerank, asked).join(items.select("vec_id", F.col("doc_id").alias("paper_id"), F.col("chunk_text").alias("text")), "vec_id")
                similar = metrics.passage_similarity(hits, passages, judge or embed) if passages is not None else None
                found = metrics.retrieval_metrics(metrics.relevance(hits, gold, similar), queries, gold, k)
                parts.append(metrics.long_scores(found.withColumn("config_id", F.lit(f"{strategy}_{kind}_{'rerank' if rerank else 'plain'}_k{k}")), "config_id", "query_id"))
    return reduce(DataFrame.unionByName, parts)


def compare_models(
    queries: DataFrame, gold: DataFrame, docs: DataFrame, strategy: str, models: dict[str, Callable[[Column], Column]], k: int = 10, kind: str = "dense", diverse: bool = False, rerank: bool = False,
    skip_broken: bool = True, passages: DataFrame | None = None, judge: Callable[[Column], Column] | None = None,
) -> tuple[DataFrame, list[str]]:
    """(config_id, query_id, metric, value of a search under one configuration with each embedder; the models that could not be loaded). config_id is a model's name.

    A model is a function that loads what it needs and gives a column. One that raises then is left out if skip_broken; errors of Spark's jobs, a lost executor or a
    full disk among them, are never taken for a broken model. passages (query_id, passage) are graded by `judge`, one and the same for all models.
    """
    parts, broken, number = [], [], _number(docs)
    chunks = staged(chunkers.index_chunks(docs, strategy).select("doc_id", "position", "section", "chunk_text"), "chunks")
    for name, embed in models.items():
        try:
            embed(F.col("chunk_text"))
        except Exception:
            if not skip_broken:
                raise
            broken.append(name)
            continue
        items = staged(_items(chunks, embed, number), "items")
        scores = staged(_kind_scores(queries, items, kind, embed, None, max(k, S.pool_most)), "scores")
        hits = _chosen(scores, queries, items, k, kind, diverse, rerank, staged(_asked(queries, embed), "asked")).join(items.select("vec_id", F.col("doc_id").alias("paper_id"), F.col("chunk_text").alias("text")), "vec_id")
        similar = metrics.passage_similarity(hits, passages, judge or vectors.hash_embedding) if passages is not None else None
        found = metrics.retrieval_metrics(metrics.relevance(hits, gold, similar), queries, gold, k)
        parts.append(metrics.long_scores(found.withColumn("config_id", F.lit(name)), "config_id", "query_id"))
    if not parts:
        raise ValueError("no model could be loaded")
    return reduce(DataFrame.unionByName, parts), broken
