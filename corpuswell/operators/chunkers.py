"""Chunking strategies as table-generating operators. Each gives doc_id, strategy, position, section, subsection, chunk_text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswell.config import SETTINGS as S
from corpuswell.functions.text import chunk_id, paragraphs, strip, token_count, without_references
from corpuswell.operators.structure import text_without_abstract, with_blocks
from corpuswell.operators.vectors import dot, hash_embedding, hash_likeness

_OUT = ["doc_id", "strategy", "position", "section", "subsection", "chunk_text"]
_PIECES = "array<struct<text: string, tokens: bigint, fresh: boolean>>"
#: Counts the tokens of each paragraph of each block: array<array<string>> to array<array<bigint>>.
Counter = Callable[[Column], Column]


def counts_by_length(paragraphs: Column) -> Column:
    return F.transform(paragraphs, lambda own: F.transform(own, token_count))


def _exploded(docs: DataFrame, strategy: str, chunks: Column) -> DataFrame:
    """A row for each of an array of (section, subsection, chunk_text); positions are places in the array."""
    out = docs.select("doc_id", F.posexplode(chunks).alias("position", "c"))
    return out.select("doc_id", F.lit(strategy).alias("strategy"), "position", "c.section", "c.subsection", "c.chunk_text")


def _chunk(text: Column, section: Column | None = None, subsection: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct((null if section is None else section).alias("section"), (null if subsection is None else subsection).alias("subsection"), text.alias("chunk_text"))


def _blocks(docs: DataFrame, key: str, text: str, skip_abstract: bool, count: Counter) -> DataFrame:
    """doc_id, blocks, paras (of each block) and counts (tokens of each paragraph)."""
    parsed = with_blocks(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))
    if skip_abstract:
        parsed = parsed.withColumn("blocks", F.filter("blocks", lambda b: b["block_type"] != "abstract"))
    paras = parsed.withColumn("paras", F.transform("blocks", lambda b: paragraphs(b["text"])))
    return paras.withColumn("counts", count(F.col("paras")))


def fixed_window(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int | None = None, overlap: int | None = None, windows: Callable[[Column, int, int], Column] | None = None, skip_abstract: bool = True,
) -> DataFrame:
    """Windows of 700 tokens that overlap by 150, over the text without references and abstract. Blank windows take no position.

    Without skip_abstract the text is not parsed: it is prose, in which a line that begins with a number is no heading, and all its lines stay.

    A token is four characters, unless windows (text, window, step in tokens) cuts a text to an array otherwise, as tokens.token_windows does.
    """
    size, step = (S.window_tokens if window is None else window), S.overlap_tokens if overlap is None else overlap
    step = size - step
    body = docs.select(F.col(key).alias("doc_id"), without_references(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    body = text_without_abstract(body) if skip_abstract else body.withColumn("text", strip(F.col("text")))
    if windows is None:
        size, step = size * S.chars_per_token, step * S.chars_per_token
        starts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / step).cast("int"))
        cut = F.when(F.length("text") > 0, F.transform(starts, lambda i: F.substring("text", i * step + 1, F.lit(size))))
    else:
        cut = windows(F.col("text"), size, step)
    pieces = F.filter(F.transform(cut, strip), lambda c: c != "")
    return _exploded(body, "FIXED_WINDOW_OVERLAP", F.transform(pieces, lambda c: _chunk(c)))


def _packed(pieces: Column, carry: bool) -> Column:
    """Folds an array of (text, tokens, fresh) to chunks of at most 900 tokens; each a string.

    A piece above the limit stands alone. fresh starts a new chunk. With carry a chunk that overflows hands on the longest
    run of its last pieces that has 78 tokens at most.
    """
    limit, spare = S.pack_tokens, S.carry_tokens
    total = lambda run: F.aggregate(run, F.lit(0).cast("long"), lambda n, p: n + p["tokens"])
    joined = lambda run: F.array_join(F.transform(run, lambda p: p["text"]), "\n\n")
    none = F.array().cast(_PIECES)

    def kept(run: Column) -> Column:
        if not carry:
            return none
        suffix = lambda k: F.slice(run, F.size(run) - k + 1, k)
        most = F.array_max(F.filter(F.sequence(F.lit(0), F.size(run)), lambda k: total(suffix(k)) <= spare))
        return F.when(F.size(run) > 0, F.slice(run, F.size(run) - most + 1, most)).otherwise(none)

    def step(s: Column, p: Column) -> Column:
        flushed = F.when(F.size(s["run"]) > 0, F.concat(s["done"], F.array(joined(s["run"])))).otherwise(s["done"])
        alone = F.struct(F.concat(flushed, F.array(p["text"])).alias("done"), none.alias("run"))
        over = (F.size(s["run"]) > 0) & ((total(s["run"]) + p["tokens"] > limit) | p["fresh"])
        started = F.struct(flushed.alias("done"), F.concat(kept(s["run"]), F.array(p)).alias("run"))
        grown = F.struct(s["done"].alias("done"), F.concat(s["run"], F.array(p)).alias("run"))
        return F.when(p["tokens"] > limit, alone).when(over, started).otherwise(grown)

    start = F.struct(F.array().cast("array<string>").alias("done"), none.alias("run"))
    return F.aggregate(pieces, start, step, lambda s: F.when(F.size(s["run"]) > 0, F.concat(s["done"], F.array(joined(s["run"])))).otherwise(s["done"]))


def structure_aware(docs: DataFrame, key: str = "doc_id", text: str = "text", skip_abstract: bool = True, count: Counter = counts_by_length) -> DataFrame:
    """Abstracts and conclusions stand alone; the paragraphs of other blocks are packed, with a carried overlap."""
    parsed = _blocks(docs, key, text, skip_abstract, count)
    piece = lambda p, n: F.struct(p.alias("text"), n.alias("tokens"), F.lit(False).alias("fresh"))
    # What a lambda takes by its place would be made again at each place; zipped it is made once.
    pieces = F.zip_with("paras", "counts", lambda p, n: F.zip_with(p, n, piece).cast(_PIECES))
    packed = parsed.withColumn("pieces", pieces).withColumn("packed", F.transform("pieces", lambda p: _packed(p, True)))

    def of(b: Column, p: Column) -> Column:
        own = F.when(b["block_type"].isin("abstract", "conclusion"), F.array(b["text"])).otherwise(p)
        return F.transform(own, lambda c: _chunk(c, b["section"], b["subsection"]))

    return _exploded(packed, "STRUCTURE_AWARE_OVERLAP", F.flatten(F.zip_with("blocks", "packed", of)))


def semantic_paragraphs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = S.semantic_similarity, skip_abstract: bool = True, count: Counter = counts_by_length,
    embed: Callable[[Column], Column] | None = hash_embedding, embed_all: Callable[[Column], Column] | None = None, bare: bool = True,
) -> DataFrame:
    """Consecutive paragraphs stay together while their embeddings are similar, up to 900 tokens.

    With more than five paragraphs, those from the first that names references or bibliography in its first 100
    characters are left off, unless nothing would remain. Only neighbours are compared. embed gives a paragraph's unit vector; a model
    that takes many at a time is embed_all (array<string> to array of vectors). Without either, chunks are structure_aware's, under its name.
    A text that has nothing but abstracts and headings is chunked as it is; without bare it has no chunk, as under the strategies that chunk blocks.
    """
    if embed is None and embed_all is None:
        return structure_aware(docs, key, text, skip_abstract, count)
    body = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    listed = (text_without_abstract(body, bare=bare) if skip_abstract else body).select("doc_id", paragraphs(F.col("text")).alias("paras"))
    named = lambda p, i: F.when(F.rlike(F.lower(F.left(p, F.lit(100))), F.lit("references|bibliography")), i)
    ended = listed.withColumn("end", F.array_min(F.transform("paras", named)))
    cut = F.when((F.size("paras") > 5) & (F.col("end") > 0), F.slice("paras", F.lit(1), F.col("end"))).otherwise(F.col("paras"))
    clean = ended.select("doc_id", cut.alias("paras"))
    if embed is hash_embedding and embed_all is None:
        seen = clean.withColumn("like", hash_likeness(F.col("paras")))
    else:
        seen = clean.withColumn("vectors", embed_all(F.col("paras")) if embed_all else F.transform("paras", lambda p: embed(p)))
        seen = seen.withColumn("like", F.transform("vectors", lambda v, i: F.when(i > 0, dot(v, F.get("vectors", i - 1)))))
    seen = seen.withColumn("counts", F.get(count(F.array("paras")), F.lit(0)))
    fresh = lambda x, i: F.when(i > 0, F.round(x["like"], 9) < similarity).otherwise(F.lit(False))
    piece = lambda x, i: F.struct(x["paras"].alias("text"), x["counts"].alias("tokens"), fresh(x, i).alias("fresh"))
    pieces = F.transform(F.arrays_zip("paras", "counts", "like"), piece).cast(_PIECES)
    packed = seen.withColumn("pieces", pieces).withColumn("packed", _packed(F.col("pieces"), False))
    return _exploded(packed, "SEMANTIC_PARAGRAPH_GROUPING", F.transform("packed", lambda c: _chunk(c)))


def section_level(docs: DataFrame, key: str = "doc_id", text: str = "text", skip_abstract: bool = True, count: Counter = counts_by_length) -> DataFrame:
    """A chunk per block; one above 1500 tokens is halved by number of paragraphs."""
    parsed = _blocks(docs, key, text, skip_abstract, count)
    sizes = parsed.withColumn("sizes", F.get(count(F.array(F.transform("blocks", lambda b: b["text"]))), F.lit(0)))
    joined = lambda a: F.array_join(a, "\n\n")

    def of(x: Column) -> Column:
        b, own = x["blocks"], x["paras"]
        half = F.floor(F.size(own) / 2).cast("int")
        halves = F.array(joined(F.slice(own, F.lit(1), half)), joined(F.slice(own, half + 1, F.size(own))))
        parts = F.when((x["sizes"] > S.section_tokens) & (F.size(own) > 1), halves).otherwise(F.array(b["text"]))
        return F.transform(parts, lambda c: _chunk(c, b["section"], b["subsection"]))

    return _exploded(sizes, "SECTION_LEVEL_CHUNKING", F.flatten(F.transform(F.arrays_zip("blocks", "paras", "sizes"), of)))


CHUNKERS = {
    "STRUCTURE_AWARE_OVERLAP": structure_aware,
    "SEMANTIC_PARAGRAPH_GROUPING": semantic_paragraphs,
    "FIXED_WINDOW_OVERLAP": fixed_window,
    "SECTION_LEVEL_CHUNKING": section_level,
}


def chunk(docs: DataFrame, strategy: str, **options) -> DataFrame:
    """Chunks by the name of a strategy; unknown names raise ValueError."""
    if strategy not in CHUNKERS:
        raise ValueError(f"unknown chunking strategy {strategy!r}")
    return CHUNKERS[strategy](docs, **options)


def index_chunks(docs: DataFrame, strategy: str, abstracts: DataFrame | None = None, **options) -> DataFrame:
    """Chunks as an index holds them: those of 50 characters or more, with ids; then each paper's abstract at position -1.

    Positions are given before short chunks leave, so gaps remain. abstracts: doc_id, abstract; a paper
    without a surviving chunk gets none. options are the chunker's.
    """
    kept = chunk(docs, strategy, **options).where(F.length("chunk_text") >= S.least_chars)
    kept = kept.withColumn("chunk_id", chunk_id(F.col("doc_id").cast("string"), F.col("strategy"), F.col("position")))
    if abstracts is None:
        return kept
    extra = abstracts.where(strip(F.col("abstract")) != "").join(kept.select("doc_id").distinct(), "doc_id", "left_semi").select(
        "doc_id", F.lit(strategy).alias("strategy"), F.lit(-1).alias("position"), F.lit("Abstract").alias("section"), F.lit(None).cast("string").alias("subsection"),
        F.col("abstract").alias("chunk_text"), F.concat_ws("_", F.col("doc_id").cast("string"), F.lit(strategy), F.lit("abstract")).alias("chunk_id"),
    )
    return kept.unionByName(extra)
