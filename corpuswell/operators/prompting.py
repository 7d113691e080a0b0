"""Context and prompts for an answer from retrieved chunks; rendering of transcripts and tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuswell.config import SETTINGS as S
from corpuswell.functions.text import html_escaped, source_line, truncated
from corpuswell.sources.files import Files
from corpuswell.staging import staged

CONTEXT_CHARS = int(max(500, S.context_tokens - S.answer_tokens - S.prompt_tokens) * 3.5)
# The instruction of a prompt and the system message that goes with it.
QUESTION = "Answer this question directly and in detail. Use markdown (**bold** for key terms). Include model names, architectures, and technical details when available. Reference papers by their title when citing.\n\nQuestion: "
SYSTEM = "You are an expert who answers questions directly and authoritatively. Do not start with phrases like 'Based on the provided context' or 'According to the context'—answer as if you know the material. Use markdown for formatting: **bold** for terms and concepts, lists for enumerations. Be specific: include model names, architectures, and methodologies when available. Use only information from the context. When referencing a source, mention the paper title naturally (e.g. 'In the RAG survey by Smith et al.'). Do not use numeric indices like [1] or [2]."
# Fixed answers where a step gives nothing.
NO_PAPERS, NONE_KEPT, NONE_LOADED, NO_CHUNKS = "No papers found for this query.", "No relevant papers after filtering.", "Failed to download papers.", "No relevant chunks found."
OVERFLOW = "maximum context length"


def chunk_budget(n: Column) -> Column:
    """Characters of each of n chunks in a context."""
    return F.greatest(F.lit(2000), F.floor((F.lit(CONTEXT_CHARS) - 80 * n) / n)).cast("long")


def assemble_context(hits: DataFrame, most: int = 10) -> DataFrame:
    """query_id, n_chunks, context: source lines and texts of the first `most` hits, cut to their budget, joined by empty lines.

    hits: query_id, rank, paper_id, title, section, chunk_text.
    """
    top = hits.where(F.col("rank") <= most)
    counted = top.withColumn("n_chunks", F.count("*").over(Window.partitionBy("query_id")))  # `most` rows a query
    piece = F.concat(source_line(F.col("title"), F.col("paper_id").cast("string"), F.col("section")), F.lit("\n"), truncated(F.col("chunk_text"), chunk_budget(F.col("n_chunks"))))
    pieces = counted.select("query_id", "n_chunks", F.struct("rank", piece.alias("piece")).alias("p"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["piece"]), "\n\n")
    return pieces.groupBy("query_id", "n_chunks").agg(truncated(joined, CONTEXT_CHARS, "...(truncated)").alias("context"))


def prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit("Context:\n---\n"), context, F.lit("\n---\n\n"), F.lit(QUESTION), question, F.lit("\n\nAnswer:"))


def fallback_answer(answer: Column) -> Column:
    return F.coalesce(answer, F.lit(NO_CHUNKS))


def failed_answer(error: Column) -> Column:
    return F.concat(F.lit("Error generating response: "), error)


def messages(question: Column, context: Column) -> Column:
    """What goes to a chat model: the system message and the prompt."""
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(SYSTEM).alias("content")), F.struct(F.lit("user").alias("role"), prompt(question, context).alias("content")))


def calls(prompts: DataFrame, generate: Callable[[Column, Column], Column], log: str | None = None) -> DataFrame:
    """query_id, n_chunks, answer, error of prompts (query_id, n_chunks, prompt, context): what a model gives for each, called once for equal prompts.

    generate is a column function of (prompt, context) that gives a string, or a struct (answer, error). What it gives is written before anything reads
    it, so no later step calls again. With a log, a table of (key, answer, error) by the SHA-256 of prompts, calls that it holds are not made, in this run or a later one, and new
    ones are added. Only a task that is lost before it has written repeats its own calls.
    """
    spark = prompts.sparkSession
    keyed = prompts.withColumn("key", F.sha2("prompt", 256))
    asked = keyed.groupBy("key").agg(F.any_value("prompt").alias("prompt"), F.any_value("context").alias("context"))
    known = spark.read.parquet(log) if log and Files(spark, log).names(log) else None
    if known is not None:
        asked = asked.join(known.select("key"), "key", "left_anti")
    given = asked.select("key", generate(F.col("prompt"), F.col("context")).alias("r"))
    if given.schema["r"].dataType.typeName() == "struct":
        given = given.select("key", "r.answer", "r.error")
    else:
        given = given.select("key", F.col("r").alias("answer"), F.lit(None).cast("string").alias("error"))
    made = staged(given, "calls")
    if log:
        made.write.mode("append").parquet(log)
    every = made if known is None else made.unionByName(known.select("key", "answer", "error"))
    return keyed.select("query_id", "n_chunks", "key").join(every, "key").drop("key")


def answers(hits: DataFrame, queries: DataFrame, generate: Callable[[Column, Column], Column], most: int = 10, retries: int = 2, log: str | None = None) -> DataFrame:
    """query_id, answer, n_chunks: the answer that `generate` (see calls) gives from the first `most` hits; queries without hits have no row.

    Queries whose error is that the context is too long are asked again with half as many hits, `retries` times at most and as long as there is more than
    one; other errors are told in the answer. Each round's calls are made once.
    """
    done, left = [], queries.select("query_id", "text")
    for turn in range(retries + 1):
        made = left.join(assemble_context(hits, most), "query_id")
        asked = staged(calls(made.select("query_id", "n_chunks", prompt(F.col("text"), F.col("context")).alias("prompt"), "context"), generate, log), "asked")
        long = F.contains(F.coalesce("error", F.lit("")), F.lit(OVERFLOW))
        last = turn == retries or most == 1
        good = asked if last else asked.where(~long)
        done.append(good.select("query_id", F.when(F.col("error").isNull(), F.col("answer")).otherwise(failed_answer(F.col("error"))).alias("answer"), "n_chunks"))
        again = asked.where(long).select("query_id")
        if last or again.isEmpty():
            break
        left, most = left.join(again, "query_id", "left_semi"), max(1, most // 2)
    return reduce(DataFrame.unionByName, done)


def source_item(title: Column, section: Column, url: Column) -> Column:
    """A source as a link, with its section unless that is the abstract."""
    link = F.concat(F.lit('<a href="'), html_escaped(url), F.lit('" target="_blank" rel="noopener noreferrer" class="source-link">'), html_escaped(title))
    shown = (F.coalesce(section, F.lit("")) != "") & (section != "Abstract")
    return F.concat(link, F.when(shown, F.concat(F.lit(' <span class="source-section">('), html_escaped(section), F.lit(")</span>"))).otherwise(F.lit("")), F.lit("</a>"))


def sources_html(sources: Column) -> Column:
    """A list of sources (title, section, arxiv_url); nothing without any."""
    items = F.array_join(F.transform(sources, lambda x: F.concat(F.lit("<li>"), source_item(x["title"], x["section"], x["arxiv_url"]), F.lit("</li>"))), "")
    block = F.concat(F.lit('<div class="sources-block"><p class="sources-label">Sources</p><ul class="sources-list">'), items, F.lit("</ul></div>"))
    return F.when(F.size(F.coalesce(sources, F.array().cast(SOURCES))) > 0, block).otherwise(F.lit(""))


SOURCES = "array<struct<title: string, section: string, arxiv_url: string>>"
RESULTS = f"array<struct<strategy_label: string, answer: string, sources: {SOURCES}>>"


def _content(text: Column) -> Column:
    return F.concat(F.lit('<p class="content">'), F.replace(html_escaped(F.coalesce(text, F.lit(""))), F.lit("\n"), F.lit("<br>")), F.lit("</p>"))


def message_html(role: Column, text: Column, sources: Column | None = None, results: Column | None = None) -> Column:
    """A message as it stands in a transcript: of an assistant with its sources, or with a block for each of its results."""
    user = role == "user"
    side = F.when(user, F.lit("user")).otherwise(F.lit("assistant"))
    align = F.when(user, F.lit("align-end")).otherwise(F.lit("align-start"))
    body = _content(text)
    if sources is not None:
        body = F.concat(body, F.when(user, F.lit("")).otherwise(sources_html(sources)))
    if results is not None:
        title = lambda r: F.when(F.coalesce(r["strategy_label"], F.lit("")) != "", F.concat(F.lit('<h3 class="strategy-title">'), html_escaped(r["strategy_label"]), F.lit("</h3>"))).otherwise(F.lit(""))
        block = lambda r: F.concat(F.lit('<div class="strategy-block">'), title(r), _content(r["answer"]), sources_html(r["sources"]), F.lit("</div>"))
        body = F.when(~user & (F.size(F.coalesce(results, F.array().cast(RESULTS))) > 0), F.array_join(F.transform(results, block), "")).otherwise(body)
    return F.concat(F.lit('<div class="message '), align, F.lit('"><div class="bubble-'), side, F.lit('">'), body, F.lit("</div></div>"))


def transcripts(messages: DataFrame) -> DataFrame:
    """conv_id, html: the messages of each conversation by turn; sources and results are shown where messages has such columns."""
    extra = [F.col(c) if c in messages.columns else None for c in ("sources", "results")]
    piece = F.struct("turn", message_html(F.col("role"), F.col("text"), *extra).alias("html"))
    return messages.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["html"]), "\n").alias("html"))


def page_html(title: Column, body: Column) -> Column:
    """A transcript as a page of its own."""
    head = F.concat(F.lit('<!DOCTYPE html>\n<html lang="en">\n<head>\n<meta charset="UTF-8">\n<title>'), html_escaped(title), F.lit("</title>\n</head>\n<body>\n"))
    return F.concat(head, F.lit('<div class="header"><h1>'), html_escaped(title), F.lit('</h1></div>\n<div class="chat">\n'), body, F.lit("\n</div>\n</body>\n</html>\n"))


def metric_cell(value: Column, best: Column) -> Column:
    """A LaTeX cell with four digits, bold for the best of its column."""
    text = F.format_string("%.4f", value)
    return F.when(F.abs(value - best) <= 1e-12, F.concat(F.lit("\\textbf{"), text, F.lit("}"))).otherwise(text)
