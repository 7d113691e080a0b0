"""Scalar text functions over columns; each stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuswell.config import SETTINGS, STRATEGIES

#: The same white space as characters and as a pattern.
_BLANKS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0"
_SPACE = r"[\s\x1C-\x1F\x85\xA0]+"
#: The DNS namespace of name-based UUIDs.
_DNS = "6ba7b8109dad11d180b400c04fd430c8"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(_BLANKS))


def left_strip(c: Column) -> Column:
    """Without white space of any kind at the beginning."""
    return F.ltrim(c, F.lit(_BLANKS))


def words(c: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(c), _SPACE), lambda w: w != "")


def token_count(c: Column) -> Column:
    """Tokens by the length rule: four characters a token."""
    return F.floor(F.length(c) / SETTINGS.chars_per_token).cast("long")


def search_query(topics: Column) -> Column:
    """Comma-separated topics as a search string: trimmed terms, those with a blank in quotes."""
    terms = F.filter(F.transform(F.split(topics, ","), strip), lambda t: t != "")
    return F.array_join(F.transform(terms, lambda t: F.when(F.contains(t, F.lit(" ")), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(t)), " ")


def strategy_label(strategy: Column) -> Column:
    label = F.create_map(*[F.lit(x) for pair in STRATEGIES.items() for x in pair])
    return F.coalesce(F.try_element_at(label, strategy), strategy)


def paragraphs(c: Column) -> Column:
    """Paragraphs between empty lines; a text of over 500 characters that has one at most is split at each line."""
    cut = lambda by: F.filter(F.transform(F.split(c, by), strip), lambda p: p != "")
    return F.when((F.size(cut("\n\n")) <= 1) & (F.length(c) > 500), cut("\n")).otherwise(cut("\n\n"))


def without_references(c: Column) -> Column:
    """Cut at the last "references", then at the last "bibliography", where these stand in the second half. Few texts hold them, so only those are turned round to look for the last."""
    for word in ("references", "bibliography"):
        back = F.instr(F.reverse(F.lower(c)), word[::-1])
        at = F.length(c) - back - len(word) + 1
        c = F.when(F.contains(F.lower(c), F.lit(word)) & (at > F.floor(F.length(c) / 2)), F.left(c, at.cast("int"))).otherwise(c)
    return c


def name_uuid(c: Column) -> Column:
    """Version 5 UUID of a name in the DNS namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(_DNS)), F.encode(c, "UTF-8")))
    variant = F.substr(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def chunk_id(paper: Column, strategy: Column, position: Column) -> Column:
    return F.concat_ws("_", paper, strategy, position.cast("string"))


def archive_id(url: Column) -> Column:
    """The last part of a URL's path without a version."""
    return F.split_part(F.element_at(F.split(url, "/"), -1), F.lit("v"), F.lit(1))


def truncated(c: Column, n: Column | int, suffix: str = "...") -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(F.length(c) > n, F.concat(F.left(c, n.cast("int")), F.lit(suffix))).otherwise(c)


def source_line(title: Column, paper: Column, section: Column) -> Column:
    return F.concat(F.lit("[Source: "), F.coalesce(title, F.lit("Unknown")), F.lit(" (arxiv.org/abs/"), paper, F.lit("), Section: "), F.coalesce(F.nullif(section, F.lit("")), F.lit("-")), F.lit("]"))


def html_escaped(c: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def latex_escaped(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit("\\_"))


def page_text(html: Column) -> Column:
    """Readable text of HTML: without scripts, styles and tags, entities decoded, white space as single blanks."""
    c = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " "))


def committed_topics(value: Column) -> Column:
    """The topics before the last comma of an input, trimmed; none without a comma."""
    at = F.length(value) - F.instr(F.reverse(value), ",")
    head = F.when(F.instr(value, ",") > 0, F.left(value, at.cast("int"))).otherwise(F.lit(""))
    return F.filter(F.transform(F.split(head, ","), strip), lambda t: t != "")


def topics_value(committed: Column, current: Column) -> Column:
    """The input that holds committed topics and the one that is being written."""
    own, listed = strip(current), F.array_join(committed, ", ")
    with_own = F.array_join(F.concat(committed, F.array(own)), ", ")
    return F.when(own != "", with_own).when(F.size(committed) > 0, F.concat(listed, F.lit(","))).otherwise(F.lit(""))


def step_line(step: Column, message: Column, **extra: Column) -> Column:
    """A line of a log: the number of a step, what it is, and figures (name=value) in brackets."""
    figures = F.concat_ws(" - ", *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in extra.items()])
    return F.concat(step.cast("string"), F.lit(". "), message, F.when(figures != "", F.concat(F.lit(" ("), figures, F.lit(")"))).otherwise(F.lit("")))


def payload(chunk: dict[str, Column]) -> Column:
    """A chunk as the index holds it: what is missing is empty, section and subsection null, position 0."""
    null, empty = F.lit(None).cast("string"), F.lit("")
    texts = {c: F.coalesce(chunk.get(c, null), empty) for c in ("chunk_id", "chunk_text", "paper_id", "title", "strategy")}
    fields = texts | {"section": chunk.get("section", null), "subsection": chunk.get("subsection", null), "position": F.coalesce(chunk.get("position", F.lit(0)), F.lit(0)).cast("int")}
    return F.struct(*[c.alias(k) for k, c in fields.items()])


def page_of(page: Column, n: Column) -> Column:
    """A page number within 0 to n - 1."""
    return F.greatest(F.lit(0), F.least(page, n - 1))
