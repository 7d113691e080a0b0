"""Structural parser: lines of a text to blocks by section, as a fold over the headings within each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswell.functions.text import left_strip, strip

# Fixed patterns of headings, tried in this order; they match without regard to case.
REFERENCES = r"(?i)^(References?|Bibliography)$"
ABSTRACT = r"(?i)^Abstract$"
SECTION = r"(?i)^(?:\\section\s*\{([^}]+)\}|\d+\s+(.+))$"
SUBSECTION = r"(?i)^(?:\\subsection\s*\{([^}]+)\}|\d+\.\d+\s+(.+))$"
SUBSUBSECTION = r"(?i)^(?:\\subsubsection\s*\{([^}]+)\}|\d+\.\d+\.\d+\s+(.+))$"
CONCLUSION = r"(?i)^Conclusions?$"


#: What a heading begins with after white space, and how long the longest of that is; only such lines are tried against the patterns.
_LIKELY, _BEGINS = r"(?i)^(?:\\|\d|references?|bibliography|abstract)", 12
_MARK = "array<struct<at: int, block_type: string, section: string, subsection: string>>"


def _step(s: Column, m: Column) -> Column:
    """The state after a heading: marks so far, whether an abstract is open, the section, whether the references were met."""
    is_ = lambda *kinds: m["kind"].isin(*kinds)
    null = F.lit(None).cast("string")
    section = F.when(is_("section"), m["name"]).when(is_("abstract"), F.lit("Abstract")).when(~s["inside"], s["section"])
    block_type = F.when(is_("section"), F.when(F.rlike(m["name"], F.lit(CONCLUSION)), "conclusion").otherwise("section")).when(is_("abstract", "references"), m["kind"]).otherwise("subsection")
    mark = F.struct(m["at"].alias("at"), block_type.alias("block_type"), section.alias("section"), F.when(is_("subsection", "subsubsection"), m["name"]).alias("subsection"))
    after = F.struct(
        F.concat(s["marks"], F.array(mark)).alias("marks"), is_("abstract").alias("inside"),
        F.when(is_("section"), m["name"]).when(~is_("abstract") & ~s["inside"], s["section"]).otherwise(null).alias("section"), is_("references").alias("ended"),
    )
    return F.when(s["ended"] | (s["inside"] & is_("abstract", "subsubsection")), s).otherwise(after)


def with_blocks(docs: DataFrame, text: str = "text", blocks: str = "blocks") -> DataFrame:
    """docs with an array of (block_type, section, subsection, text).

    A line of "References" ends what is read. An abstract lasts until a section, subsection or the references; other headings
    inside it are text. Heading lines are not text, other lines stay as they are; blank blocks vanish. A subsection that ends
    an abstract has no section. Rows are parsed each by itself, without a shuffle: the work is a pass over the lines and
    a fold over those that are headings.
    """
    own = docs.columns
    named = lambda line, p: F.trim(F.concat(F.regexp_extract(line, p, 1), F.regexp_extract(line, p, 2)))
    patterns = {"references": REFERENCES, "abstract": ABSTRACT, "section": SECTION, "subsection": SUBSECTION, "subsubsection": SUBSUBSECTION}

    def heading(x: Column) -> Column:
        kind, name = F, F.when(F.lit(False), F.lit(""))
        for k, p in patterns.items():
            kind = kind.when(F.rlike(x["line"], F.lit(p)), k)
            if "(.+)" in p:
                name = name.when(F.rlike(x["line"], F.lit(p)), named(x["line"], p))
        return F.struct(x["at"].alias("at"), kind.alias("kind"), name.alias("name"))

    raw = docs.withColumn("_lines", F.split(F.coalesce(F.col(text), F.lit("")), "\n"))
    likely = F.filter(F.transform("_lines", lambda x, i: F.when(F.rlike(F.left(left_strip(x), F.lit(_BEGINS)), F.lit(_LIKELY)), F.struct(i.alias("at"), strip(x).alias("line")))), lambda x: x.isNotNull())
    heads = raw.withColumn("_heads", F.filter(F.transform(likely, heading), lambda h: h["kind"].isNotNull()))
    first = F.array(F.struct(F.lit(-1).alias("at"), F.lit("body").alias("block_type"), F.lit(None).cast("string").alias("section"), F.lit(None).cast("string").alias("subsection"))).cast(_MARK)
    start = F.struct(first.alias("marks"), F.lit(False).alias("inside"), F.lit(None).cast("string").alias("section"), F.lit(False).alias("ended"))
    marked = heads.withColumn("_marks", F.aggregate("_heads", start, _step, lambda s: s["marks"]))

    def block(m: Column, k: Column) -> Column:
        end = F.coalesce(F.get("_marks", k + 1)["at"], F.size("_lines"))
        lines = F.slice("_lines", m["at"] + 2, end - m["at"] - 1)
        return F.struct(m["block_type"].alias("block_type"), m["section"].alias("section"), m["subsection"].alias("subsection"), strip(F.array_join(lines, "\n")).alias("text"))

    found = F.filter(F.transform("_marks", block), lambda b: (b["text"] != "") & (b["block_type"] != "references"))
    return marked.select(*own, found.alias(blocks))


def parse_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, block_no (from 0, without gaps), block_type, section, subsection, text: a row for each block of with_blocks."""
    parsed = with_blocks(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))
    # Of an inner explode the optimizer makes a filter on the size of the array, for which every text is parsed once more.
    each = parsed.select("doc_id", F.posexplode_outer("blocks").alias("block_no", "b")).where("block_no IS NOT NULL")
    return each.select("doc_id", "block_no", "b.*")


def text_without_abstract(docs: DataFrame, key: str = "doc_id", text: str = "text", bare: bool = True) -> DataFrame:
    """doc_id, text: all blocks but abstracts, joined by empty lines; the text itself, or without bare nothing, where none is left. A row for each row."""
    parsed = with_blocks(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))
    rest = parsed.withColumn("rest", F.filter("blocks", lambda b: b["block_type"] != "abstract"))
    joined = F.array_join(F.transform("rest", lambda b: b["text"]), "\n\n")
    return rest.select("doc_id", F.when(F.size("rest") > 0, joined).otherwise(F.col("text") if bare else F.lit("")).alias("text"))
