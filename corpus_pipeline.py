"""The preparation of a corpus: quality rules, near-duplicates, repeated passages, mixing, token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswell.llm import bpe, mixing, near_dedup, quality, suffix_dedup
from corpuswell.llm._shared import staged, whole_text

#: Shares of the tokens that clean, low-quality and toxic documents are to have, and how much an error in each counts.
TARGETS, WEIGHTS = [0.98, 0.02, 0.0], [5.0, 1.0, 1.0]


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each document, and the name of its column: the doc_id, or a stand-in above all doc_ids, from the text, where it is null.

    Of rows that share a doc_id but not their text, those of the least text hash keep the doc_id as number; others have a
    stand-in from both. So rows have one number only if doc_id and text are equal.
    """
    node = "_document_node"
    while node in docs.columns:
        node += "_"
    own, digest = near_dedup.document_node(), F.xxhash64(whole_text())
    several = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(digest).alias("least"), F.max(digest).alias("most")).where("least <> most")
    if several.isEmpty():
        return docs.withColumn(node, own), node
    several = several.select(F.col("doc_id").alias(f"{node}i"), F.col("least").alias(f"{node}h"))
    stand_in = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("doc_id", whole_text()), 2)
    other = F.col(f"{node}h").isNotNull() & (digest != F.col(f"{node}h"))
    joined = docs.join(several, docs["doc_id"] == several[f"{node}i"], "left")
    return joined.withColumn(node, F.when(other, stand_in).otherwise(own)).select(*docs.columns, node), node


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves the documents that fail a base rule or the tightest adaptive fence of their source, language and all rows."""
    return quality.judge_quality(docs).where("kept").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group linked by five-word shingles at 0.8.

    Rows of equal doc_id and different texts are documents of their own; of rows with equal doc_id and text that with the
    least hash of all columns stays; rows without doc_id are told apart by their text.
    """
    keyed, node = _keyed(docs)
    marked = staged(near_dedup.near_duplicates(keyed, 5, (80, 100), key=node).select("node", "kept"), "marked")
    dropped = marked.where("NOT kept").select(F.col("node").alias(node)).distinct()
    rest = keyed.join(dropped, node, "left_anti")
    if not marked.where("kept").groupBy("node").count().where("count > 1").isEmpty():
        rest = rest.groupBy(node).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row")).select("row.*")
    return rest.select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts whole characters of strings of 100 bytes that stand earlier too; texts of which nothing is left go."""
    keyed, node = _keyed(docs)
    rest = tuple(c for c in docs.columns if c not in ("text", "n_chars"))
    cut = suffix_dedup.remove_repeats(keyed, key=node, whole_characters=True, carry=rest)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in rest)
    text = F.decode("kept", "UTF-8")
    carried = F.from_json("carried", schema, suffix_dedup.CARRIED)
    whole = cut.where((F.octet_length("kept") > 0) | (F.size("spans") == 0)).select(carried.alias("c"), text.alias("text"))
    size = [F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")] if "n_chars" in docs.columns else []
    return whole.select("c.*", "text", *size).select(docs.columns)


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the domains of the labels to TARGETS: a document stays if its fitted rate, rounded by a hash of its id, is 1.

    Rates are at most 1, so that the clean tokens there are give the total, and no document comes twice; an error in clean
    tokens counts most, as clean documents are to stay. Rows of equal doc_id and text go or stay together.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labelled = labels.select("doc_id", mixing.label_domains(labels).alias("domain"))
    keyed, node = _keyed(docs)
    mixed = mixing.mix(keyed, labelled, TARGETS, key=node, keep=0, most=1.0, weights=WEIGHTS)
    dropped = mixed.where("copies < 1").select(F.col("doc_id").alias(node)).distinct()
    return keyed.join(dropped, node, "left_anti").select(docs.columns)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of the texts; decoding gave the text back."""
    done = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.octet_length("decoded").cast("long").alias("n_bytes"))


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", mixing_to_targets),
    ("byte-level BPE encoding and decoding", byte_level_bpe),
]

#: SQL expresses neither the sorting of suffixes nor the fit of rates; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
