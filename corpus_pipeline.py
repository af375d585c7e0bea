"""A corpus from raw documents to packed windows: five stages, each an operator of the llm subpackage.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before wrote, and works on all of it.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage.llm import lines, mixing, ngram_join, packing, queries, toxicity
from haulage.llm.common import Scratch, partitions

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the noisy-or model scores at 0.3 or more go."""
    model = queries.toxic_model(docs, queries.table(spark, sf_dir, "labels"))
    scored = docs.withColumn("_score", toxicity.toxicity(docs, model))
    return scored.where(F.col("_score") < queries.TOXIC).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages said before are taken out; a document with nothing else to say goes."""
    return lines.line_dedup(docs).select(*COLUMNS)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the least doc_id; every row is a document, repeated ids and null ones too."""
    scratch = Scratch(spark, "near")
    # numbered once, in the order of doc_id; the text's hash deals out rows of one id or none
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    rows = docs.select(*COLUMNS).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    rows = scratch.keep(rows.select(F.monotonically_increasing_id().alias("doc_id"), F.struct(*[c for c in COLUMNS if c != "text"]).alias("_doc"), "text"))
    return ngram_join.one_of_each(rows).select("_doc.*", "text").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source near its target; a document taken k times makes k rows."""
    mixed = mixing.mix(docs, keep=COLUMNS).where("copies > 0")
    return mixed.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 tokens."""
    return packing.pack(docs, queries.tokenizer_path(), queries.WINDOW)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", dedup_near),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Training and tokenizing are beyond SQL: tests hold the operators, and the n-gram stage itself, against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = queries.table(spark, sf_dir, "documents")
    kept = None
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        docs = scratch.keep(out)
        if kept is not None:
            scratch.drop(kept)
        kept = docs
    return docs
