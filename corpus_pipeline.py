"""From raw documents to packed sequences; each stage works on all that the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame with the columns of
documents, but the last, which returns packed pieces.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common, lsh_forest, packing, pii, quality_rules, suffix_dedup

#: SQL can't express hashed n-grams, signatures, suffix buckets or best fit; tests/llm holds run() against brute force.
ORACLE_SQL = None


def _replaced(docs: DataFrame, name: str, text: Column) -> Column:
    """A column of the struct row, with another text, and n_chars to match."""
    if name == "text":
        return text
    return F.length(text).cast("long") if name == "n_chars" else F.col("row").getField(name)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = quality_rules.quality_rules(docs, common.table(spark, sf_dir, "labels"), with_row=True)
    return judged.where("kept").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the least id and, of several texts with it, the least key.

    Classes are told apart by their texts, so that of unlike texts under one id each stays. Of rows alike in id and text
    one stays. Rows without an id can't stand for a class and stay as they are.
    """
    found = lsh_forest.near_duplicates(docs, with_keys=True)
    first = found.where("doc_id is not null").groupBy("component").agg(F.min(F.struct("doc_id", "k1", "k2")).alias("f")).select("f.*")
    text = common.whole_text(docs)
    rows = docs.where("doc_id is not null").select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), *common.text_keys(text))
    rows = rows.join(first, ["doc_id", "k1", "k2"], "left_semi")
    again = Window.partitionBy("doc_id", "k1", "k2").orderBy(F.xxhash64("row"))
    rows = rows.withColumn("n", F.row_number().over(again)).where("n = 1")
    return rows.select("row.*").unionByName(docs.where("doc_id is null"))


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that also start elsewhere; a document may be left with an empty text."""
    rows = suffix_dedup.suffix_dedup(docs, with_row=True).select("row", suffix_dedup.whole_characters(F.col("kept")).alias("left"))
    return rows.select(*(_replaced(docs, c, F.col("left")).alias(c) for c in docs.columns))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data, plain or disguised, replaced by the name of its kind."""
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), pii.redacted(docs["text"]).alias("clean"))
    return rows.select(*(_replaced(docs, c, F.col("clean")).alias(c) for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, packed into sequences."""
    return packing.pack(docs, common.tokenizer_path())


STAGES = [
    ("quality_rules", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_strings),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next one reads it; what a stage read and wrote is then deleted."""
    docs, last = common.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = common.staged(spark, functools.partial(stage, spark, docs, sf_dir))
        if last is not None:
            common.forget(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
