"""Documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept. All but the last return the columns of documents. Null texts and null
ids, rows that repeat and empty tables are treated as the operators say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, packing, pii, shingles, toxicity
from tidemark.storage import discard, read, stage

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled rows of ``docs`` and keep what isn't predicted toxic: all, where there are none."""
    model = toxicity.learn(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter("predicted = 0").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the least id.

    Near copies have 0.8 or more of their five-word shingles in common.
    Rows that repeat that id are all of it; a document without an id stays if its group has none.
    """
    return shingles.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts replaced by its kind; n_chars follows the text."""
    masked = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return masked
    count = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return masked.withColumn("n_chars", count).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

#: Learned weights, minimizing searches and tokenizers have no SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, function) in enumerate(STAGES, 1):
        before, docs = docs, function(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = stage(docs, f"pipeline-{name}")
            discard(before)  # nothing reads the stage before any more
    return docs
