"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, lm, media, oracles, packing, pii, secrets, sharding, simhash, substring, toxicity
from tidemark.storage import read

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_signature_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(read(spark, sf_dir, "documents"))


def op4_karmarkar_karp_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard_documents(read(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op5_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(read(spark, sf_dir, "documents")))


def op6_checked_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.scan(read(spark, sf_dir, "documents"), keep=["doc_id"]))


def op7_log_bilinear_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.learn_and_score(read(spark, sf_dir, "documents"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_debruijn_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(read(spark, sf_dir, "documents"), with_text=False)


def op9_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.learn(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), TOKENIZER)


QUERIES = {
    f.__name__: f
    for f in (
        op1_bm25_decontamination,
        op2_signature_media,
        op3_covering_simhash,
        op4_karmarkar_karp_shards,
        op5_trigram_secrets,
        op6_checked_pii,
        op7_log_bilinear_lm,
        op8_debruijn_substrings,
        op9_ftrl_toxicity,
        op10_best_fit_packing,
    )
}
SQL: dict[str, str] = {"op5_trigram_secrets": oracles.SECRETS, "op6_checked_pii": oracles.PERSONAL, "op8_debruijn_substrings": oracles.REPEATS}
