"""The ten operators over their whole tables, and SQL for what SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylode.llm import ann, bpe, chat, dedup, licenses, packing, pii, quality, secrets, simhash
from skylode.runtime import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.scan_pii(docs, pii.train(docs))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op4_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preference_pairs(*chat.with_other_answers(table(spark, sf_dir, "conversations")))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", simhash.hex64().alias("fingerprint"), "component_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.grade_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_pii, op3_exact_dedup, op4_preference_pairs, op5_nearest, op6_bpe, op7_packing, op8_licenses, op9_simhash, op10_quality)}
ORACLES = {"op3_exact_dedup": dedup.ORACLE, "op4_preference_pairs": chat.ORACLE}
