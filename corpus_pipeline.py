"""A corpus pipeline: each stage reads what the one before has kept, and writes what it keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylode.llm import dedup, packing, quality, secrets, simhash
from skylode.llm.queries import tokenizer
from skylode.runtime import cut, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose probability of the highest grade is too low. Each row is graded by its own text, one without a doc_id too."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.keep_documents(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts keeps one, with the largest doc_id."""
    return dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose fingerprints differ in 2 bits at most (as in op9), or which are alike by 0.8 or more (five words to a shingle), keeps one row, with the smallest doc_id."""
    return simhash.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; n_chars becomes the new length."""
    return secrets.redact_secrets(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences, whose ids are in the result."""
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"), with_ids=True)


STAGES = [("quality", classify), ("exact_dedup", exact), ("near_dedup", near), ("secrets", redact), ("packing", pack)]
#: A fitted classifier, fingerprints and tokens: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each stage's rows are written to the shared folder as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
