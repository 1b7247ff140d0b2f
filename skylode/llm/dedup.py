"""Exact duplicates by salted combining, with full contents compared at every stage."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylode.llm.common import SALTS, each_salt, keep_rows, salt, salts_of


def normalised(column: str = "text") -> Column:
    """The text with A-Z lower-cased and nothing else changed; null counts as empty."""
    text = F.coalesce(F.col(column), F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def exact_duplicates(docs: DataFrame, salts: int = SALTS, digest=lambda text: F.sha2(text, 256)) -> DataFrame:
    """Rows (doc_id, keep_id, group_size, kept, text_sha256), one for each row of ``docs``.

    Of equal normalised texts the largest doc_id stays. Stage one deduplicates
    inside each task (the map side of the first aggregate), stage two merges
    the salted digest groups, stage three combines the salts' winners. All
    three group by digest and content, so equal digests of different texts
    never merge. A group of any size reaches stage two as one row for each
    task and salt, and stage three as one for each salt.

    Rows find their group again by digest, a second hash and the length (with
    a weak ``digest`` these are what keeps different texts apart), and by salt: a group
    goes once to each salt that its rows have, so the rows of a large one meet it in that many tasks. Null texts
    count as empty ones, and empty texts are equal. Null doc_ids are counted
    in group_size; they stay only where their group has no other id.
    Rows repeated with the same doc_id and text are the same document: each is
    counted, and each is marked as kept if the document is. An empty table gives
    no rows. Other columns are not read.
    """
    rows, winners = _winners(docs, salts, digest)
    identity = ["digest", F.xxhash64("content").alias("second"), F.octet_length("content").alias("octets")]
    groups = winners.select(*identity, F.sha2("content", 256).alias("text_sha256"), "keep_id", "group_size", "salted")
    return (
        rows.select("doc_id", "salt", *identity)
        .join(groups.select("*", each_salt("salted", salts).alias("salt")), ["digest", "second", "octets", "salt"])
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )


def _winners(docs: DataFrame, salts: int, digest) -> tuple[DataFrame, DataFrame]:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("content"))
    rows = rows.withColumn("digest", digest(F.col("content"))).withColumn("salt", salt("doc_id", salts))
    merged = rows.groupBy("salt", "digest", "content").agg(F.max("doc_id").alias("top"), F.count("*").alias("n"))
    return rows, merged.groupBy("digest", "content").agg(F.max("top").alias("keep_id"), F.sum("n").alias("group_size"), salts_of(F.col("salt")).alias("salted"))


def keep_one(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: exactly one of each group of equal normalised texts, that with the largest doc_id.

    Of several rows with that doc_id (repeated rows, or texts that differ in capitals alone) one stays, and of a group without any doc_id too.
    Null texts count as empty. An empty table gives no rows.
    """
    _, winners = _winners(docs, salts, lambda text: F.sha2(text, 256))
    key = lambda digest, octets, doc_id: F.concat_ws(":", digest, octets.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("-")))
    wanted = winners.select(key(F.col("digest"), F.octet_length("content"), F.col("keep_id")).alias("key"))
    return keep_rows(docs, key(F.sha2(normalised(), 256), F.octet_length(normalised()), F.col("doc_id").cast("long")), wanted)


ORACLE = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents),
     g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256 FROM d JOIN g USING (h)
"""
