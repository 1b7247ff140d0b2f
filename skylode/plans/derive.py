"""Boxes, detections and manifests derived from the provided tables by integer rules, as expressions and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylode.functions.boxes import coarse_group
from skylode.runtime import table

WIDTH, HEIGHT = 640.0, 640.0

_GROUP = "CASE WHEN {0} <= 3 THEN 'ship' WHEN {0} <= 23 THEN 'aircraft' ELSE 'vehicle' END"
#: The same rules for DuckDB.
GT_SQL = f"""
li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS gi FROM lineitem),
gt AS (SELECT l_orderkey AS image, gi, l_partkey % 25 AS fine, {_GROUP.format('l_partkey % 25')} AS grp,
              CAST(l_suppkey * 7 % 560 AS DOUBLE) AS x1, CAST(l_partkey * 13 % 560 AS DOUBLE) AS y1,
              CAST(l_suppkey * 7 % 560 + 8 + CAST(l_quantity AS BIGINT) AS DOUBLE) AS x2, CAST(l_partkey * 13 % 560 + 8 + l_linenumber * 6 AS DOUBLE) AS y2 FROM li)"""
DET_SQL = f"""
d0 AS (SELECT l_orderkey AS image, gi AS pi, (l_partkey % 25 + CASE WHEN l_partkey % 11 = 0 THEN 7 ELSE 0 END) % 25 AS fine,
              CAST(l_suppkey * 7 % 560 + l_partkey % 7 - 3 AS DOUBLE) AS x1, CAST(l_partkey * 13 % 560 + l_suppkey % 5 - 2 AS DOUBLE) AS y1,
              CAST(l_suppkey * 7 % 560 + 8 + CAST(l_quantity AS BIGINT) + l_partkey % 7 - 3 AS DOUBLE) AS x2, CAST(l_partkey * 13 % 560 + 8 + l_linenumber * 6 + l_suppkey % 5 - 2 AS DOUBLE) AS y2,
              (l_partkey * 31 % 97 + 1) / 100.0 AS score FROM li WHERE (l_partkey + l_suppkey) % 10 < 8
       UNION ALL
       SELECT l_orderkey, 1000 + gi, l_partkey % 25, CAST(l_partkey * 13 % 560 AS DOUBLE), CAST(l_suppkey * 7 % 560 AS DOUBLE), CAST(l_partkey * 13 % 560 + 20 AS DOUBLE), CAST(l_suppkey * 7 % 560 + 20 AS DOUBLE),
              (l_suppkey * 17 % 89 + 1) / 100.0 FROM li WHERE (l_partkey * 3 + l_suppkey) % 10 = 0),
det AS (SELECT image, pi, fine, {_GROUP.format('fine')} AS grp, x1, y1, x2, y2, CAST(score AS DOUBLE) AS score FROM d0)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"), F.row_number().over(order).cast("long").alias("gi"))


def _box(x1, y1, x2, y2):
    return F.struct(*[c.cast("double").alias(n) for n, c in (("x1", x1), ("y1", y1), ("x2", x2), ("y2", y2))]).alias("box")


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    x, y = s * 7 % 560, p * 13 % 560
    return _lines(spark, sf_dir).select(F.col("l_orderkey").alias("image"), "gi", (p % 25).alias("fine"), coarse_group(p % 25).alias("grp"), _box(x, y, x + 8 + F.col("q"), y + 8 + F.col("l_linenumber") * 6))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    x, y, dx, dy = s * 7 % 560, p * 13 % 560, p % 7 - 3, s % 5 - 2
    fine = (p % 25 + F.when(p % 11 == 0, 7).otherwise(0)) % 25
    near = F.struct(F.col("gi").alias("pi"), fine.alias("fine"), _box(x + dx, y + dy, x + 8 + F.col("q") + dx, y + 8 + F.col("l_linenumber") * 6 + dy), ((p * 31 % 97 + 1) / 100.0).alias("score"))
    away = F.struct((F.col("gi") + 1000).alias("pi"), (p % 25).alias("fine"), _box(y, x, y + 20, x + 20), ((s * 17 % 89 + 1) / 100.0).alias("score"))
    both = F.array_compact(F.array(F.when((p + s) % 10 < 8, near), F.when((p * 3 + s) % 10 == 0, away)))
    rows = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("image"), F.explode(both).alias("d"))
    return rows.select("image", "d.pi", "d.fine", coarse_group("d.fine").alias("grp"), "d.box", "d.score")


#: A split of documents by source and doc_id, and their content digest.
MANIFEST_SQL = "m AS (SELECT doc_id, source, lang, CASE WHEN doc_id % 20 < 14 THEN 'train' WHEN doc_id % 20 < 17 THEN 'val' ELSE 'test' END AS split, sha256(coalesce(text, '')) AS sha, n_chars FROM documents)"


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id") % 20
    split = F.when(i < 14, "train").when(i < 17, "val").otherwise("test")
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", split.alias("split"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), "n_chars")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id") % 20
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label", F.when(i < 14, "train").when(i < 17, "val").otherwise("test").alias("split"))
