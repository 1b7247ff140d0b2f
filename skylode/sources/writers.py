"""Writers. Distributed ones are Spark's; small reports are JSON or Markdown text."""

from __future__ import annotations

import csv
import io
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylode.functions.numbers import canonical, digest
from skylode.operators.audits import ContractError

#: Rows that a report gathers, at most.
REPORT_ROWS = 10_000


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV parts with a header each; nested values must be packed before."""
    df.write.mode(mode).option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_once(df: DataFrame, path: str) -> None:
    """Parquet that refuses to replace what is there. The committer renames at the end, so a reader sees all or nothing."""
    df.write.mode("errorifexists").parquet(path)


def write_cache_inventory(df: DataFrame, path: str) -> str:
    """Canonical JSON lines of an inventory, sorted by key; returns the digest of its sorted lines' digests."""
    line = canonical(**{c: F.col(c) for c in df.columns})
    rows = df.select("key", line.alias("value"))
    rows.repartitionByRange("key").sortWithinPartitions("key").select("value").write.mode("overwrite").text(path)
    leaves = rows.groupBy(F.substring(digest(F.col("value")), 1, 4).alias("b")).agg(digest(F.array_join(F.array_sort(F.collect_list(digest(F.col("value")))), "")).alias("h"))
    return leaves.agg(digest(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), "")).alias("f")).first()["f"]


def report(df: DataFrame, limit: int = REPORT_ROWS) -> list[dict]:
    """The rows of a small result; more than ``limit`` are an error, not cut off."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ContractError(f"a report takes {limit} rows at most")
    return [r.asDict(recursive=True) for r in rows]


def markdown(rows: list[dict], columns: list[str]) -> str:
    """A Markdown table; missing values are shown as -."""
    cell = lambda v: "-" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows)]) + "\n"


def envelope(record: dict) -> dict:
    """A record with the digest of its canonical JSON."""
    import hashlib

    text = json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return {"schema_version": 1, "record": record, "record_sha256": hashlib.sha256(text.encode()).hexdigest()}


def verified(found: dict) -> dict:
    """The record of an envelope whose digest holds."""
    if found.get("schema_version") != 1 or envelope(found["record"])["record_sha256"] != found.get("record_sha256"):
        raise ContractError("the envelope's digest doesn't match its record")
    return found["record"]


def put_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    """One small file in any store: written beside, then renamed in one step, so a reader sees the old text or the new. An existing file is an error unless ``overwrite``."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs = target.getFileSystem(conf)
    if not overwrite and fs.exists(target):
        raise ContractError(f"{path} exists")
    out = fs.create(beside, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE if overwrite else kind.NONE
    try:
        # A rename that finds the target there, or fails otherwise, is an error.
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(beside, target, how)
    except Exception as e:
        fs.delete(beside, False)
        raise ContractError(f"{path} can't be put in place: {e}") from e


def put_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """A small result as one CSV file with a byte order mark and a header, its rows in the order of ``df``; more than :data:`REPORT_ROWS` are an error."""
    out = io.StringIO()
    lines = csv.DictWriter(out, df.columns)
    lines.writeheader()
    lines.writerows(report(df))
    put_text(df.sparkSession, path, "\ufeff" + out.getvalue(), overwrite)


def split_lists(rows: DataFrame) -> DataFrame:
    """Portable lists of train images: rows (list, line) for official, added and mixed images."""
    line = F.concat(F.lit("./images/train/"), F.col("image"))
    train = rows.where("split = 'train'")
    return train.select(F.col("source").alias("list"), line.alias("line")).unionByName(train.select(F.lit("mixed").alias("list"), line.alias("line")))
