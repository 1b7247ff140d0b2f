"""Readers. All but archives are Spark's own; schemas are given, never inferred."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylode.functions import names
from skylode.operators.audits import ContractError, require, unique

#: The suffixes of images.
IMAGE_SUFFIXES = ("bmp", "jpeg", "jpg", "png", "tif", "tiff", "webp")


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV with a header, every cell a trimmed text; a byte order mark is dropped. ``columns`` must all be there."""
    raw = spark.read.option("header", True).option("inferSchema", False).option("mode", "FAILFAST").csv(path)
    df = raw.select([F.trim(F.col(f"`{c}`")).alias(c.removeprefix("﻿").strip()) for c in raw.columns])
    if missing := [c for c in columns or [] if c not in df.columns]:
        raise ContractError(f"{path} lacks the columns {missing}")
    return df


def read_numbers(spark: SparkSession, path: str, doubles: list[str], longs: list[str] = ()) -> DataFrame:
    """A CSV with the named columns cast: counts may be written as 5 or 5.0."""
    df = read_csv(spark, path, [*doubles, *longs])
    return df.withColumns({c: F.col(f"`{c}`").try_cast("double") for c in doubles} | {c: F.col(f"`{c}`").try_cast("double").cast("long") for c in longs})


def read_source_manifest(spark: SparkSession, path: str) -> DataFrame:
    """image, source, scene_id, cluster_id; sources are official or added, ids not empty, images unique."""
    df = read_csv(spark, path, ["image", "source", "scene_id", "cluster_id"])
    filled = (F.col("scene_id") != "") & (F.col("cluster_id") != "")
    return unique(require(df, source=F.col("source").isin("official", "added"), ids=filled), "image")


def read_split_manifest(spark: SparkSession, path: str, digests: list[str] = ("image_sha256", "label_sha256")) -> DataFrame:
    """A split manifest whose digests are 64 lowercase hex digits."""
    df = read_csv(spark, path, ["split", "image", *digests])
    return require(df, split=F.col("split").isin("train", "val", "test"), **{d: F.col(d).rlike("^[0-9a-f]{64}$") for d in digests})


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; a line that isn't JSON fails the read. A path without files is an empty table."""
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    if not _exists(spark, path):
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).option("mode", "FAILFAST").json(path)


def read_name_list(spark: SparkSession, path: str) -> DataFrame:
    """Rows (name): file names of a list, lower-cased, without blank lines and comments."""
    line = F.trim("value")
    return spark.read.text(path).where((line != "") & ~line.startswith("#")).select(names.folded(names.basename(line)).alias("name")).distinct()


def read_labels(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Rows (image, line_no, row, fine, x, y, w, h) of label files: lines of a class and a normalised box.

    Blank lines and lines of fewer than five fields are skipped. ``strict`` fails on a line without exactly five fields, or out of range.
    A file is one record, so line numbers need no order of a shuffle.
    """
    files = spark.read.text(path, wholetext=True).select(names.stem(F.col("_metadata.file_path")).alias("image"), F.split("value", "\r?\n").alias("lines"))
    rows = files.select("image", F.posexplode("lines").alias("at", "row")).where(F.trim("row") != "")
    parts = F.split(F.trim("row"), r"\s+")
    cell = lambda i, kind: F.try_element_at(parts, F.lit(i + 1)).try_cast(kind)
    out = rows.select("image", (F.col("at") + 1).alias("line_no"), "row", F.size(parts).alias("fields"), cell(0, "double").cast("int").alias("fine"), *[cell(i, "double").alias(n) for i, n in ((1, "x"), (2, "y"), (3, "w"), (4, "h"))])
    if strict:
        from skylode.functions.boxes import valid_label

        out = require(out, fields=F.col("fields") == 5, range=valid_label(*[F.col(c) for c in ("fine", "x", "y", "w", "h")]))
    return out.where("fields >= 5").drop("fields")


def list_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES, digest: bool = False) -> DataFrame:
    """Rows (path, name, length[, sha256]) of files below a folder. Contents are read only for digests, and never leave the executor."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    suffix = F.lower(F.substring_index("path", ".", -1))
    own = found.where(suffix.isin(*suffixes))
    return own.select("path", names.basename(F.col("path")).alias("name"), "length", *([F.sha2("content", 256).alias("sha256")] if digest else []))


def _seekable(path: str):
    """A file of any store that pyarrow knows, opened where the caller runs; bytes are read on demand."""
    from urllib.parse import quote, urlsplit

    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    found, inside = fs.FileSystem.from_uri(quote(path, safe="/:@?=&%")) if urlsplit(path).scheme else (fs.LocalFileSystem(), path)
    return found.open_input_file(inside)


def archive_entries(spark: SparkSession, path: str, digest: bool = False, opened: Callable[[str], object] = _seekable) -> DataFrame:
    """Rows (archive, entry, size, position[, sha256]) of zip archives: their directories, and the contents' digests if asked for.

    An archive is never held whole: ``opened`` gives a seekable file, of which the directory is read, and a digest streams
    its entry in blocks. Entries are dealt to tasks, so one large archive is read by many.
    """
    import hashlib
    import zipfile

    import pyarrow as pa

    plain = pa.schema([("archive", pa.string()), ("entry", pa.string()), ("size", pa.int64()), ("position", pa.int64())])

    def directory(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                with opened(name) as f, zipfile.ZipFile(f) as z:
                    entries = [(i, e) for i, e in enumerate(z.infolist()) if not e.is_dir()]
                yield pa.RecordBatch.from_pydict({"archive": [name] * len(entries), "entry": [e.filename for _, e in entries], "size": [e.file_size for _, e in entries], "position": [i for i, _ in entries]}, schema=plain)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[str | None] = [None] * batch.num_rows
            rows = list(zip(batch.column("archive").to_pylist(), batch.column("position").to_pylist(), range(batch.num_rows), strict=True))
            for name in dict.fromkeys(a for a, _, _ in rows):
                with opened(name) as f, zipfile.ZipFile(f) as z:
                    entries = z.infolist()
                    for _, i, at in (r for r in rows if r[0] == name):
                        with z.open(entries[i]) as content:
                            found[at] = hashlib.file_digest(content, "sha256").hexdigest()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], schema=plain.append(pa.field("sha256", pa.string())))

    kind = "archive string, entry string, size long, position long"
    out = spark.read.format("binaryFile").load(path).select("path").mapInArrow(directory, kind)
    return out.repartition("archive", "position").mapInArrow(digests, kind + ", sha256 string") if digest else out


def image_entries(entries: DataFrame) -> DataFrame:
    """Image entries below images/train, val or test, with ``split`` and the folded name as a unique ``key``."""
    split = names.entry_split(F.col("entry"), "images")
    own = entries.withColumn("split", split).where(F.col("split").isNotNull() & F.lower(F.substring_index("entry", ".", -1)).isin(*IMAGE_SUFFIXES))
    return unique(own.withColumn("key", names.folded(names.basename(F.col("entry")))), "key")


def label_entries(entries: DataFrame, last_wins: bool = False) -> DataFrame:
    """Label entries with ``split`` and folded name ``key``, unique; or with ``last_wins`` of each the entry that its archive holds last."""
    name = names.basename(F.col("entry"))
    own = entries.withColumn("split", names.entry_split(F.col("entry"), "labels")).where(F.col("split").isNotNull() & name.endswith(".txt") & (F.lower(name) != "classes.txt")).withColumn("key", names.folded(name))
    if last_wins:
        return own.groupBy("split", "key").agg(F.max_by("entry", F.struct("archive", "position")).alias("entry"))
    return unique(own, "split", "key")


def quarantine_counts(entries: DataFrame, folder: str = "/curation_quarantine/") -> DataFrame:
    """One row (images, labels, other): how many entries lie in quarantine."""
    suffix = F.lower(F.substring_index("entry", ".", -1))
    image, label = suffix.isin(*IMAGE_SUFFIXES), suffix == "txt"
    return entries.where(F.col("entry").contains(folder)).agg(F.count_if(image).alias("images"), F.count_if(label).alias("labels"), F.count_if(~image & ~label).alias("other"))


def joined_labels(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Images with their label entry by split and stem; an image without one is an error."""
    key = lambda c: F.regexp_replace(c, r"\.[^.]+$", "")
    i = images.withColumn("stem", key(F.col("key")))
    both = i.join(labels.select("split", key(F.col("key")).alias("stem"), F.col("entry").alias("label_entry")), ["split", "stem"], "left")
    return require(both, label=F.col("label_entry").isNotNull())


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target))


def truthy(text: Column) -> Column:
    """Written booleans: true, 1 and yes in any case."""
    return F.coalesce(F.lower(F.trim(text)).isin("true", "1", "yes"), F.lit(False))
