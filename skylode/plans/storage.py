"""Queries that write tables with the writers and read them again, and queries over what is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylode.functions import boxes, names
from skylode.operators import audits, datasets, matching
from skylode.plans.derive import DET_SQL, GT_SQL, MANIFEST_SQL, detections, ground_truth, manifest
from skylode.plans.detection import ORACLES as DETECTION, group_operating_points
from skylode.runtime import place, table
from skylode.sources import readers, writers


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("doc_id") % 4 == 0, "added").otherwise("official")
    return manifest(spark, sf_dir).select(F.concat("doc_id", F.lit(".jpg")).alias("image"), source.alias("source"), F.concat_ws(", ", "source", "lang").alias("scene_id"), F.substring("sha", 1, 2).alias("cluster_id"))


def source_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source manifest, written as CSV and read with its contract."""
    path = place(spark)
    writers.write_csv(_sources(spark, sf_dir), path)
    return readers.read_source_manifest(spark, path).groupBy("source", "scene_id").agg(F.count("*").alias("images"), F.countDistinct("cluster_id").alias("clusters"), F.min("image").alias("first_image"))


_SOURCES = f"""WITH {MANIFEST_SQL} SELECT CASE WHEN doc_id % 4 = 0 THEN 'added' ELSE 'official' END AS source, concat_ws(', ', source, lang) AS scene_id, count(*) AS images, count(DISTINCT sha[1:2]) AS clusters, min(doc_id || '.jpg') AS first_image FROM m GROUP BY 1, 2"""


def split_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split manifest with digests, written as CSV and read with its contract."""
    path = place(spark)
    rows = manifest(spark, sf_dir).select("split", F.col("doc_id").cast("string").alias("image"), F.col("sha").alias("image_sha256"), F.sha2(F.col("doc_id").cast("string"), 256).alias("label_sha256"))
    writers.write_csv(rows, path)
    return readers.read_split_manifest(spark, path).groupBy("split").agg(F.count("*").alias("images"), F.countDistinct("image_sha256").alias("contents"), F.max("label_sha256").alias("last_label"))


_SPLITS = f"WITH {MANIFEST_SQL} SELECT split, count(*) AS images, count(DISTINCT sha) AS contents, max(sha256(CAST(doc_id AS VARCHAR))) AS last_label FROM m GROUP BY split"


def csv_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers written as 5 or 5.0, or not as numbers, in a CSV."""
    path = place(spark)
    q = F.col("l_quantity")
    count = F.when(F.col("l_partkey") % 7 == 0, "-").when(F.col("l_partkey") % 2 == 0, q.cast("string")).otherwise(q.cast("long").cast("string"))
    writers.write_csv(table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("line"), count.alias("count"), q.alias("share")), path)
    rows = readers.read_numbers(spark, path, ["share"], ["count"])
    return rows.groupBy("line").agg(F.count("count").alias("counted"), F.sum("count").alias("total"), F.max("share").alias("most"))


_NUMBERS = "SELECT CAST(l_linenumber AS VARCHAR) AS line, count(*) FILTER (l_partkey % 7 <> 0) AS counted, CAST(sum(CAST(l_quantity AS BIGINT)) FILTER (l_partkey % 7 <> 0) AS BIGINT) AS total, max(l_quantity) AS most FROM lineitem GROUP BY 1"


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as JSON lines, nulls kept, and read by schema."""
    path = place(spark)
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("event_type"), "value")
    writers.write_jsonl(rows, path)
    found = readers.read_jsonl(spark, path, "event_id long, user_id long, event_type string, value double")
    return found.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("user_id").alias("users"), F.max("value").alias("most"))


_LINES = "SELECT CASE WHEN event_id % 3 <> 0 THEN event_type END AS event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users, max(value) AS most FROM events GROUP BY 1"


def name_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of paths with comments and blank lines, and its names."""
    path = place(spark)
    own = F.concat(F.lit(" images/"), "source", F.lit("/DOC"), F.col("doc_id"), F.lit(".JPG "))
    line = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("# "), own)).when(F.col("doc_id") % 5 == 1, "").otherwise(own)
    manifest(spark, sf_dir).select(line.alias("value")).write.text(path)
    return readers.read_name_list(spark, path)


_NAMES = "SELECT DISTINCT 'doc' || doc_id || '.jpg' AS name FROM documents WHERE doc_id % 5 > 1"


def cache_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache's inventory as sorted canonical JSON lines, written and read."""
    path = place(spark)
    writers.write_cache_inventory(manifest(spark, sf_dir).select(F.col("doc_id").cast("string").alias("key"), "split", "sha"), path)
    return readers.read_jsonl(spark, path, "key string, split string, sha string")


def written_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest written once; the second attempt is refused and changes nothing."""
    path = place(spark)
    rows = manifest(spark, sf_dir).select("split", "sha")
    writers.write_once(rows, path)
    try:
        writers.write_once(rows.limit(0), path)
        refused = False
    except Exception as e:
        if "PATH_ALREADY_EXISTS" not in str(e):
            raise
        refused = True
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"), F.min("sha").alias("least")).withColumn("refused", F.lit(refused))


def train_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines each portable list of train images has, and the first."""
    rows = _sources(spark, sf_dir).join(manifest(spark, sf_dir).select(F.concat("doc_id", F.lit(".jpg")).alias("image"), "split"), "image")
    return writers.split_lists(rows).groupBy("list").agg(F.count("*").alias("n"), F.min("line").alias("first_line"))


_LISTS = f"""WITH {MANIFEST_SQL}, t AS (SELECT CASE WHEN doc_id % 4 = 0 THEN 'added' ELSE 'official' END AS list, './images/train/' || doc_id || '.jpg' AS line FROM m WHERE split = 'train')
SELECT list, count(*) AS n, min(line) AS first_line FROM (SELECT * FROM t UNION ALL SELECT 'mixed', line FROM t) GROUP BY list"""


def combined_operating_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.combined_points(group_operating_points(spark, sf_dir).select("selection", "tp", "fp", "fn"))
    return found.select("selection", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall")])


_COMBINED = f"""SELECT selection, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(1 - sum(fp) / greatest(sum(fp) + sum(tp), 1), 6) AS precision, round(sum(tp) / greatest(sum(tp) + sum(fn), 1), 6) AS recall
FROM ({DETECTION['group_operating_points']}) GROUP BY selection"""


def cache_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new index of contents with the values that a cache holds for them."""
    m = manifest(spark, sf_dir)
    cache = m.groupBy("sha").agg(F.max("n_chars").alias("value"))
    return datasets.remapped(m.select(F.col("doc_id").alias("position"), "sha"), cache).select("position", "sha", "value")


_REMAP = f"WITH {MANIFEST_SQL}, c AS (SELECT sha, max(n_chars) AS value FROM m GROUP BY sha) SELECT doc_id AS position, sha, value FROM m JOIN c USING (sha)"


def below_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections an image, after the check that none reaches the cap."""
    return datasets.not_truncated(detections(spark, sf_dir), 300).groupBy("image").agg(F.count("*").alias("n"))


def letterboxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes normalised, taken back to corners, and moved into a padded square."""
    w, h = F.lit(1280.0), F.lit(640.0)
    rows = ground_truth(spark, sf_dir).withColumn("c", boxes.centred(F.col("box"), w, h))
    rows = rows.withColumn("back", boxes.corners(*[F.col(f"c.{k}") for k in "xywh"], w, h)).withColumn("l", boxes.letterboxed(F.col("back"), w, h))
    r = lambda c, n: F.round(c, 9).alias(n)
    return rows.select("image", "gi", *[r(f"back.{k}", k) for k in ("x1", "y1", "x2", "y2")], *[r(f"l.{k}", f"l{k}") for k in "xywh"])


_LETTERS = f"WITH {GT_SQL} SELECT image, gi, x1, y1, x2, y2, round((x1 + x2) / 4 / 640, 9) AS lx, round(((y1 + y2) / 4 + 160) / 640, 9) AS ly, round((x2 - x1) / 2 / 640, 9) AS lw, round((y2 - y1) / 2 / 640, 9) AS lh FROM gt"


def first_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label lines without those that repeat an earlier one of their image, blanks aside."""
    rows = detections(spark, sf_dir).select("image", F.col("pi").alias("line_no"), F.concat("grp", F.when(F.col("pi") % 2 == 0, "  ").otherwise(" "), F.floor("score").cast("string")).alias("row"))
    return audits.first_labels(rows).select("image", "line_no")


_FIRST = f"WITH {GT_SQL}, {DET_SQL} SELECT image, min(pi) AS line_no FROM det GROUP BY image, grp, floor(score)"


def metadata_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the places of neighbouring customers' images relate, by what their names tell."""
    i = F.col("c_custkey")
    site = F.concat(F.lit("E"), (i % 170).cast("string"), F.lit(".5_N"), (i % 80).cast("string"), F.lit(".25_20240101_L1A"), i.cast("string"), F.lit("-PAN1.tif"))
    name = F.when(i % 3 == 0, F.concat(F.lit("MAR20_"), i.cast("string"), F.lit(".jpg"))).when(i % 3 == 1, site).otherwise(F.concat(F.lit("x"), i.cast("string")))
    own = table(spark, sf_dir, "customer").select(i.alias("id"), names.source_metadata(name, F.concat(F.lit("s"), (F.floor(i / 4)).cast("string"))).alias("m"))
    steps = own.withColumn("other", F.explode(F.array(F.col("id") + 1, F.col("id") + 3)))
    pairs = steps.alias("a").join(own.alias("b"), F.col("a.other") == F.col("b.id"))
    return pairs.select(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"), names.metadata_relation(F.col("a.m"), F.col("b.m")).alias("r")).select("left_id", "right_id", "r.*")


_RELATIONS = """WITH c AS (SELECT c_custkey AS id, c_custkey % 3 AS kind, (c_custkey % 170) + 0.5 AS lon, (c_custkey % 80) + 0.25 AS lat, CASE WHEN c_custkey % 3 = 1 THEN 'L1A' || c_custkey ELSE 's' || (c_custkey // 4) END AS product FROM customer),
p AS (SELECT a.id AS left_id, b.id AS right_id, a.kind = b.kind AS same, a.kind, a.product = b.product AS same_product, a.id - b.id AS step, sqrt((a.lat - b.lat) * (a.lat - b.lat) + (a.lon - b.lon) * (a.lon - b.lon)) AS far FROM c a JOIN c b ON b.id - a.id IN (1, 3))
SELECT left_id, right_id, same_product, same AND ((kind = 0 AND abs(step) <= 2) OR (kind = 1 AND far <= 0.25)) AS nearby,
 CASE WHEN NOT same THEN 'different_family' WHEN kind = 0 AND abs(step) <= 2 THEN 'sequence_delta=' || abs(step) WHEN kind = 1 AND far <= 0.25 THEN printf('coordinate_distance_deg=%.4f', far) ELSE '' END AS reason FROM p"""

QUERIES = {
    f.__name__: f
    for f in (source_manifest, split_manifest, csv_numbers, json_lines, name_lists, cache_lines, written_once, train_lists, combined_operating_points, cache_remap, below_cap, letterboxes, first_labels, metadata_relations)
}
ORACLES = {
    "source_manifest": _SOURCES,
    "split_manifest": _SPLITS,
    "csv_numbers": _NUMBERS,
    "json_lines": _LINES,
    "name_lists": _NAMES,
    "cache_lines": f"WITH {MANIFEST_SQL} SELECT CAST(doc_id AS VARCHAR) AS key, split, sha FROM m",
    "written_once": f"WITH {MANIFEST_SQL} SELECT split, count(*) AS n, min(sha) AS least, true AS refused FROM m GROUP BY split",
    "train_lists": _LISTS,
    "combined_operating_points": _COMBINED,
    "cache_remap": _REMAP,
    "below_cap": f"WITH {GT_SQL}, {DET_SQL} SELECT image, count(*) AS n FROM det GROUP BY image",
    "letterboxes": _LETTERS,
    "first_labels": _FIRST,
    "metadata_relations": _RELATIONS,
}
