"""Queries over image tables: balance features, copies, lookups, references, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylode.operators import datasets, matching, similarity, splits
from skylode.plans.derive import GT_SQL, ground_truth
from skylode.plans.detection import _CROWD, MODELS_SQL, ORACLES as DETECTION, false_positive_taxonomy, instance_taxonomy
from skylode.plans.leakage import _hashes
from skylode.runtime import table


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as images, priorities as families, customers as scenes; some have no boxes."""
    i = F.col("o_orderkey") % 20
    split = F.when(i < 14, "train").when(i < 17, "val").otherwise("test")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image"), F.substring("o_orderpriority", 1, 1).alias("family"), F.col("o_custkey").alias("scene"), split.alias("split"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ground_truth(spark, sf_dir).withColumns({"width": F.lit(1280), "height": F.lit(640)})


def balance_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.balance_features(_images(spark, sf_dir), _boxes(spark, sf_dir))


_IMAGES = "im AS (SELECT o_orderkey AS image, o_orderpriority[1:1] AS family, o_custkey AS scene, CASE WHEN o_orderkey % 20 < 14 THEN 'train' WHEN o_orderkey % 20 < 17 THEN 'val' ELSE 'test' END AS split FROM orders)"
_FEATURES = f"""{_CROWD.replace('SELECT a.image', ', cf AS (SELECT a.image', 1)}), {_IMAGES},
fx AS (SELECT image, unnest(['fine:' || CAST(fine AS VARCHAR), 'coarse:' || grp, 'size:' || CASE WHEN (x2 - x1) * (y2 - y1) * 0.25 < 1024 THEN 'small' WHEN (x2 - x1) * (y2 - y1) * 0.25 < 9216 THEN 'medium' ELSE 'large' END,
  CASE WHEN crowded THEN 'crowded_instances' END, CASE WHEN x1 <= 25.6 OR y1 <= 12.8 OR x2 >= 1254.4 OR y2 >= 627.2 THEN 'edge_instances' END]) AS feature FROM gt JOIN cf USING (image, gi)
 UNION ALL SELECT image, unnest(['images', 'family:' || family]) FROM im UNION ALL SELECT image, 'background_images' FROM im WHERE image NOT IN (SELECT image FROM gt))
SELECT image, feature, count(*) AS n FROM fx WHERE feature IS NOT NULL GROUP BY 1, 2"""


def split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.split_report(_images(spark, sf_dir), _boxes(spark, sf_dir))


_REPORT = f"""WITH {GT_SQL}, {_IMAGES}, n AS (SELECT image, count(*) AS boxes FROM gt GROUP BY 1), p AS (SELECT im.*, coalesce(boxes, 0) AS boxes FROM im LEFT JOIN n USING (image)),
c AS (SELECT split, max(crops) AS most_crops, count(*) AS scenes FROM (SELECT split, scene, count(*) AS crops FROM im GROUP BY 1, 2) GROUP BY 1)
SELECT split, count(*) AS images, count(*) FILTER (boxes = 0) AS background, CAST(sum(boxes) AS BIGINT) AS instances, count(DISTINCT family) AS families, any_value(most_crops) AS most_crops, any_value(scenes) AS scenes FROM p JOIN c USING (split) GROUP BY split"""


def dataset_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group-disjoint split of scenes by their images' features."""
    features = datasets.balance_features(_images(spark, sf_dir), _boxes(spark, sf_dir))
    scenes = _images(spark, sf_dir).select("image", F.concat(F.lit("s"), F.col("scene")).alias("group"))
    return splits.grouped_split(features.join(scenes, "image").groupBy("group", "feature").agg(F.sum("n").alias("n")))


def copy_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hashes(spark, sf_dir).select("id", F.sha2((F.col("id") % 700).cast("string"), 256).alias("sha"), F.col("hash").alias("phash"))
    return datasets.copy_components(rows, 1)


_COPIES = """WITH RECURSIVE {h}, q AS (SELECT a.id AS u, b.id AS v FROM h a JOIN h b ON a.id <> b.id AND (a.id % 700 = b.id % 700 OR bit_count(xor(a.hash, b.hash)) <= 1)),
c AS (SELECT id AS node, id AS root FROM h UNION SELECT q.v, c.root FROM c JOIN q ON q.u = c.node WHERE c.root <= q.v) SELECT node AS id, min(root) AS component FROM c GROUP BY node"""


def review_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs of rows have each priority and distance, from classes of equal hash and split."""
    pairs = similarity.hamming_class_pairs(_hashes(spark, sf_dir), 2, "split")
    return pairs.groupBy(datasets.review_priority().alias("priority"), "distance").agg(F.sum("pairs").alias("n"))


_PRIORITY = "WITH {h} SELECT CASE WHEN d = 0 THEN 'p0' WHEN s AND d <= 1 THEN 'p1' ELSE 'rest' END AS priority, CAST(d AS BIGINT) AS distance, count(*) AS n FROM (SELECT bit_count(xor(a.hash, b.hash)) AS d, a.split <> b.split AS s FROM h a JOIN h b ON a.id < b.id) WHERE d <= 2 GROUP BY 1, 2"


def object_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes sought in a manifest whose indices shift after a lost first box."""
    gt = ground_truth(spark, sf_dir)
    manifest = gt.where("gi > 1").withColumn("gi", F.when(F.col("image") % 2 == 0, F.col("gi") - 1).otherwise(F.col("gi")))
    return datasets.object_lookup(gt, manifest).groupBy(F.coalesce("how", F.lit("none")).alias("how")).agg(F.count("*").alias("n"), F.sum("found_gi").alias("indices"))


_LOOKUP = f"""WITH {GT_SQL}, o AS (SELECT image, CASE WHEN image % 2 = 0 THEN gi - 1 ELSE gi END AS ogi, fine, x1 AS a1, y1 AS b1, x2 AS a2, y2 AS b2 FROM gt WHERE gi > 1),
p AS (SELECT g.image, g.gi, ogi, greatest(least(x2, a2) - greatest(x1, a1), 0) * greatest(least(y2, b2) - greatest(y1, b1), 0) AS i, (x2 - x1) * (y2 - y1) AS aa, (a2 - a1) * (b2 - b1) AS ab FROM gt g JOIN o ON g.image = o.image AND g.fine = o.fine),
u AS (SELECT image, gi, ogi, i / greatest(aa + ab - i, 1e-9) AS iou FROM p),
s AS (SELECT image, gi, bool_or(gi = ogi AND iou >= 0.999) AS direct, max(iou) AS iou, arg_max(ogi, {{'i': iou, 'g': -ogi}}) AS best, count(*) AS n FROM u GROUP BY 1, 2),
r AS (SELECT CASE WHEN direct THEN 'index' WHEN iou >= 0.999 THEN 'overlap' WHEN n = 1 THEN 'only' ELSE 'none' END AS how, CASE WHEN direct THEN g.gi WHEN iou >= 0.999 OR n = 1 THEN best END AS f FROM gt g LEFT JOIN s ON g.image = s.image AND g.gi = s.gi)
SELECT how, count(*) AS n, CAST(sum(f) AS BIGINT) AS indices FROM r GROUP BY how"""


def reference_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = instance_taxonomy(spark, sf_dir).where("grp = 'vehicle'").select("image", "gi", "error", F.col("matched_iou").alias("score"), (F.col("image") % 40).alias("product"))
    return spark.createDataFrame(datasets.references(rows, 24), "image long, gi long")


def false_positive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = false_positive_taxonomy(spark, sf_dir)
    level = F.when(F.grouping_id() == 0, "reason").when(F.grouping_id() == 1, "group").otherwise("all")
    return rows.rollup("grp", "reason").agg(level.alias("level"), F.count("*").alias("n")).select("level", F.coalesce("grp", F.lit("")).alias("grp"), F.coalesce("reason", F.lit("")).alias("reason"), "n")


def top_error_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten images with the most errors."""
    rows = instance_taxonomy(spark, sf_dir).where("error != 'detected'")
    return rows.groupBy("image").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "image").limit(10)


def model_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of two models and their differences by group: detections with and without suppression."""
    from skylode.plans.derive import detections

    det, gt = detections(spark, sf_dir), ground_truth(spark, sf_dir)
    a = matching.metrics(det, gt).select("grp", F.col("tp").alias("a_tp"), F.col("fp").alias("a_fp"))
    b = matching.metrics(matching.suppressed(det, 0.5), gt).select("grp", F.col("tp").alias("b_tp"), F.col("fp").alias("b_fp"))
    return a.join(b, "grp").select("grp", "a_tp", "b_tp", (F.col("b_tp") - F.col("a_tp")).alias("tp_change"), (F.col("b_fp") - F.col("a_fp")).alias("fp_change"))


def scene_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _images(spark, sf_dir).select("image", (F.col("image") % 1500).cast("string").alias("name"), F.col("scene"))
    known = images.where("image % 3 != 0")
    out = datasets.scene_of(images.select("image", "name"), known)
    return out.select("image", "scene")


_SCENES = f"""WITH {_IMAGES}, x AS (SELECT image, scene, image % 1500 AS name FROM im), o AS (SELECT name, max(scene) AS s FROM x WHERE image % 3 <> 0 GROUP BY name HAVING count(*) = 1)
SELECT x.image, CASE WHEN x.image % 3 <> 0 THEN x.scene ELSE o.s END AS scene FROM x LEFT JOIN o USING (name)"""

_H = "h AS (SELECT c_custkey AS id, xor(CAST(c_nationkey AS BIGINT) * 1099511627791 % 4611686018427387847, c_custkey * 7919 % 4096) AS hash, CASE WHEN c_custkey % 20 < 14 THEN 'train' WHEN c_custkey % 20 < 17 THEN 'val' ELSE 'test' END AS split FROM customer)"
QUERIES = {
    f.__name__: f
    for f in (balance_features, split_report, dataset_split, copy_components, review_priorities, object_lookup, reference_choice, false_positive_summary, top_error_images, model_differences, scene_fallback)
}
ORACLES = {
    "balance_features": _FEATURES,
    "split_report": _REPORT,
    "copy_components": _COPIES.replace("{h}", _H),
    "review_priorities": _PRIORITY.replace("{h}", _H),
    "object_lookup": _LOOKUP,
    "false_positive_summary": DETECTION["false_positive_taxonomy"].rpartition("SELECT image, pi")[0] + "SELECT CASE GROUPING(grp, reason) WHEN 0 THEN 'reason' WHEN 1 THEN 'group' ELSE 'all' END AS level, coalesce(grp, '') AS grp, coalesce(reason, '') AS reason, count(*) AS n FROM fps GROUP BY ROLLUP (grp, reason)",
    "top_error_images": DETECTION["instance_taxonomy"].rpartition("SELECT * FROM tx")[0] + "SELECT image, count(*) AS n FROM tx WHERE error <> 'detected' GROUP BY image ORDER BY n DESC, image LIMIT 10",
    "model_differences": MODELS_SQL,
    "scene_fallback": _SCENES,
}
