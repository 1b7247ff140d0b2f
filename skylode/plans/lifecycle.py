"""Queries over identities, reports, registries and what training draws from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylode.functions import paths
from skylode.operators import ledger, provenance, runs, training
from skylode.plans.derive import DET_SQL, GT_SQL, MANIFEST_SQL, detections, ground_truth, manifest
from skylode.plans.evidence import _MODELS, _RESULT, _models
from skylode.runtime import table


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a manifest of images and labels."""
    m = manifest(spark, sf_dir)
    name = F.concat(F.lit("Doc"), F.col("doc_id"))
    return m.select("split", F.col("source").alias("source"), F.col("lang").alias("scene_id"), F.lit("").alias("cluster_id"), F.concat(name, F.lit(".bmp")).alias("image"), F.concat(name, F.lit(".txt")).alias("label"), F.col("sha").alias("image_sha256"), F.sha2(name, 256).alias("label_sha256"))


_INVENTORY = f"{MANIFEST_SQL}, i AS (SELECT split, 'Doc' || doc_id || '.bmp' AS image, 'Doc' || doc_id || '.txt' AS label, sha AS image_sha256, sha256('Doc' || doc_id) AS label_sha256 FROM m)"
_ROW = """'{"image":"' || image || '","image_sha256":"' || image_sha256 || '","label":"' || label || '","label_sha256":"' || label_sha256 || '","split":"' || split || '"}'"""


def ordered_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.fingerprints(_inventory(spark, sf_dir), by="split")


def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.cache_inventory(_inventory(spark, sf_dir), "/data/Set").select("key", "relative_image", "relative_label")


def cache_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evenly spaced rows of a cache that a check reads."""
    rows = provenance.cache_inventory(_inventory(spark, sf_dir), "/data/Set")
    return provenance.sampled(rows, "relative_image", 64).select("relative_image")


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as the events of runs."""
    e = table(spark, sf_dir, "events")
    action = F.when(F.col("event_id") % 5 == 0, "init").when(F.col("event_id") % 5 == 1, "resume").when(F.col("event_id") % 5 == 2, "complete").otherwise("note")
    return e.select(F.col("event_id").alias("sequence"), F.col("user_id").alias("run_id"), action.alias("action"), F.col("ts").alias("utc"), F.when(F.col("event_id") % 5 == 0, F.col("event_type")).alias("experiment"), F.when(F.col("event_id") % 5 == 2, F.col("event_type")).alias("summary"))


def registry_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.registry_state(_registry(spark, sf_dir))


_REGISTRY = """SELECT run_id, arg_max(experiment, sequence) FILTER (experiment IS NOT NULL) AS experiment,
CASE WHEN count(*) FILTER (action = 'init') = 0 THEN 'summary alone' WHEN count(*) FILTER (action = 'complete') = 0 THEN 'open' ELSE 'complete' END AS state, count(*) FILTER (action = 'resume') AS resumes,
CAST(epoch_us(arg_max(utc, sequence) FILTER (action = 'complete')) - epoch_us(arg_max(utc, sequence) FILTER (action = 'init')) AS DOUBLE) / 1e6 AS seconds, arg_max(summary, sequence) FILTER (action = 'complete') AS summary
FROM (SELECT event_id AS sequence, user_id AS run_id, CASE event_id % 5 WHEN 0 THEN 'init' WHEN 1 THEN 'resume' WHEN 2 THEN 'complete' ELSE 'note' END AS action, ts AS utc,
 CASE WHEN event_id % 5 = 0 THEN event_type END AS experiment, CASE WHEN event_id % 5 = 2 THEN event_type END AS summary FROM events) GROUP BY run_id"""


def native_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as runs, whose reports name their metrics in one of three ways, one model or two."""
    k, v = F.col("s_suppkey"), F.round(F.abs("s_acctbal") / 10000, 4)
    one = F.when(k % 3 == 0, F.to_json(F.struct(v.alias("metrics/mAP50-95(B)"), F.lit(0.5).alias("P")))).when(k % 3 == 1, F.to_json(F.struct(v.alias("mAP50-95"), F.lit(0.25).alias("recall")))).otherwise(F.to_json(F.struct(F.struct(v.alias("map50_95"))["map50_95"].alias("map50_95"))))
    models = F.concat(F.lit('{"models":{"a":'), one, F.when(k % 7 == 0, F.concat(F.lit(',"b":'), one)).otherwise(F.lit("")), F.lit("}}"))
    reports = table(spark, sf_dir, "supplier").select(k.alias("run_id"), F.when(k % 2 == 0, one).otherwise(models).alias("report"))
    return runs.native_metrics(reports).select("run_id", "model", "problem", "precision", "recall", "map50_95")


_NATIVE = """WITH s AS (SELECT s_suppkey AS k, round(abs(s_acctbal) / 10000, 4) AS v, s_suppkey % 2 = 1 AND s_suppkey % 7 = 0 AS two FROM supplier)
SELECT k AS run_id, CASE WHEN k % 2 = 1 AND NOT two THEN 'a' END AS model, CASE WHEN two THEN 'several models and none is chosen' END AS problem,
CASE WHEN NOT two AND k % 3 = 0 THEN CAST(0.5 AS DOUBLE) END AS precision, CASE WHEN NOT two AND k % 3 = 1 THEN CAST(0.25 AS DOUBLE) END AS recall, CASE WHEN NOT two THEN v END AS map50_95 FROM s"""


def branch_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects by the branch that teaches them, and their mean weight."""
    p = F.col("gi")
    own = ground_truth(spark, sf_dir).withColumn("size", F.when(p % 3 == 0, "small").otherwise("large")).withColumn("error", F.when(p % 4 == 0, "low_confidence").when(p % 4 == 1, "localization"))
    own = own.withColumn("crowded", p % 2 == 0).withColumn("edge", F.lit(False))
    weight = training.object_weight({"ship": 1.5, "vehicle": 2.0}, {"low_confidence": 1.25, "localization": 2.0}, crowded=1.5, small=0.125)
    return own.groupBy("grp", training.branch(F.lit("gp")).alias("route")).agg(F.count("*").alias("n"), F.round(F.avg(weight), 6).alias("weight"))


_ROUTES = f"""WITH {GT_SQL}, o AS (SELECT grp, CASE WHEN gi % 3 = 0 THEN 'small' ELSE 'large' END AS size, CASE gi % 4 WHEN 0 THEN 'low_confidence' WHEN 1 THEN 'localization' END AS error, gi % 2 = 0 AS crowded FROM gt)
SELECT grp, CASE WHEN grp IN ('ship', 'vehicle') OR size = 'small' OR coalesce(error = 'low_confidence', false) THEN 'p' ELSE 'g' END AS route, count(*) AS n,
round(avg(least(4.0, greatest(0.25, CASE grp WHEN 'ship' THEN 1.5 WHEN 'vehicle' THEN 2.0 ELSE 1.0 END * CASE WHEN error IS NULL THEN 1.0 ELSE CASE error WHEN 'low_confidence' THEN 1.25 ELSE 2.0 END * CASE WHEN crowded THEN 1.5 ELSE 1.0 END * CASE WHEN size = 'small' THEN 0.125 ELSE 1.0 END END))::DOUBLE), 6) AS weight
FROM o GROUP BY 1, 2"""


def batch_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest share of a batch's weight, after its weights have the mean one."""
    rows = ground_truth(spark, sf_dir).select("image", F.when(F.col("grp") == "ship", 3.0).otherwise(1.0).alias("weight"))
    return training.with_mean_one(rows, "image").groupBy("image").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("total"), F.round(F.max("weight"), 6).alias("most"))


def tile_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections as those of tiles, in their images' place: how many are left of each image, and how far they reach."""
    moved = detections(spark, sf_dir).withColumn("tile_x", F.col("pi") % 4 * 160).withColumn("tile_y", -(F.col("pi") % 3 * 320)).withColumn("width", F.lit(640)).withColumn("height", F.lit(480))
    out = training.from_tiles(moved)
    return out.groupBy("image").agg(F.count("*").alias("n"), F.round(F.sum(F.col("box.x2") - F.col("box.x1")), 3).alias("widths"), F.max("box.y2").alias("lowest"))


_TILES = f"""WITH {GT_SQL}, {DET_SQL}, m AS (SELECT image, least(greatest(x1 + pi % 4 * 160, 0), 640) AS x1, least(greatest(x2 + pi % 4 * 160, 0), 640) AS x2, least(greatest(y1 - pi % 3 * 320, 0), 480) AS y1, least(greatest(y2 - pi % 3 * 320, 0), 480) AS y2 FROM det)
SELECT image, count(*) AS n, round(sum(x2 - x1), 3) AS widths, max(y2)::DOUBLE AS lowest FROM m WHERE x2 > x1 AND y2 > y1 GROUP BY image"""


def replay_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image"))
    hard = table(spark, sf_dir, "part").where("p_size > 30").select(F.col("p_partkey").alias("image"), (F.col("p_size") % 3 + 1).alias("repeats"))
    return training.replayed(images, hard).groupBy("image").agg(F.count("*").alias("times"))


def merged_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reviews of the same pairs, some the other way round."""
    n = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("position"), F.concat(F.lit("a"), F.col("p_partkey") % 97).alias("left_sha"), F.concat(F.lit("b"), F.col("p_partkey") % 89).alias("right_sha"), F.col("p_brand").alias("decision"))
    turned = n.where("position % 3 = 0").select("position", F.col("right_sha").alias("left_sha"), F.col("left_sha").alias("right_sha"), F.lit("later").alias("decision"))
    return training.merged_reviews(n, turned)


_REVIEWS = """WITH n AS (SELECT 0 AS source, p_partkey AS position, 'a' || p_partkey % 97 AS l, 'b' || p_partkey % 89 AS r, p_brand AS decision FROM part UNION ALL SELECT 1, p_partkey, 'b' || p_partkey % 89, 'a' || p_partkey % 97, 'later' FROM part WHERE p_partkey % 3 = 0)
SELECT l AS left_sha, r AS right_sha, decision FROM n QUALIFY row_number() OVER (PARTITION BY least(l, r), greatest(l, r) ORDER BY source DESC, position DESC) = 1"""


def path_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths made of documents' sources and ids."""
    image = F.concat(F.lit("/d/images/train/"), F.col("source"), F.lit("/X"), F.col("doc_id"), F.lit(".v1.JPG"))
    d = table(spark, sf_dir, "documents").select("doc_id", image.alias("image"), F.sha2(F.col("source"), 256).alias("fp"), F.concat(F.lit(" id"), F.col("doc_id") % 7, F.when(F.col("doc_id") % 7 == 3, "/").otherwise("")).alias("name"))
    return d.select(
        "doc_id",
        paths.label_of(F.col("image"), "/d/images", "/d/labels").alias("label"),
        paths.image_key(F.col("image")).alias("key"),
        paths.below_train(F.col("image")).alias("below"),
        paths.namespace(F.col("name"), F.col("fp")).alias("space"),
    )


_PATHS = """WITH d AS (SELECT doc_id, source, sha256(source) AS fp, 'id' || doc_id % 7 AS name FROM documents)
SELECT doc_id, '/d/labels/train/' || source || '/X' || doc_id || '.v1.txt' AS label, sha1(lower('/d/images/train/' || source || '/X' || doc_id || '.v1.JPG')) AS key, source || '/X' || doc_id || '.v1.JPG' AS below,
CASE WHEN doc_id % 7 <> 3 THEN name || '__' || fp[1:12] END AS space FROM d"""


def gate_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.advancing(_models(spark, sf_dir))


QUERIES = {f.__name__: f for f in (ordered_fingerprints, cache_keys, cache_sample, registry_state, native_reports, branch_routes, batch_weights, tile_projection, replay_rows, merged_reviews, path_keys, gate_decision)}
ORACLES = {
    "ordered_fingerprints": f"WITH {_INVENTORY} SELECT split, sha256('[' || string_agg({_ROW}, ',' ORDER BY lower(image), image) || ']') AS fingerprint, count(*) AS n FROM i GROUP BY split",
    "cache_keys": f"WITH {_INVENTORY} SELECT sha1(lower('/data/Set/images/' || split || '/' || image)) AS key, 'images/' || split || '/' || image AS relative_image, 'labels/' || split || '/' || label AS relative_label FROM i",
    "cache_sample": f"""WITH {_INVENTORY}, r AS (SELECT 'images/' || split || '/' || image AS relative_image, row_number() OVER (ORDER BY 'images/' || split || '/' || image) - 1 AS p, count(*) OVER () AS n FROM i),
c AS (SELECT DISTINCT CAST(round_even(k * (n - 1) / greatest(least(64, n) - 1, 1), 0) AS BIGINT) AS p FROM (SELECT max(n) AS n FROM r), range(64) t(k) WHERE k < least(64, n)) SELECT relative_image FROM r JOIN c USING (p)""",
    "registry_state": _REGISTRY,
    "native_reports": _NATIVE,
    "branch_routes": _ROUTES,
    "batch_weights": f"""WITH {GT_SQL}, w AS (SELECT image, CASE WHEN grp = 'ship' THEN 3.0 ELSE 1.0 END::DOUBLE AS w FROM gt)
SELECT image, count(*) AS n, round(sum(w) / avg(w), 6) AS total, round(max(w) / avg(w), 6) AS most FROM w GROUP BY image""",
    "tile_projection": _TILES,
    "replay_rows": "SELECT p_partkey AS image, CAST(1 + CASE WHEN p_size > 30 THEN p_size % 3 + 1 ELSE 0 END AS BIGINT) AS times FROM part",
    "merged_reviews": _REVIEWS,
    "path_keys": _PATHS,
    "gate_decision": f"""WITH v AS ({_RESULT}), b AS ({_MODELS} SELECT model, mp FROM m)
SELECT 'one advances' AS state, count(*) AS candidates, count(*) FILTER (v.passed) AS passing, arg_min(v.model, {{'m': -b.mp, 'n': v.model}}) FILTER (v.passed) AS best FROM v JOIN b USING (model)""",
}
