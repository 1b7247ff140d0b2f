"""Queries over what reviews and training draw from tables: sheets, windows, unions, approvals, epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylode.operators import provenance, runs, training
from skylode.plans.derive import DET_SQL, GT_SQL, MANIFEST_SQL, detections, ground_truth, manifest
from skylode.runtime import table

GROUPS = ("vehicle", "ship", "aircraft")


def contact_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each group the eight images with most of its objects that no group before has taken."""
    counts = ground_truth(spark, sf_dir).groupBy("image", "grp").agg(F.count("*").alias("n"))
    return training.contact_sheet(counts, GROUPS, 8)


def _sheet(groups: tuple[str, ...], most: int) -> str:
    steps = []
    for i, g in enumerate(groups):
        taken = " AND ".join(["true", *(f"image NOT IN (SELECT image FROM s{j})" for j in range(i))])
        steps.append(f"s{i} AS (SELECT grp, image, n, CAST(row_number() OVER (ORDER BY n DESC, image) AS INT) AS place FROM c WHERE grp = '{g}' AND {taken} QUALIFY place <= {most})")
    return f"WITH {GT_SQL}, c AS (SELECT image, grp, count(*) AS n FROM gt GROUP BY 1, 2), {', '.join(steps)} {' UNION ALL '.join(f'SELECT * FROM s{i}' for i in range(len(groups)))}"


def first_in_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.first_in_frame(detections(spark, sf_dir).select("image", "pi", "score", (-F.col("score")).alias("down")), "image", ["down", "pi"], 2).select("image", "pi", "score")


def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square windows about boxes, three times their longer side."""
    w = training.context_window(F.col("box"), 3.0, F.lit(640), F.lit(640))
    return ground_truth(spark, sf_dir).select("image", "gi", w.alias("w")).select("image", "gi", "w.*")


_WINDOWS = f"""WITH {GT_SQL}, h AS (SELECT image, gi, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y, greatest(x2 - x1, y2 - y1) * 1.5 AS r FROM gt)
SELECT image, gi, CAST(greatest(0, floor(x - r)) AS INT) AS x1, CAST(greatest(0, floor(y - r)) AS INT) AS y1, CAST(least(640, ceil(x + r)) AS INT) AS x2, CAST(least(640, ceil(y + r)) AS INT) AS y2 FROM h"""


def merged_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of tiles' detections in whole images, by group."""
    rows = detections(spark, sf_dir).withColumns({"tile_x": F.col("pi") % 2 * 16, "tile_y": F.lit(0), "width": F.lit(640), "height": F.lit(480)})
    return training.merged_tiles(rows, 0.3).select("image", "pi", "grp", "box.x1", "box.y1", "box.x2", "box.y2")


_MERGED = f"""WITH {GT_SQL}, {DET_SQL}, m AS (SELECT image, pi, grp, score, least(greatest(x1 + pi % 2 * 16, 0), 640)::DOUBLE AS x1, least(greatest(y1, 0), 480)::DOUBLE AS y1, least(greatest(x2 + pi % 2 * 16, 0), 640)::DOUBLE AS x2, least(greatest(y2, 0), 480)::DOUBLE AS y2 FROM det),
g AS (SELECT image, grp, list_sort(list({{'down': -score, 'pi': pi, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}})) AS rs FROM m WHERE x2 > x1 AND y2 > y1 GROUP BY 1, 2),
k AS (SELECT image, grp, list_reduce(rs, lambda k, x: CASE WHEN len(list_filter(k, lambda o: greatest(least(o.x2, x.x2) - greatest(o.x1, x.x1), 0) * greatest(least(o.y2, x.y2) - greatest(o.y1, x.y1), 0)
  / greatest((o.x2 - o.x1) * (o.y2 - o.y1) + (x.x2 - x.x1) * (x.y2 - x.y1) - greatest(least(o.x2, x.x2) - greatest(o.x1, x.x1), 0) * greatest(least(o.y2, x.y2) - greatest(o.y1, x.y1), 0), 1e-9) >= 0.3)) > 0 THEN k ELSE list_append(k, x) END, rs[1:0]) AS ks FROM g)
SELECT image, CAST(m.pi AS BIGINT) AS pi, grp, m.x1 AS x1, m.y1 AS y1, m.x2 AS x2, m.y2 AS y2 FROM (SELECT image, grp, unnest(ks) AS m FROM k)"""


def duplicate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label files with repeated lines, and their text without the repeats."""
    row = F.concat("grp", F.when(F.col("pi") % 2 == 0, "  ").otherwise(" "), (F.col("fine") % 2).cast("string"))
    return training.duplicate_report(detections(spark, sf_dir).select("image", F.col("pi").alias("line_no"), row.alias("row")))


_REPEATS = f"""WITH {GT_SQL}, {DET_SQL}, r AS (SELECT image, grp || ' ' || fine % 2 AS row, min(pi) AS line_no, count(*) AS n FROM det GROUP BY 1, 2)
SELECT image, CAST(sum(n) AS BIGINT) AS lines, count(*) AS kept, CAST(sum(n) - count(*) AS BIGINT) AS removed, string_agg(row, chr(10) ORDER BY line_no) || chr(10) AS fixed FROM r GROUP BY image HAVING sum(n) > count(*)"""


def semantic_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometrically strong pairs of neighbouring documents, by content."""
    m = manifest(spark, sf_dir).select(F.col("doc_id").alias("image"), F.col("sha").alias("image_sha256"))
    last = m.agg(F.max("image").alias("last"))
    pairs = m.join(last, F.col("image") < F.col("last")).select(F.col("image").alias("left_image"), (F.col("image") + 1).alias("right_image"), (F.col("image") % 3 == 0).alias("strong"), (F.col("image") % 50).alias("inliers"))
    return training.semantic_unions(pairs, m).select("left_sha", "right_sha", "decision", "evidence.inliers")


_UNIONS = f"WITH {MANIFEST_SQL} SELECT a.sha AS left_sha, b.sha AS right_sha, 'same_scene_union' AS decision, a.doc_id % 50 AS inliers FROM m a JOIN m b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 3 = 0"


def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's candidates, approved as their summary is the reviewed one."""
    m = manifest(spark, sf_dir)
    summary = m.groupBy(F.col("source").alias("id")).agg(F.max("sha").alias("candidate_sha256"), F.count("*").alias("rows"))
    return training.approved(summary, m.groupBy(F.col("source").alias("id")).agg(F.count("sha").alias("rows"), F.max("sha").alias("candidate_sha256")))


def epochs_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs of users' runs whose results hold some value."""
    own = F.when(F.col("event_id") % 4 != 0, F.col("event_type"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), own.alias("a"), F.when(F.col("event_id") % 8 == 0, " ").when(F.col("event_id") % 4 == 0, "x").alias("b"))
    return runs.completed_epochs(rows)


def epochs_to_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that a ledger doesn't hold yet, with the last health record of their epoch."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("epoch"), "event_type")
    health = e.where("epoch % 2 = 0").select("run_id", "epoch", F.explode(F.array(F.lit(1), F.lit(2))).alias("position"), "event_type").withColumn("health", F.concat_ws(":", "event_type", "position"))
    return runs.unrecorded_epochs(e.withColumnRenamed("event_type", "metrics"), health, e.where("epoch % 5 = 0"))


def cache_to_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of an index whose contents a compatible cache lacks, or holds as invalid."""
    m = manifest(spark, sf_dir).select("doc_id", F.col("sha").alias("image_sha256"))
    done = m.where("doc_id % 3 != 0").select("image_sha256", (F.col("doc_id") % 4 != 1).alias("valid"))
    return provenance.resumable(m, done, {"size": 640}, {"size": 640}).select("doc_id")


_FILL = f"WITH {MANIFEST_SQL} SELECT doc_id FROM m WHERE sha NOT IN (SELECT sha FROM m WHERE doc_id % 3 <> 0 AND doc_id % 4 <> 1)"

QUERIES = {f.__name__: f for f in (contact_sheet, first_in_frame, context_windows, merged_tiles, duplicate_report, semantic_unions, approvals, epochs_done, epochs_to_record, cache_to_fill)}
ORACLES = {
    "contact_sheet": _sheet(GROUPS, 8),
    "first_in_frame": f"WITH {GT_SQL}, {DET_SQL} SELECT image, pi, score FROM det QUALIFY row_number() OVER (PARTITION BY image ORDER BY score DESC, pi) <= 2",
    "context_windows": _WINDOWS,
    "merged_tiles": _MERGED,
    "duplicate_report": _REPEATS,
    "semantic_unions": _UNIONS,
    "approvals": f"WITH {MANIFEST_SQL} SELECT source AS id, max(sha) AS candidate_sha256, count(*) AS rows, true AS approved FROM m GROUP BY source",
    "epochs_done": "SELECT user_id AS run_id, count(*) FILTER (event_id % 8 <> 0) AS epochs FROM events GROUP BY user_id",
    "epochs_to_record": "SELECT user_id AS run_id, event_id AS epoch, event_type AS metrics, CASE WHEN event_id % 2 = 0 THEN event_type || ':2' END AS health FROM events WHERE event_id % 5 <> 0",
    "cache_to_fill": _FILL,
}
