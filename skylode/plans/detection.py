"""Queries over detections: metrics, thresholds, error classes, suppression, mining."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylode.functions import boxes
from skylode.functions.numbers import grid
from skylode.operators import audits, matching, mining
from skylode.plans.derive import DET_SQL, GT_SQL, HEIGHT, WIDTH, detections, ground_truth

CONFIDENCES = grid(0.1, 0.9, 0.1)
_LIMIT = "CASE WHEN {0} = 'vehicle' THEN 0.35 ELSE 0.5 END"
_IOU = "(w * h / greatest((x2 - x1) * (y2 - y1) + (gx2 - gx1) * (gy2 - gy1) - w * h, 1e-9))"


def _r(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


RATES = ("false_alarm_rate", "precision", "recall", "f1")
RATES_SQL = """round(fp / greatest(fp + tp, 1), 6) AS false_alarm_rate, round(1 - fp / greatest(fp + tp, 1), 6) AS precision, round(tp / greatest(tp + fn, 1), 6) AS recall,
round(2 * (1 - fp / greatest(fp + tp, 1)) * (tp / greatest(tp + fn, 1)) / greatest(1 - fp / greatest(fp + tp, 1) + tp / greatest(tp + fn, 1), 1e-12), 6) AS f1"""


def pairs_sql(det: str, name: str, same: bool = True, gt: str = "gt") -> str:
    """Overlapping pairs of detections ``det`` and boxes ``gt``."""
    return f"""
{name}0 AS (SELECT d.image, d.grp, d.pi, d.score, g.gi, g.grp AS gt_grp, d.x1, d.y1, d.x2, d.y2, g.x1 AS gx1, g.y1 AS gy1, g.x2 AS gx2, g.y2 AS gy2,
   greatest(least(d.x2, g.x2) - greatest(d.x1, g.x1), 0) AS w, greatest(least(d.y2, g.y2) - greatest(d.y1, g.y1), 0) AS h
   FROM {det} d JOIN {gt} g ON d.image = g.image {'AND d.grp = g.grp' if same else ''}
   WHERE d.x1 < g.x2 AND g.x1 < d.x2 AND d.y1 < g.y2 AND g.y1 < d.y2),
{name} AS (SELECT image, grp, pi, score, gi, gt_grp, {_IOU} AS iou FROM {name}0)"""


def match_sql(pairs: str, name: str, floor: float | None = None) -> str:
    """Greedy one-to-one matches of overlapping ``pairs`` as a recursion over ranks of detections."""
    limit = str(floor) if floor is not None else _LIMIT.format("gt_grp")
    return f"""
{name}1 AS (SELECT image, grp, pi, max(score) AS score, list_sort(list({{'far': -iou, 'gi': gi, 'lim': {limit}}})) AS cand FROM {pairs} GROUP BY image, grp, pi),
{name}2 AS (SELECT image, grp, list_sort(list({{'down': -score, 'pi': pi, 'cand': cand}})) AS rs FROM {name}1 GROUP BY image, grp),
{name}3 AS (SELECT image, grp, list_reduce(rs, lambda acc, x: list_concat(acc, list_transform(list_filter(list_filter(x.cand, lambda c: NOT list_contains(list_transform(acc, lambda t: t.gi), c.gi))[1:1],
   lambda c: -c.far >= c.lim), lambda c: {{'pi': CAST(x.pi AS BIGINT), 'gi': CAST(c.gi AS BIGINT), 'iou': CAST(-c.far AS DOUBLE), 'score': CAST(-x.down AS DOUBLE)}})),
   CAST([] AS STRUCT(pi BIGINT, gi BIGINT, iou DOUBLE, score DOUBLE)[])) AS ms FROM {name}2),
{name} AS (SELECT image, grp, u.m.pi AS pi, u.m.gi AS gi, u.m.iou AS iou, u.m.score AS score FROM (SELECT image, grp, unnest(ms) AS m FROM {name}3) u)"""

_BASE = f"WITH {GT_SQL}, {DET_SQL}"


def counts_sql(det: str, matches: str, name: str) -> str:
    """Counts by group and overall of detections ``det`` and their matches."""
    return f"""
{name}0 AS (SELECT coalesce(d.grp, g.grp) AS grp, coalesce(m.tp, 0) AS tp, coalesce(d.n, 0) - coalesce(m.tp, 0) AS fp, coalesce(g.n, 0) - coalesce(m.tp, 0) AS fn
   FROM (SELECT grp, count(*) AS n FROM {det} GROUP BY grp) d FULL JOIN (SELECT grp, count(*) AS n FROM gt GROUP BY grp) g ON d.grp = g.grp LEFT JOIN (SELECT grp, count(*) AS tp FROM {matches} GROUP BY grp) m ON m.grp = coalesce(d.grp, g.grp)),
{name} AS (SELECT grp, tp, fp, fn FROM {name}0 UNION ALL SELECT 'overall', CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT) FROM {name}0)"""


_COUNTS = counts_sql("det", "mt", "tot")


def match_metrics_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.metrics(detections(spark, sf_dir), ground_truth(spark, sf_dir)).select("grp", "tp", "fp", "fn", *_r(*RATES))


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.threshold_matrix(detections(spark, sf_dir), ground_truth(spark, sf_dir), CONFIDENCES)


def threshold_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix(spark, sf_dir).select("confidence", "grp", "tp", "fp", "fn", *_r(*RATES))


_MATRIX = f"""
cs AS (SELECT unnest([{', '.join(map(str, CONFIDENCES))}]::DOUBLE[]) AS confidence),
gs AS (SELECT DISTINCT grp FROM gt UNION SELECT DISTINCT grp FROM det),
cell AS (SELECT confidence, grp, (SELECT count(*) FROM mt WHERE mt.grp = gs.grp AND mt.score >= confidence) AS tp, (SELECT count(*) FROM det WHERE det.grp = gs.grp AND det.score >= confidence) AS d, (SELECT count(*) FROM gt WHERE gt.grp = gs.grp) AS g FROM cs, gs),
allc AS (SELECT confidence, grp, tp, d, g FROM cell UNION ALL SELECT confidence, 'overall', sum(tp), sum(d), sum(g) FROM cell GROUP BY confidence),
mx AS (SELECT confidence, grp, CAST(tp AS BIGINT) AS tp, CAST(d - tp AS BIGINT) AS fp, CAST(g - tp AS BIGINT) AS fn FROM allc),
mr AS (SELECT confidence, grp, tp, fp, fn, {RATES_SQL} FROM mx)"""


def operating_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    overall = matrix(spark, sf_dir).where("grp = 'overall'").drop("grp").select("confidence", "tp", "fp", "fn", *_r(*RATES))
    return matching.operating_points(overall)


def group_operating_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = matching.group_operating_points(matrix(spark, sf_dir).select("confidence", "grp", "tp", "fp", "fn", *_r(*RATES)))
    return points.select("grp", "selection", "confidence", "tp", "fp", "fn", *RATES)


_PICK = """(SELECT '{0}' AS selection, confidence, tp, fp, fn, false_alarm_rate, precision, recall, f1 FROM mr WHERE grp = 'overall' ORDER BY {1} LIMIT 1)"""
_POINTS = " UNION ALL ".join(
    _PICK.format(n, o)
    for n, o in (
        ("gate_min_fdr", "CASE WHEN recall >= 0.85 THEN 0 ELSE 1 END, false_alarm_rate, -recall, confidence"),
        ("best_f1", "CASE WHEN recall >= 0.85 AND false_alarm_rate <= 0.2 THEN 0 WHEN recall >= 0.85 THEN 1 ELSE 2 END, -f1, -recall, false_alarm_rate, confidence"),
        ("max_recall_under_fdr", "CASE WHEN false_alarm_rate <= 0.2 THEN 0 ELSE 1 END, -recall, false_alarm_rate, -f1, -confidence"),
    )
)
_GROUP_POINTS = " UNION ALL ".join(
    f"SELECT grp, '{n}' AS selection, confidence, tp, fp, fn, false_alarm_rate, precision, recall, f1 FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY {o}) AS rn FROM mr WHERE grp <> 'overall' AND false_alarm_rate <= 0.2) WHERE rn = 1"
    for n, o in (("balanced", "-f1, -recall, false_alarm_rate, confidence"), ("max_recall", "-recall, -f1, false_alarm_rate, confidence"))
)


def _levels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Current, low-score and loosely suppressed detections; a fifth stands for what suppression has taken, so that every error type occurs."""
    det = detections(spark, sf_dir)
    return det.where("score >= 0.5 and pi % 5 != 0"), det.where("score >= 0.2 and pi % 5 != 0"), det.where("score >= 0.2")


_LEVELS = "cur AS (SELECT * FROM det WHERE score >= 0.5 AND pi % 5 <> 0), low AS (SELECT * FROM det WHERE score >= 0.2 AND pi % 5 <> 0), loose AS (SELECT * FROM det WHERE score >= 0.2)"


def instance_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt = ground_truth(spark, sf_dir)
    return matching.instance_errors(*_levels(spark, sf_dir), gt).withColumn("matched_iou", F.round("matched_iou", 6))


_TAXONOMY = f"""{_BASE}, {_LEVELS}, {pairs_sql('cur', 'pc')}, {pairs_sql('low', 'pl')}, {pairs_sql('loose', 'po')}, {pairs_sql('loose', 'pa', False)},
{match_sql('pc', 'mc')}, {match_sql('pl', 'ml')}, {match_sql('po', 'mo')}, {match_sql('pc', 'm5', 0.5)}, {match_sql('pc', 'm7', 0.75)},
nr AS (SELECT image, gi, max(iou) FILTER (grp = gt_grp) AS own, bool_or(iou >= {_LIMIT.format('gt_grp')}) FILTER (grp <> gt_grp) AS other FROM pa GROUP BY image, gi),
tx AS (SELECT g.image, g.gi, g.grp, CASE WHEN mc.pi IS NOT NULL THEN 'detected' WHEN ml.pi IS NOT NULL THEN 'low_confidence' WHEN mo.pi IS NOT NULL THEN 'nms_suppressed' WHEN nr.other THEN 'wrong_group' WHEN nr.own >= 0.1 THEN 'localization' ELSE 'no_candidate' END AS error,
  coalesce(mc.pi, -1) AS matched_pi, round(coalesce(mc.iou, 0), 6) AS matched_iou, m5.pi IS NOT NULL AS iou50, m7.pi IS NOT NULL AS iou75
FROM gt g LEFT JOIN mc USING (image, gi) LEFT JOIN ml USING (image, gi) LEFT JOIN mo USING (image, gi) LEFT JOIN m5 USING (image, gi) LEFT JOIN m7 USING (image, gi) LEFT JOIN nr USING (image, gi))"""


def instance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matching.instance_errors(*_levels(spark, sf_dir), ground_truth(spark, sf_dir))
    gid = F.grouping_id()
    level = F.when(gid == 0, "group_error").when(gid == 1, "group").when(gid == 2, "error").otherwise("all")
    return rows.cube("grp", "error").agg(level.alias("level"), F.count("*").alias("n")).select("level", F.coalesce("grp", F.lit("")).alias("grp"), F.coalesce("error", F.lit("")).alias("error"), "n")


def false_positive_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.false_positives(detections(spark, sf_dir), ground_truth(spark, sf_dir)).withColumn("nearest_iou", F.round("nearest_iou", 6))


_FPS = f"""{pairs_sql('det', 'pd')}, {match_sql('pd', 'mt')}, {pairs_sql('det', 'pa', False)},
fpn AS (SELECT image, pi, bool_or(grp = gt_grp AND iou >= {_LIMIT.format('gt_grp')}) AS dup, bool_or(grp <> gt_grp AND iou >= {_LIMIT.format('gt_grp')}) AS other, max(iou) FILTER (grp = gt_grp) AS own,
  arg_max({{'gi': gi, 'iou': iou}}, {{'iou': iou, 'g': -gi}}) AS near FROM pa GROUP BY image, pi),
fps AS (SELECT d.image, d.pi, d.grp, d.score, CASE WHEN n.dup THEN 'duplicate' WHEN n.other THEN 'wrong_group' WHEN n.own >= 0.1 THEN 'localization' ELSE 'background' END AS reason,
  coalesce(n.near.gi, -1) AS nearest_gi, coalesce(n.near.iou, 0) AS nearest_iou, d.x1, d.y1, d.x2, d.y2 FROM det d ANTI JOIN mt ON d.image = mt.image AND d.pi = mt.pi LEFT JOIN fpn n ON n.image = d.image AND n.pi = d.pi)"""


def nms_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.suppressed(detections(spark, sf_dir), 0.5).select("image", "pi", "grp", "score")


_KEPT = """n1 AS (SELECT image, grp, list_sort(list({'down': -score, 'pi': pi, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2})) AS rs FROM det GROUP BY image, grp),
n2 AS (SELECT image, grp, list_reduce(rs, lambda k, x: CASE WHEN len(list_filter(k, lambda o: greatest(least(o.x2, x.x2) - greatest(o.x1, x.x1), 0) * greatest(least(o.y2, x.y2) - greatest(o.y1, x.y1), 0)
  / greatest((o.x2 - o.x1) * (o.y2 - o.y1) + (x.x2 - x.x1) * (x.y2 - x.y1) - greatest(least(o.x2, x.x2) - greatest(o.x1, x.x1), 0) * greatest(least(o.y2, x.y2) - greatest(o.y1, x.y1), 0), 1e-9) >= 0.5)) > 0 THEN k ELSE list_append(k, x) END, rs[1:0]) AS ks FROM n1),
n3 AS (SELECT image, CAST(m.pi AS BIGINT) AS pi, grp, -m.down AS score FROM (SELECT image, grp, unnest(ks) AS m FROM n2))"""


def crowded_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.crowded(ground_truth(spark, sf_dir))


_CROWD = f"""WITH {GT_SQL}, c AS (SELECT image, grp, gi, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS dg FROM gt)
SELECT a.image, a.gi, EXISTS (SELECT 1 FROM c b WHERE a.image = b.image AND a.grp = b.grp AND a.gi <> b.gi AND sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) <= 2 * greatest(a.dg, b.dg)) AS crowded FROM c a"""


def size_edge_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, w, h = F.col("box"), F.lit(WIDTH), F.lit(HEIGHT)
    rows = ground_truth(spark, sf_dir).select("grp", boxes.size_bucket(boxes.area(b)).alias("size"), boxes.at_edge(b, w, h).alias("edge"))
    return rows.groupBy("grp", "size").agg(F.count("*").alias("n"), F.count_if("edge").alias("n_edge"))


_SIZES = f"""WITH {GT_SQL} SELECT grp, CASE WHEN (x2 - x1) * (y2 - y1) < 1024 THEN 'small' WHEN (x2 - x1) * (y2 - y1) < 9216 THEN 'medium' ELSE 'large' END AS size, count(*) AS n,
count(*) FILTER (x1 <= 12.8 OR y1 <= 12.8 OR x2 >= 627.2 OR y2 >= 627.2) AS n_edge FROM gt GROUP BY 1, 2"""


def _false(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = detections(spark, sf_dir)
    return matching.false_positives(det, ground_truth(spark, sf_dir)).join(det.select("image", "pi", "box"), ["image", "pi"]).withColumns({"width": F.lit(640), "height": F.lit(640)})


def filter_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mining.safe_backgrounds(_false(spark, sf_dir), per_image=1)
    return rows.groupBy(F.coalesce("excluded", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"))


_CASCADE = f"""{_BASE}, {_FPS},
ex AS (SELECT *, CASE WHEN grp <> 'vehicle' THEN 'other_group' WHEN reason <> 'background' THEN reason WHEN score < 0.35 THEN 'below_minimum_score' WHEN nearest_iou > 0.05 THEN 'near_any_gt'
  WHEN x1 <= 12.8 OR y1 <= 12.8 OR x2 >= 627.2 OR y2 >= 627.2 THEN 'prediction_at_image_edge' END AS e FROM fps),
rk AS (SELECT *, row_number() OVER (PARTITION BY image, e IS NULL ORDER BY score DESC, pi) AS rn FROM ex)
SELECT coalesce(e, CASE WHEN rn > 1 THEN 'per_image_cap' ELSE 'kept' END) AS outcome, count(*) AS n FROM rk GROUP BY 1"""


def hard_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.hard_manifest(matching.instance_errors(*_levels(spark, sf_dir), ground_truth(spark, sf_dir)))


_POINTS_SQL = "CASE error WHEN 'no_candidate' THEN 2.0 WHEN 'low_confidence' THEN 1.5 WHEN 'nms_suppressed' THEN 1.2 ELSE 1.0 END"
_HARD = f"""hk AS (SELECT image, error, count(*) AS n FROM tx WHERE error IN ('no_candidate', 'low_confidence', 'nms_suppressed', 'localization') GROUP BY 1, 2),
hm AS (SELECT image, CAST(sum(n) AS BIGINT) AS n_objects, string_agg(error, ';' ORDER BY error) AS reasons, CAST(max({_POINTS_SQL}) + 0.5 * (count(*) - 1) AS DOUBLE) AS score FROM hk GROUP BY image)"""


def _background(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _false(spark, sf_dir).where("reason = 'background' and grp = 'vehicle'")


_BACK = "bk AS (SELECT image, count(*) AS b FROM fps WHERE reason = 'background' AND grp = 'vehicle' GROUP BY image)"


def replay_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.replay_union(hard_manifest(spark, sf_dir), _background(spark, sf_dir))


def native_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = matching.instance_errors(*_levels(spark, sf_dir), ground_truth(spark, sf_dir))
    return mining.native_replay(errors, _background(spark, sf_dir))


_FPS_ONLY = _FPS.replace(pairs_sql("det", "pa", False), pairs_sql("det", "pq", False)).replace("FROM pa GROUP BY image, pi", "FROM pq GROUP BY image, pi")


def hard_negative_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mining.negative_crops(_background(spark, sf_dir), ground_truth(spark, sf_dir))
    return rows.select("image", "pi", "factor", *[F.col(f"crop.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])


_CROPS = f"""{_BASE}, {_FPS}, f AS (SELECT unnest([3.0, 7.0]::DOUBLE[]) AS factor), v AS (SELECT image, pi, factor, x1 AS bx1, y1 AS by1, x2 AS bx2, y2 AS by2,
 greatest((x1 + x2) / 2 - (x2 - x1) * factor / 2, 0) AS x1, greatest((y1 + y2) / 2 - (y2 - y1) * factor / 2, 0) AS y1, least((x1 + x2) / 2 + (x2 - x1) * factor / 2, 640) AS x2, least((y1 + y2) / 2 + (y2 - y1) * factor / 2, 640) AS y2
 FROM fps, f WHERE reason = 'background' AND grp = 'vehicle')
SELECT image, pi, factor, x1, y1, x2, y2 FROM v WHERE bx1 - x1 >= 4 AND by1 - y1 >= 4 AND x2 - bx2 >= 4 AND y2 - by2 >= 4
 AND NOT EXISTS (SELECT 1 FROM gt g WHERE g.image = v.image AND v.x1 < g.x2 AND g.x1 < v.x2 AND v.y1 < g.y2 AND g.y1 < v.y2)"""


def prediction_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = detections(spark, sf_dir)
    other = det.where("pi % 13 != 0").withColumn("score", F.col("score") + F.lit(0.25))
    return matching.prediction_difference(det, other).select("images", "exact_images", "pairs", *_r("mean_iou", "mean_score_delta"))


def label_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = detections(spark, sf_dir).select("grp", "fine", boxes.centred(F.col("box"), F.lit(600.0), F.lit(600.0)).alias("c"))
    ok = boxes.valid_label(F.col("fine"), *[F.col(f"c.{k}") for k in "xywh"])
    return lab.groupBy("grp").agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


_VALID = f"""{_BASE}, v AS (SELECT grp, (x1 + x2) / 2 / 600 BETWEEN 0 AND 1 AND (y1 + y2) / 2 / 600 BETWEEN 0 AND 1 AND (x2 - x1) / 600 > 0 AND (x2 - x1) / 600 <= 1 AND (y2 - y1) / 600 > 0 AND (y2 - y1) / 600 <= 1 AS ok FROM det)
SELECT grp, count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS invalid FROM v GROUP BY grp"""


def fraction_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, w, h = F.col("box"), F.lit(WIDTH), F.lit(HEIGHT)
    gt = ground_truth(spark, sf_dir)
    rows = gt.join(matching.crowded(gt), ["image", "gi"])
    i = F.col("image") % 20
    rows = rows.select(F.when(i < 14, "train").when(i < 17, "val").otherwise("test").alias("split"), (boxes.size_bucket(boxes.area(b)) == "small").alias("small"), "crowded", boxes.at_edge(b, w, h).alias("edge"))
    return audits.fraction_gaps(rows, "split", ["small", "crowded", "edge"]).select("flag", *_r("gap"))


_GAPS = f"""{_CROWD.replace('SELECT a.image', ', cf AS (SELECT a.image', 1)}),
fr AS (SELECT CASE WHEN image % 20 < 14 THEN 'train' WHEN image % 20 < 17 THEN 'val' ELSE 'test' END AS split, avg(CAST((x2 - x1) * (y2 - y1) < 1024 AS INT)) AS small, avg(CAST(crowded AS INT)) AS crowded,
 avg(CAST(x1 <= 12.8 OR y1 <= 12.8 OR x2 >= 627.2 OR y2 >= 627.2 AS INT)) AS edge FROM gt JOIN cf USING (image, gi) GROUP BY 1)
SELECT 'small' AS flag, round(max(small) - min(small), 6) AS gap FROM fr UNION ALL SELECT 'crowded', round(max(crowded) - min(crowded), 6) FROM fr UNION ALL SELECT 'edge', round(max(edge) - min(edge), 6) FROM fr"""

_MATCHED = f"{_BASE}, {pairs_sql('det', 'pd')}, {match_sql('pd', 'mt')}"
_DIFFERENCE = f"""{_BASE}, a AS (SELECT image, pi, CAST(fine AS VARCHAR) AS grp, CAST(-pi AS DOUBLE) AS score, score AS was, x1, y1, x2, y2 FROM det),
b AS (SELECT image, pi AS gi, CAST(fine AS VARCHAR) AS grp, score + 0.25 AS now, x1, y1, x2, y2 FROM det WHERE pi % 13 <> 0),{pairs_sql('a', 'pd', gt='b')},{match_sql('pd', 'mt', 0.999)},
i AS (SELECT coalesce(l.image, r.image) AS image, coalesce(l.n, 0) AS l, coalesce(r.n, 0) AS r FROM (SELECT image, count(*) AS n FROM a GROUP BY image) l FULL JOIN (SELECT image, count(*) AS n FROM b GROUP BY image) r ON l.image = r.image),
m AS (SELECT mt.image, count(*) AS m, sum(mt.iou) AS iou, sum(abs(a.was - b.now)) AS delta FROM mt JOIN a ON a.image = mt.image AND a.pi = mt.pi JOIN b ON b.image = mt.image AND b.gi = mt.gi GROUP BY mt.image)
SELECT count(*) AS images, count(*) FILTER (l = r AND l = coalesce(m, 0)) AS exact_images, CAST(sum(m) AS BIGINT) AS pairs, round(sum(iou) / greatest(sum(m), 1), 6) AS mean_iou, round(sum(delta) / greatest(sum(m), 1), 6) AS mean_score_delta FROM i LEFT JOIN m USING (image)"""
MODELS_SQL = f"""{_MATCHED}, {_COUNTS}, {_KEPT}, dk AS (SELECT det.* FROM det JOIN n3 USING (image, pi)), {pairs_sql('dk', 'pk')}, {match_sql('pk', 'mk')}, {counts_sql('dk', 'mk', 'totk')}
SELECT a.grp, a.tp AS a_tp, b.tp AS b_tp, b.tp - a.tp AS tp_change, b.fp - a.fp AS fp_change FROM tot a JOIN totk b ON a.grp = b.grp"""

QUERIES = {
    f.__name__: f
    for f in (
        match_metrics_by_group, threshold_matrix, operating_points, group_operating_points, instance_taxonomy, instance_summary, false_positive_taxonomy, nms_by_group, crowded_flags,
        size_edge_distribution, filter_cascade, hard_manifest, replay_union, native_replay, hard_negative_crops, prediction_difference, label_validity, fraction_gaps,
    )
}
ORACLES = {
    "match_metrics_by_group": f"{_MATCHED}, {_COUNTS} SELECT grp, tp, fp, fn, {RATES_SQL} FROM tot",
    "threshold_matrix": f"{_MATCHED}, {_MATRIX} SELECT * FROM mr",
    "operating_points": f"{_MATCHED}, {_MATRIX} {_POINTS}",
    "group_operating_points": f"{_MATCHED}, {_MATRIX} {_GROUP_POINTS}",
    "instance_taxonomy": f"{_TAXONOMY} SELECT * FROM tx",
    "instance_summary": f"{_TAXONOMY} SELECT CASE GROUPING(grp, error) WHEN 0 THEN 'group_error' WHEN 1 THEN 'group' WHEN 2 THEN 'error' ELSE 'all' END AS level, coalesce(grp, '') AS grp, coalesce(error, '') AS error, count(*) AS n FROM tx GROUP BY CUBE (grp, error)",
    "false_positive_taxonomy": f"{_BASE}, {_FPS} SELECT image, pi, grp, score, reason, nearest_gi, round(nearest_iou, 6) AS nearest_iou FROM fps",
    "nms_by_group": f"{_BASE}, {_KEPT} SELECT * FROM n3",
    "crowded_flags": _CROWD,
    "size_edge_distribution": _SIZES,
    "filter_cascade": _CASCADE,
    "hard_manifest": f"{_TAXONOMY}, {_HARD} SELECT * FROM hm",
    "replay_union": f"{_TAXONOMY}, {_HARD}, {_FPS_ONLY}, {_BACK} SELECT coalesce(h.image, b.image) AS image, coalesce(h.n_objects, 0) AS hard_objects, coalesce(b.b, 0) AS background_boxes, concat_ws(';', CASE WHEN b.b > 0 THEN 'background' END, CASE WHEN h.n_objects > 0 THEN 'hard_positive' END) AS kinds FROM hm h FULL JOIN bk b ON h.image = b.image",
    "native_replay": f"""{_TAXONOMY}, {_HARD}, {_FPS_ONLY}, {_BACK}, sh AS (SELECT image, bool_or(grp = 'ship') AS ship FROM tx WHERE error IN ('no_candidate', 'low_confidence', 'nms_suppressed', 'localization') GROUP BY image),
x AS (SELECT coalesce(h.image, b.image) AS image, b.b, sh.ship, h.reasons, CASE WHEN b.b IS NOT NULL THEN 1.5 ELSE round(h.score, 3) END AS score FROM hm h LEFT JOIN sh USING (image) FULL JOIN bk b ON h.image = b.image)
SELECT image, CASE WHEN b IS NOT NULL THEN 'vehicle_background' WHEN ship THEN 'ship_hard_positive' ELSE 'vehicle_hard_positive' END AS pool, CAST(least(greatest(floor(score), 1), 3) AS INT) AS repeats, CAST(score AS DOUBLE) AS score, concat_ws(';', reasons, CASE WHEN b IS NOT NULL THEN 'background_fp' END) AS reasons, coalesce(b, 0) AS background_boxes FROM x""",
    "hard_negative_crops": _CROPS,
    "prediction_difference": _DIFFERENCE,
    "label_validity": _VALID,
    "fraction_gaps": _GAPS,
}
