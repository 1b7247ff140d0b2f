"""Detections against ground truth: matching, metrics, error classes, suppression.

Detections have (image, pi, box, score, fine, grp), ground truth (image, gi, box, fine,
grp); ``box`` is a struct of corners. All sequential work is a fold over one
(image, group), so it is as parallel as there are such groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylode.functions.boxes import iou, iou_threshold
from skylode.functions.numbers import rates

GROUPS = ("ship", "aircraft", "vehicle")
LOCALIZATION = 0.10


def overlaps(det: DataFrame, gt: DataFrame, same_group: bool = True, also: tuple[str, ...] = ()) -> DataFrame:
    """Rows (image, grp, pi, score, fine, gi, gt_grp, gt_fine, iou, and the detection's columns ``also``) of boxes that overlap at all. The image (and group) is the key, so nothing is paired across images."""
    g = gt.select("image", F.col("grp").alias("gt_grp"), "gi", F.col("box").alias("gt_box"), F.col("fine").alias("gt_fine"))
    on = [det["image"] == g["image"]] + ([det["grp"] == g["gt_grp"]] if same_group else [])
    near = (F.col("box.x1") < F.col("gt_box.x2")) & (F.col("gt_box.x1") < F.col("box.x2")) & (F.col("box.y1") < F.col("gt_box.y2")) & (F.col("gt_box.y1") < F.col("box.y2"))
    return det.join(g, on).where(near).select(det["image"], "grp", "pi", "score", "fine", "gi", "gt_grp", "gt_fine", iou(F.col("box"), F.col("gt_box")).alias("iou"), *also)


def greedy_matches(det: DataFrame, gt: DataFrame, class_aware: bool = True, floor: float | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Rows (image, grp, pi, gi, gt_grp, score, iou): one-to-one matches.

    By score (highest first, then pi) each detection takes its best unmatched
    box (highest overlap, then gi), if their overlap reaches the threshold of the box's
    group (or ``floor``); otherwise it takes none. Class-aware, groups never
    compete, and each (image, group) is folded alone.
    """
    pairs = overlaps(det, gt, class_aware) if pairs is None else pairs
    limit = F.lit(float(floor)) if floor is not None else iou_threshold("gt_grp")
    pairs = pairs.withColumn("limit", limit)
    if class_aware or floor is not None:
        # With one limit for all candidates of a detection, those below it neither match nor stand before one that does.
        pairs = pairs.where("iou >= limit")
    return _folded(pairs, ["image", "grp"] if class_aware else ["image"])


def _folded(pairs: DataFrame, key: list[str]) -> DataFrame:
    """Rows (``key``, grp, pi, gi, gt_grp, score, iou) of the greedy matches inside each ``key``; a pair's ``limit`` is the least overlap that counts."""
    own = [c for c in key if c != "grp"]
    row = F.struct((-F.col("score")).alias("down"), F.col("pi").cast("long").alias("pi"), (-F.col("iou")).alias("far"), F.col("gi").cast("long").alias("gi"), F.col("grp").alias("dg"), F.col("gt_grp").alias("gt_grp"), (F.col("iou") >= F.col("limit")).alias("good"))
    lists = pairs.groupBy(*key).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    # ``last`` is the detection that has taken its best free box, or found it too far off: its other pairs count no more.
    start = F.struct(F.slice("rows", F.lit(1), F.lit(0)).alias("taken"), F.lit(None).cast("long").alias("last"))

    def step(done: Column, x: Column) -> Column:
        free = ~done["last"].eqNullSafe(x["pi"]) & ~F.exists(done["taken"], lambda t: t["gi"] == x["gi"])
        return F.struct(F.when(free & x["good"], F.concat(done["taken"], F.array(x))).otherwise(done["taken"]).alias("taken"), F.when(free, x["pi"]).otherwise(done["last"]).alias("last"))

    taken = F.aggregate("rows", start, step)["taken"]
    found = lists.select(*own, F.explode(F.when(F.size("rows") == 1, F.filter("rows", lambda x: x["good"])).otherwise(taken)).alias("m"))
    return found.select(*own, F.col("m.dg").alias("grp"), "m.pi", "m.gi", "m.gt_grp", (-F.col("m.down")).cast("double").alias("score"), (-F.col("m.far")).alias("iou"))


def group_counts(det: DataFrame, gt: DataFrame, matches: DataFrame) -> DataFrame:
    """Rows (grp, tp, fp, fn), overall as grp 'overall'. Detections and boxes are counted from their whole tables, so images without a pair count."""
    count = lambda df, name: df.groupBy("grp").agg(F.count("*").alias(name))
    found = count(det, "d").join(count(gt, "g"), "grp", "full").join(count(matches, "tp"), "grp", "left").na.fill(0)
    one = found.select("grp", F.col("tp"), (F.col("d") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn"))
    total = F.grouping_id("grp") == 1
    return one.rollup("grp").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.when(total, "overall").otherwise(F.col("grp")).alias("name")).select(F.col("name").alias("grp"), "tp", "fp", "fn")


def with_rates(counts: DataFrame) -> DataFrame:
    return counts.select("*", *[v.alias(k) for k, v in rates(F.col("tp"), F.col("fp"), F.col("fn")).items()])


def metrics(det: DataFrame, gt: DataFrame, confidence: float = 0.0) -> DataFrame:
    """Counts and rates by group and overall, of detections with this score at least."""
    kept = det.where(F.col("score") >= confidence)
    return with_rates(group_counts(kept, gt, greedy_matches(kept, gt)))


def threshold_matrix(det: DataFrame, gt: DataFrame, confidences: list[float]) -> DataFrame:
    """Rows (confidence, grp, tp, fp, fn, rates) for a grid of score limits.

    A greedy match by falling score never depends on lower scores, so one
    matching serves every limit: each count is that of matches, or detections, from the limit on.
    """
    matches = greedy_matches(det, gt)
    limits = F.array(*[F.lit(float(c)) for c in confidences])
    # Counted by the highest limit that a score reaches, then summed over the limits below.
    reached = F.array_max(F.filter(limits, lambda c: c <= F.col("score")))
    by = lambda df, name: df.select("grp", reached.alias("c")).where("c is not null").groupBy("grp", "c").agg(F.count("*").alias(name))
    boxes = gt.groupBy("grp").agg(F.count("*").alias("g"))
    cells = boxes.join(det.select("grp").distinct(), "grp", "full").select("grp", F.coalesce("g", F.lit(0)).alias("g"), F.explode(limits).alias("c"))
    w = Window.partitionBy("grp").orderBy(F.desc("c"))
    sums = cells.join(by(det, "d"), ["grp", "c"], "left").join(by(matches, "tp"), ["grp", "c"], "left").na.fill(0, ["d", "tp"])
    sums = sums.select("grp", F.col("c").alias("confidence"), F.sum("tp").over(w).alias("tp"), F.sum("d").over(w).alias("dd"), "g")
    one = sums.select("confidence", "grp", "tp", (F.col("dd") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn"))
    whole = one.groupBy("confidence").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).select("confidence", F.lit("overall").alias("grp"), "tp", "fp", "fn")
    return with_rates(one.unionByName(whole))


def operating_points(overall: DataFrame, min_recall: float = 0.85, max_alarm: float = 0.20) -> DataFrame:
    """Rows (selection, confidence, tp, fp, fn, rates): the three winners among candidates.

    gate_min_fdr has the fewest false alarms of the candidates with enough recall,
    best_f1 the best f1 of those within both limits (else with enough recall),
    max_recall_under_fdr the most recall of those with few enough false alarms. Where
    no candidate qualifies all do.
    """
    r, a, f1, c = F.col("recall"), F.col("false_alarm_rate"), F.col("f1"), F.col("confidence")
    fine, quiet = r >= min_recall, a <= max_alarm
    best = F.when(fine & quiet, 0).when(fine, 1).otherwise(2)
    rows = {
        "gate_min_fdr": (F.when(fine, 0).otherwise(1), a, -r, c),
        "best_f1": (best, -f1, -r, a, c),
        "max_recall_under_fdr": (F.when(quiet, 0).otherwise(1), -r, a, -f1, -c),
    }
    whole = F.struct(*overall.columns)
    picked = overall.agg(*[F.min_by(whole, F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])).alias(n) for n, keys in rows.items()])
    listed = F.explode(F.array(*[F.struct(F.lit(n).alias("selection"), F.col(n).alias("p")) for n in rows])).alias("x")
    return picked.select(listed).where("x.p is not null").select("x.selection", "x.p.*")


def group_operating_points(matrix: DataFrame, caps: dict[str, float] | None = None, cap: float = 0.20) -> DataFrame:
    """Rows (grp, selection, confidence, tp, fp, fn, rates): for each group the balanced and the most recalling point under its cap on false alarms. A group without one has no row."""
    limit = F.lit(cap)
    for g, v in (caps or {}).items():
        limit = F.when(F.col("grp") == g, F.lit(v)).otherwise(limit)
    pool = matrix.where((F.col("grp") != "overall") & (F.col("false_alarm_rate") <= limit))
    r, a, f1, c = F.col("recall"), F.col("false_alarm_rate"), F.col("f1"), F.col("confidence")
    whole = F.struct(*[F.col(x) for x in matrix.columns if x != "grp"])
    picked = pool.groupBy("grp").agg(F.min_by(whole, F.struct((-f1).alias("a"), (-r).alias("b"), a.alias("c"), c.alias("d"))).alias("balanced"), F.min_by(whole, F.struct((-r).alias("a"), (-f1).alias("b"), a.alias("c"), c.alias("d"))).alias("max_recall"))
    listed = F.explode(F.array(*[F.struct(F.lit(n).alias("selection"), F.col(n).alias("p")) for n in ("balanced", "max_recall")])).alias("x")
    return picked.select("grp", listed).select("grp", "x.selection", "x.p.*")


def combined_points(points: DataFrame) -> DataFrame:
    """Counts of the groups' winners summed for each selection, with rates."""
    return with_rates(points.groupBy("selection").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))


def instance_errors(current: DataFrame, low: DataFrame, loose: DataFrame, gt: DataFrame, floor: float = LOCALIZATION) -> DataFrame:
    """Rows (image, gi, grp, error, matched_pi, matched_iou, iou50, iou75): what became of each box.

    detected if the current detections match it, low_confidence if those with low
    scores do, nms_suppressed if those of a looser suppression do, wrong_group
    if a detection of another group reaches the box's threshold, localization if one of its own
    group overlaps by ``floor`` at least, else no_candidate. matched_pi is -1 and matched_iou 0 without a match.
    """
    key = ["image", "gi"]
    # One join serves the five matchings: each set's pairs are folded once for every limit that it is matched at.
    sets = {"current": (current, {"main": None, "iou50": 0.5, "iou75": 0.75}), "low": (low, {"low": None}), "loose": (loose, {"loose": None})}
    tagged = reduce(DataFrame.unionByName, (df.select("image", "pi", "box", "score", "fine", "grp", F.lit(n).alias("of")) for n, (df, _) in sets.items()))
    pairs = overlaps(tagged, gt, same_group=False, also=("of",)).drop("fine", "gt_fine")
    level = lambda n, at: F.struct(F.lit(n).alias("level"), (iou_threshold("gt_grp") if at is None else F.lit(at)).alias("limit"))
    levels = F.coalesce(*[F.when(F.col("of") == n, F.array(*[level(*x) for x in at.items()])) for n, (_, at) in sets.items()])
    own = pairs.where("grp = gt_grp").select("image", "grp", "pi", "score", "gi", "gt_grp", "iou", F.inline(levels)).where("iou >= limit")
    met = _folded(own, ["image", "grp", "level"])
    at = lambda n: F.bool_or(F.col("level") == n)
    hits = met.groupBy(*key).agg(F.max(F.when(F.col("level") == "main", F.struct("pi", "iou"))).alias("main"), at("low").alias("low"), at("loose").alias("loose"), at("iou50").alias("iou50"), at("iou75").alias("iou75"))
    same = F.col("grp") == F.col("gt_grp")
    near = pairs.where("of = 'loose'").groupBy(*key).agg(F.max(F.when(same, F.col("iou"))).alias("own"), F.bool_or(F.when(~same, F.col("iou") >= iou_threshold("gt_grp"))).alias("other"))
    rows = gt.select("image", "gi", "grp").join(hits, key, "left").join(near, key, "left")
    rows = rows.withColumns({"matched_pi": F.col("main.pi"), "matched_iou": F.col("main.iou")})
    error = (
        F.when(F.col("matched_pi").isNotNull(), "detected")
        .when(F.col("low"), "low_confidence")
        .when(F.col("loose"), "nms_suppressed")
        .when(F.col("other"), "wrong_group")
        .when(F.col("own") >= floor, "localization")
        .otherwise("no_candidate")
    )
    false = F.lit(False)
    return rows.select(*key, "grp", error.alias("error"), F.coalesce("matched_pi", F.lit(-1)).cast("long").alias("matched_pi"), F.coalesce("matched_iou", F.lit(0.0)).alias("matched_iou"), F.coalesce("iou50", false).alias("iou50"), F.coalesce("iou75", false).alias("iou75"))


def false_positives(det: DataFrame, gt: DataFrame, floor: float = LOCALIZATION) -> DataFrame:
    """Rows (image, pi, grp, score, reason, nearest_gi, nearest_iou): why each unmatched detection is wrong.

    duplicate if a box of its group reaches the threshold, wrong_group if one of another group
    reaches that box's, localization if one of its group overlaps by ``floor``, else background.
    """
    key = ["image", "pi"]
    pairs = overlaps(det, gt, same_group=False)
    wrong = det.join(greedy_matches(det, gt, pairs=pairs.where("grp = gt_grp")).select(*key), key, "left_anti")
    same = F.col("grp") == F.col("gt_grp")
    good = F.col("iou") >= iou_threshold("gt_grp")
    near = pairs.groupBy(*key).agg(
        F.bool_or(same & good).alias("duplicate"),
        F.bool_or(~same & good).alias("other"),
        F.max(F.when(same, F.col("iou"))).alias("own"),
        F.max_by(F.struct("gi", "iou"), F.struct("iou", (-F.col("gi")).alias("g"))).alias("near"),
    )
    reason = F.when(F.col("duplicate"), "duplicate").when(F.col("other"), "wrong_group").when(F.col("own") >= floor, "localization").otherwise("background")
    return wrong.join(near, key, "left").select(*key, "grp", "score", reason.alias("reason"), F.coalesce("near.gi", F.lit(-1)).cast("long").alias("nearest_gi"), F.coalesce("near.iou", F.lit(0.0)).alias("nearest_iou"))


def suppressed(det: DataFrame, threshold: float = 0.5, key: str = "grp") -> DataFrame:
    """The detections that stay after suppression in each (image, ``key``): by falling score, then pi, each that overlaps no kept one by the threshold."""
    images = det.groupBy("image", key).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), F.col("pi").alias("pi"), F.col("box").alias("box"))), lambda a, b: F.when(a["down"] < b["down"], -1).when(a["down"] > b["down"], 1).when(a["pi"] < b["pi"], -1).when(a["pi"] > b["pi"], 1).otherwise(0)).alias("rows"))
    none = F.slice("rows", F.lit(1), F.lit(0))

    def step(kept: Column, x: Column) -> Column:
        return F.when(F.exists(kept, lambda k: iou(k["box"], x["box"]) >= threshold), kept).otherwise(F.concat(kept, F.array(x)))

    stay = images.select("image", key, F.explode(F.aggregate("rows", none, step)).alias("k")).select("image", key, F.col("k.pi").alias("pi"))
    return det.join(stay, ["image", key, "pi"], "left_semi")


def crowded(boxes: DataFrame, factor: float = 2.0) -> DataFrame:
    """Rows (image, gi, crowded): whether another box of the group has its centre within ``factor`` times the longer diagonal."""
    cx, cy = (F.col("box.x1") + F.col("box.x2")) / 2, (F.col("box.y1") + F.col("box.y2")) / 2
    rows = boxes.select("image", "grp", "gi", cx.alias("cx"), cy.alias("cy"), F.hypot(F.col("box.x2") - F.col("box.x1"), F.col("box.y2") - F.col("box.y1")).alias("diagonal"))
    a, b = rows.alias("a"), rows.alias("b")
    near = F.hypot(F.col("a.cx") - F.col("b.cx"), F.col("a.cy") - F.col("b.cy")) <= F.greatest("a.diagonal", "b.diagonal") * factor
    pairs = a.join(b, (F.col("a.image") == F.col("b.image")) & (F.col("a.grp") == F.col("b.grp")) & (F.col("a.gi") != F.col("b.gi")) & near, "left_semi")
    flags = pairs.select(F.col("a.image").alias("image"), F.col("a.gi").alias("gi"), F.lit(True).alias("crowded"))
    return boxes.select("image", "gi").join(flags, ["image", "gi"], "left").na.fill(False, ["crowded"])


def prediction_difference(left: DataFrame, right: DataFrame, floor: float = 0.999) -> DataFrame:
    """One row (images, exact_images, pairs, mean_iou, mean_score_delta) comparing two prediction sets, paired one-to-one inside each image and fine class in stored order."""
    a = left.select("image", "pi", "box", F.col("fine").cast("string").alias("grp"), (-F.col("pi")).cast("double").alias("score"), F.col("fine"))
    b = right.select("image", F.col("pi").alias("gi"), "box", F.col("fine").cast("string").alias("grp"), "fine")
    pairs = greedy_matches(a, b, floor=floor)
    pairs = pairs.join(left.select("image", "pi", F.col("score").alias("ls")), ["image", "pi"]).join(right.select("image", F.col("pi").alias("gi"), F.col("score").alias("rs")), ["image", "gi"])
    per = left.groupBy("image").agg(F.count("*").alias("l")).join(right.groupBy("image").agg(F.count("*").alias("r")), "image", "full").na.fill(0)
    per = per.join(pairs.groupBy("image").agg(F.count("*").alias("m"), F.sum("iou").alias("iou"), F.sum(F.abs(F.col("ls") - F.col("rs"))).alias("delta")), "image", "left").na.fill(0)
    return per.agg(F.count("*").alias("images"), F.count_if((F.col("l") == F.col("r")) & (F.col("l") == F.col("m"))).alias("exact_images"), F.sum("m").alias("pairs"), (F.sum("iou") / F.greatest(F.sum("m"), F.lit(1))).alias("mean_iou"), (F.sum("delta") / F.greatest(F.sum("m"), F.lit(1))).alias("mean_score_delta"))
