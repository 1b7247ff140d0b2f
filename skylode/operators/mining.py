"""Hard examples, safe backgrounds and replay manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylode.functions.boxes import expanded

#: The limits of safe backgrounds.
MIN_SCORE, MAX_IOU, EDGE, PER_IMAGE = 0.35, 0.05, 0.02, 4
HARD = ("no_candidate", "low_confidence", "nms_suppressed", "localization")
#: Points of an error type.
WEIGHTS = {"no_candidate": 2.0, "low_confidence": 1.5, "nms_suppressed": 1.2, "localization": 1.0, "background_fp": 1.5}


def cascade(rows: DataFrame, rules: list[tuple[str, Column]], into: str = "excluded") -> DataFrame:
    """``rows`` with the name of the first rule that fails, null where none does. A rule that is null fails."""
    first = None
    for name, rule in rules:
        bad = ~F.coalesce(rule, F.lit(False))
        first = F.when(bad, name) if first is None else first.when(bad, name)
    return rows.withColumn(into, first)


def safe_backgrounds(fps: DataFrame, group: str = "vehicle", per_image: int = PER_IMAGE) -> DataFrame:
    """False positives (image, pi, grp, reason, score, nearest_iou, box, width, height) with ``excluded``: null for backgrounds that are safe to learn from.

    The first failing rule counts; of what is left the best few of each image stay, by score and pi.
    """
    b, w, h = F.col("box"), F.col("width"), F.col("height")
    inside = (b["x1"] > w * EDGE) & (b["y1"] > h * EDGE) & (b["x2"] < w * (1 - EDGE)) & (b["y2"] < h * (1 - EDGE))
    rules = [
        ("other_group", F.col("grp") == group),
        ("below_minimum_score", F.col("score") >= MIN_SCORE),
        ("near_any_gt", F.col("nearest_iou") <= MAX_IOU),
        ("prediction_at_image_edge", inside),
    ]
    not_background = F.when((F.col("grp") == group) & (F.col("reason") != "background"), F.col("reason"))
    rows = cascade(fps, rules).withColumn("excluded", F.coalesce(not_background, "excluded"))
    order = Window.partitionBy("image", F.col("excluded").isNull()).orderBy(F.desc("score"), "pi")
    return rows.withColumn("__n", F.row_number().over(order)).withColumn("excluded", F.when(F.col("excluded").isNull() & (F.col("__n") > per_image), "per_image_cap").otherwise(F.col("excluded"))).drop("__n")


def _points(kind: Column) -> Column:
    out = F.lit(0.0)
    for name, value in WEIGHTS.items():
        out = F.when(kind == name, F.lit(value)).otherwise(out)
    return out


def hard_manifest(instances: DataFrame) -> DataFrame:
    """Rows (image, n_objects, reasons, score) of images with hard instances (image, gi, grp, error): the points of the heaviest error type, and half a point for each further type."""
    kinds = instances.where(F.col("error").isin(*HARD)).groupBy("image", "error").agg(F.count("*").alias("n"))
    return kinds.groupBy("image").agg(
        F.sum("n").alias("n_objects"),
        F.array_join(F.array_sort(F.collect_list("error")), ";").alias("reasons"),
        (F.max(_points(F.col("error"))) + F.lit(0.5) * (F.count("*") - 1)).alias("score"),
    )


def replay_union(hard: DataFrame, background: DataFrame) -> DataFrame:
    """Rows (image, hard_objects, background_boxes, kinds): the full union of both sides' images."""
    b = background.groupBy("image").agg(F.count("*").alias("background_boxes"))
    both = hard.select("image", F.col("n_objects").alias("hard_objects")).join(b, "image", "full").na.fill(0, ["hard_objects", "background_boxes"])
    kinds = F.concat_ws(";", F.when(F.col("background_boxes") > 0, "background"), F.when(F.col("hard_objects") > 0, "hard_positive"))
    return both.select("image", "hard_objects", "background_boxes", kinds.alias("kinds"))


def native_replay(instances: DataFrame, background: DataFrame, most: int = 3) -> DataFrame:
    """Rows (image, pool, repeats, score, reasons, background_boxes): each image's pool and how often it is replayed.

    An image with a hard ship is in the ship pool, another hard image in the vehicle
    pool. An image with background boxes is in the background pool, whatever it was. Repeats are whole points, 1 to ``most``.
    """
    ships = instances.where(F.col("error").isin(*HARD)).groupBy("image").agg(F.bool_or(F.col("grp") == "ship").alias("ship"))
    hard = hard_manifest(instances).join(ships, "image")
    back = background.groupBy("image").agg(F.count("*").alias("b"))
    both = hard.join(back, "image", "full")
    is_back = F.col("b").isNotNull()
    score = F.round(F.when(is_back, F.lit(WEIGHTS["background_fp"])).otherwise(F.col("score")), 3)
    return both.select(
        "image",
        F.when(is_back, "vehicle_background").when(F.col("ship"), "ship_hard_positive").otherwise("vehicle_hard_positive").alias("pool"),
        F.least(F.greatest(F.floor(score).cast("int"), F.lit(1)), F.lit(most)).alias("repeats"),
        score.alias("score"),
        F.concat_ws(";", "reasons", F.when(is_back, "background_fp")).alias("reasons"),
        F.coalesce("b", F.lit(0)).alias("background_boxes"),
    )


def negative_crops(boxes: DataFrame, gt: DataFrame, factors: tuple[float, ...] = (3.0, 7.0), border: float = 4.0) -> DataFrame:
    """Rows (image, pi, factor, crop) of context crops around background boxes that touch no ground truth and hold the box with a border."""
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    views = None
    for f in factors:
        one = boxes.select("image", "pi", F.lit(f).alias("factor"), expanded(F.col("box"), f, w, h).alias("crop"), "box")
        views = one if views is None else views.unionByName(one)
    c, b = F.col("crop"), F.col("box")
    roomy = (b["x1"] - c["x1"] >= border) & (b["y1"] - c["y1"] >= border) & (c["x2"] - b["x2"] >= border) & (c["y2"] - b["y2"] >= border)
    g = gt.select(F.col("image").alias("gi_image"), F.col("box").alias("g"))
    touch = (F.col("image") == F.col("gi_image")) & (c["x1"] < F.col("g.x2")) & (F.col("g.x1") < c["x2"]) & (c["y1"] < F.col("g.y2")) & (F.col("g.y1") < c["y2"])
    return views.where(roomy).join(g, touch, "left_anti").select("image", "pi", "factor", "crop")
