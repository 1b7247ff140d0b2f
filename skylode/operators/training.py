"""What a training run draws from tables: routes and weights of objects, replays, reviews, contact sheets, tiles put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylode.operators.audits import require
from skylode.operators.matching import suppressed
from skylode.operators.prototypes import leave_one_out

#: What sends an object to the prototype branch, and the bounds of a weight.
PROTOTYPE_GROUPS, PROTOTYPE_SIZES = ("ship", "vehicle"), ("small",)
PROTOTYPE_FAILURES = ("low_confidence", "no_candidate", "nms_suppressed", "wrong_group")
BOUNDS = (0.25, 4.0)


def branch(experiment: Column) -> Column:
    """Which branch teaches an object (columns grp, size, error): g, p, or in experiment gp the prototype branch for weak groups, sizes and failures and the global one for the rest; else null."""
    weak = F.col("grp").isin(*PROTOTYPE_GROUPS) | F.col("size").isin(*PROTOTYPE_SIZES) | F.coalesce(F.col("error").isin(*PROTOTYPE_FAILURES), F.lit(False))
    return F.when(experiment.isin("g", "p"), experiment).when(experiment == "gp", F.when(F.coalesce(weak, F.lit(False)), "p").otherwise("g"))


def route_counts(objects: DataFrame, experiment: Column) -> DataFrame:
    """Rows (image, global_objects, prototype_objects): how many objects of each image a branch teaches; every object has one route at most."""
    route = branch(experiment)
    return objects.groupBy("image").agg(F.count_if(route == "g").alias("global_objects"), F.count_if(route == "p").alias("prototype_objects"))


def _looked_up(key: Column, weights: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for name, weight in weights.items():
        out = F.when(key == name, F.lit(float(weight))).otherwise(out)
    return out


def object_weight(groups: dict[str, float], errors: dict[str, float], crowded: float = 1.0, edge: float = 1.0, small: float = 1.0, bounds: tuple[float, float] = BOUNDS) -> Column:
    """A weight over the columns grp, error, crowded, edge and size: factors multiplied, then held within bounds. The hard object's factors count where there is an ``error`` at all."""
    hard = _looked_up(F.col("error"), errors) * F.when(F.col("crowded"), crowded).otherwise(1.0) * F.when(F.col("edge"), edge).otherwise(1.0) * F.when(F.col("size") == "small", small).otherwise(1.0)
    whole = _looked_up(F.col("grp"), groups) * F.when(F.col("error").isNotNull(), hard).otherwise(1.0)
    return F.greatest(F.lit(bounds[0]), F.least(F.lit(bounds[1]), whole))


def with_mean_one(rows: DataFrame, batch: str, weight: str = "weight") -> DataFrame:
    """``rows`` with their weights divided by the batch's mean. The means are a partial aggregate, joined back."""
    means = rows.groupBy(batch).agg(F.avg(weight).alias("__mean"))
    return rows.join(means, batch).withColumn(weight, F.col(weight) / F.col("__mean")).drop("__mean")


def replayed(images: DataFrame, hard: DataFrame) -> DataFrame:
    """Rows (image, repeat): every image once (0), and each that ``hard`` (image, repeats) names so many times more. A named image that isn't there is an error."""
    extra = hard.join(images.select("image", F.lit(True).alias("there")), "image", "left")
    extra = require(extra, there=F.col("there"), repeats=F.col("repeats") >= 1)
    more = extra.select("image", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))).alias("repeat"))
    return images.select("image", F.lit(0).alias("repeat")).unionByName(more)


def first_in_frame(rows: DataFrame, frame: str, order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each frame. The rank limit works in each task before the shuffle, so a frame of any size costs few rows."""
    place = F.row_number().over(Window.partitionBy(frame).orderBy(*order))
    return rows.withColumn("__place", place).where(F.col("__place") <= most).drop("__place")


def contact_sheet(counts: DataFrame, groups: tuple[str, ...], per_group: int) -> DataFrame:
    """Rows (grp, image, n, place): for each group in order the images with most objects that no group before has taken.

    ``counts`` has (image, grp, n). A group needs as many images as all groups take together at most, so only these are gathered for the sequential choice.
    """
    order = Window.partitionBy("grp").orderBy(F.desc("n"), "image")
    top = counts.where(F.col("grp").isin(*groups) & (F.col("n") > 0)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_group * len(groups))
    taken: dict[str, str] = {}
    out = []
    rows = sorted(top.select("grp", "n", "image").collect(), key=lambda r: (groups.index(r["grp"]), -r["n"], r["image"]))  # per_group * groups^2 rows at most
    for r in rows:
        own = sum(g == r["grp"] for g in taken.values())
        if own < per_group and r["image"] not in taken:
            taken[r["image"]] = r["grp"]
            out.append((r["grp"], r["image"], r["n"], own + 1))
    return counts.sparkSession.createDataFrame(out, f"grp string, image {counts.schema['image'].dataType.simpleString()}, n long, place int")


def fine_candidates(sums: DataFrame, scene: str, min_count: int = 2) -> DataFrame:
    """Rows (key, n, prototype) of the classes (keys fine:...) that have a prototype outside a scene, by key; ``sums`` has (key, scene, sum, n)."""
    own = sums.where(F.startswith("key", F.lit("fine:")))
    seen = own.where(F.col("scene") == scene).select("key").distinct()
    # A class that the scene lacks is left out of nothing: an empty share stands for the scene's.
    width = F.transform("sum", lambda x: F.lit(0.0))
    empty = own.groupBy("key").agg(F.any_value(width).alias("sum")).join(seen, "key", "left_anti").select("key", F.lit(scene).alias("scene"), "sum", F.lit(0).cast("long").alias("n"))
    found = leave_one_out(own.select("key", "scene", "sum", "n").unionByName(empty), min_count=min_count)
    return found.where((F.col("scene") == scene) & F.col("prototype").isNotNull()).select("key", "n", "prototype")


def merged_reviews(*sources: DataFrame) -> DataFrame:
    """Rows (left_sha, right_sha, decision, ...) of several reviews: of those of a pair, either way round, that of the last source counts, and in a source that of the last ``position``."""
    whole = None
    for i, df in enumerate(sources):
        own = df.withColumn("__source", F.lit(i))
        whole = own if whole is None else whole.unionByName(own, allowMissingColumns=True)
    columns = [c for c in whole.columns if c not in ("__source", "position")]
    kept = whole.groupBy(F.least("left_sha", "right_sha").alias("__a"), F.greatest("left_sha", "right_sha").alias("__b")).agg(F.max_by(F.struct(*columns), F.struct("__source", "position")).alias("r"))
    return kept.select("r.*")


def semantic_unions(pairs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows (left_sha, right_sha, decision, evidence) of geometrically strong pairs (left_image, right_image, strong, and measures), by the contents of both images. An image that the manifest lacks is an error."""
    sha = lambda side: manifest.select(F.col("image").alias(f"{side}_image"), F.col("image_sha256").alias(f"{side}_sha"))
    strong = pairs.where("strong").join(sha("left"), "left_image", "left").join(sha("right"), "right_image", "left")
    strong = require(strong, left=F.col("left_sha").isNotNull(), right=F.col("right_sha").isNotNull())
    measures = [c for c in pairs.columns if c not in ("left_image", "right_image", "strong")]
    return strong.select("left_sha", "right_sha", F.lit("same_scene_union").alias("decision"), F.struct(*measures).alias("evidence"))


def approved(candidates: DataFrame, reviewed: DataFrame, keys: tuple[str, ...] = ("candidate_sha256", "rows")) -> DataFrame:
    """``candidates`` (one row for each manifest, with ``id``) marked as approved where their summary agrees in every key; any that doesn't is an error."""
    both = candidates.join(reviewed.select("id", *[F.col(k).alias(f"__{k}") for k in keys]), "id", "left")
    return require(both, **{k: F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys}).drop(*[f"__{k}" for k in keys]).withColumn("approved", F.lit(True))


def from_tiles(detections: DataFrame) -> DataFrame:
    """Detections of tiles in the coordinates of their images: moved by the tile's place (tile_x, tile_y), cut at the image's sides (width, height), and dropped where nothing is left."""
    moved = lambda c, by, side: F.greatest(F.lit(0.0), F.least(F.col(side).cast("double"), F.col("box")[c] + F.col(by)))
    box = F.struct(*[moved(c, f"tile_{c[0]}", "width" if c[0] == "x" else "height").alias(c) for c in ("x1", "y1", "x2", "y2")])
    return detections.withColumn("box", box).where((F.col("box.x2") > F.col("box.x1")) & (F.col("box.y2") > F.col("box.y1")))


def merged_tiles(detections: DataFrame, iou: float = 0.5, by: str = "grp") -> DataFrame:
    """Detections of whole images from those of their tiles: put in place, then each group's overlapping ones suppressed by score."""
    return suppressed(from_tiles(detections), iou, by)


def context_window(box: Column, factor: float, width: Column, height: Column) -> Column:
    """The square about a box, ``factor`` times its longer side, cut at the image's sides; whole pixels."""
    half = F.greatest(box["x2"] - box["x1"], box["y2"] - box["y1"]) * factor / 2
    x, y = (box["x1"] + box["x2"]) / 2, (box["y1"] + box["y2"]) / 2
    low = lambda c: F.greatest(F.lit(0), F.floor(c - half)).cast("int")
    high = lambda c, side: F.least(side.cast("int"), F.ceil(c + half).cast("int"))
    return F.struct(low(x).alias("x1"), low(y).alias("y1"), high(x, width).alias("x2"), high(y, height).alias("y2"))


def duplicate_report(labels: DataFrame) -> DataFrame:
    """Rows (image, lines, kept, removed, fixed): each label file with repeated lines, how many it has, and its text without the repeats, in order. Blank lines go, white space within a line counts as one blank."""
    row = F.trim(F.regexp_replace("row", r"\s+", " "))
    firsts = labels.where(F.trim("row") != "").groupBy("image", row.alias("row")).agg(F.min("line_no").alias("line_no"), F.count("*").alias("n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "row"))), lambda x: x["row"]), "\n")
    whole = firsts.groupBy("image").agg(F.sum("n").alias("lines"), F.count("*").alias("kept"), text.alias("fixed"))
    return whole.where("lines > kept").select("image", "lines", "kept", (F.col("lines") - F.col("kept")).alias("removed"), F.concat("fixed", F.lit("\n")).alias("fixed"))

