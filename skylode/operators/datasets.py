"""Image tables: balance features, ground truth from labels, components of copies, lookups, hard checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylode.functions import boxes as b
from skylode.operators.audits import require, unique
from skylode.operators.graph import connected_components
from skylode.operators.matching import crowded
from skylode.operators.similarity import hamming_links

#: The distances of review priorities, and the order of error types as references.
P0_BITS, P1_BITS = 0, 1
REFERENCE_ORDER = ("no_candidate", "localization", "low_confidence", "nms_suppressed", "detected")


def ground_truth(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (image, gi, box, fine, grp, width, height) of valid labels in pixels; images have (image, width, height). Duplicates are the caller's to drop."""
    ok = labels.where(b.valid_label(*[F.col(c) for c in ("fine", "x", "y", "w", "h")]))
    order = Window.partitionBy("image").orderBy("line_no")
    box = b.corners(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("width"), F.col("height"))
    rows = ok.withColumn("gi", (F.row_number().over(order) - 1).cast("long")).join(images.select("image", "width", "height"), "image")
    return rows.select("image", "gi", box.alias("box"), "fine", b.coarse_group("fine").alias("grp"), "width", "height")


def balance_features(images: DataFrame, gt: DataFrame, size: int = 640) -> DataFrame:
    """Rows (image, feature, n): each image's counts of itself, its family, classes, groups, sizes, crowded and edge boxes; without boxes it is a background."""
    box, w, h = F.col("box"), F.col("width").cast("double"), F.col("height").cast("double")
    scaled = b.area(box) * F.pow(b.letterbox_scale(w, h, size), 2)
    flags = gt.join(crowded(gt), ["image", "gi"])
    names = F.array_compact(
        F.array(
            F.concat(F.lit("fine:"), "fine"),
            F.concat(F.lit("coarse:"), "grp"),
            F.concat(F.lit("size:"), b.size_bucket(scaled)),
            F.when(F.col("crowded"), "crowded_instances"),
            F.when(b.at_edge(box, w, h), "edge_instances"),
        )
    )
    of_boxes = flags.select("image", F.explode(names).alias("feature"))
    of_images = images.select("image", F.explode(F.array(F.lit("images"), F.concat(F.lit("family:"), "family"))).alias("feature"))
    empty = images.select("image").join(gt.select("image"), "image", "left_anti").select("image", F.lit("background_images").alias("feature"))
    return of_images.unionByName(of_boxes).unionByName(empty).groupBy("image", "feature").agg(F.count("*").alias("n"))


def split_report(images: DataFrame, gt: DataFrame) -> DataFrame:
    """Rows (split, images, background, instances, scenes, families, most_crops) of each split."""
    per = images.join(gt.groupBy("image").agg(F.count("*").alias("boxes")), "image", "left").na.fill(0, ["boxes"])
    crops = images.groupBy("split", "scene").agg(F.count("*").alias("crops")).groupBy("split").agg(F.max("crops").alias("most_crops"), F.count("*").alias("scenes"))
    own = per.groupBy("split").agg(F.count("*").alias("images"), F.count_if(F.col("boxes") == 0).alias("background"), F.sum("boxes").alias("instances"), F.countDistinct("family").alias("families"))
    return own.join(crops, "split")


def copy_components(rows: DataFrame, distance: int = 2, unions: DataFrame | None = None) -> DataFrame:
    """Rows (id, component) of all rows (id, sha, phash): linked by equal content, by near perceptual hashes, and by reviewed unions (left_id, right_id). A component's name is its smallest id."""
    by_sha = rows.where("sha is not null").groupBy("sha").agg(F.min("id").alias("u"))
    equal = rows.join(by_sha, "sha").where("id != u").select("u", F.col("id").alias("v"))
    near = hamming_links(rows, distance, "phash")
    links = equal.unionByName(near)
    if unions is not None:
        links = links.unionByName(unions.select(F.col("left_id").alias("u"), F.col("right_id").alias("v")))
    labels = connected_components(links)
    return rows.select("id").join(labels, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("component"))


def review_priority() -> Column:
    """p0 for equal hashes, p1 for nearly equal ones in different splits, else rest; over the columns distance, left_split, right_split."""
    return F.when(F.col("distance") <= P0_BITS, "p0").when((F.col("left_split") != F.col("right_split")) & (F.col("distance") <= P1_BITS), "p1").otherwise("rest")


def object_lookup(wanted: DataFrame, objects: DataFrame, floor: float = 0.999) -> DataFrame:
    """Rows (image, gi, found_gi, how): the manifest object of each wanted (image, gi, fine, box).

    The same index and class if the boxes agree, else the best overlap in the class, else the class's only object; without any of
    them found_gi is null. Objects are matched inside an image.
    """
    o = objects.select("image", F.col("gi").alias("ogi"), F.col("fine").alias("ofine"), F.col("box").alias("obox"))
    pairs = wanted.join(o, "image").where("fine = ofine").withColumn("iou", b.iou(F.col("box"), F.col("obox")))
    best = F.max_by("ogi", F.struct("iou", (-F.col("ogi")).alias("g")))
    got = pairs.groupBy("image", "gi").agg(F.max((F.col("gi") == F.col("ogi")) & (F.col("iou") >= floor)).alias("direct"), F.max("iou").alias("iou"), best.alias("best"), F.count("*").alias("n"))
    how = F.when(F.col("direct"), "index").when(F.col("iou") >= floor, "overlap").when(F.col("n") == 1, "only")
    found = F.when(F.col("direct"), F.col("gi")).when((F.col("iou") >= floor) | (F.col("n") == 1), F.col("best"))
    return wanted.select("image", "gi").join(got, ["image", "gi"], "left").select("image", "gi", found.alias("found_gi"), how.alias("how"))


def scene_of(images: DataFrame, scenes: DataFrame) -> DataFrame:
    """``images`` (image, name) with the scene of the same image, else of the only image of that name."""
    exact = scenes.select("image", F.col("scene").alias("exact"))
    only = scenes.groupBy("name").agg(F.count("*").alias("n"), F.max("scene").alias("by_name")).where("n = 1").drop("n")
    return images.join(exact, "image", "left").join(only, "name", "left").select("image", "name", F.coalesce("exact", "by_name").alias("scene"))


def remapped(index: DataFrame, cache: DataFrame) -> DataFrame:
    """A new index (position, sha) with the cached values (sha, value) of the same contents; each content is cached once, and the two sets are equal or it is an error."""
    both = index.join(unique(cache, "sha").withColumn("__c", F.lit(True)), "sha", "full")
    return require(both, same=F.col("position").isNotNull() & F.col("__c").isNotNull()).drop("__c")


def not_truncated(predictions: DataFrame, most: int) -> DataFrame:
    """``predictions`` if no image has the cap's number of detections."""
    each = predictions.groupBy("image").agg(F.count("*").alias("n"))
    require(each, below_cap=F.col("n") < most)
    return predictions


def references(rows: DataFrame, maximum: int, per_product: int = 3) -> list[tuple[str, int]]:
    """(image, gi) of diverse examples: three quarters hard ones, then clear ones, then hard ones again; one of an image, few of a product.

    The choice is sequential, so it runs on the driver; but only the best of each image and of each product's images can be
    chosen, so no more than a bounded number of candidates is gathered.
    """
    rank = reduce(lambda c, x: F.when(F.col("error") == x[1], x[0]).otherwise(c), enumerate(REFERENCE_ORDER), F.lit(len(REFERENCE_ORDER)))
    score = F.coalesce("score", F.lit(0.0))
    hard = F.col("error") != "detected"
    key = F.when(hard, F.struct(rank.cast("double").alias("a"), score.alias("b"), "image", "gi")).otherwise(F.struct(F.lit(9.0).alias("a"), (-score).alias("b"), F.col("image"), F.col("gi")))
    own = rows.withColumn("hard", hard).withColumn("key", key)
    one = own.withColumn("n", F.row_number().over(Window.partitionBy("image", "hard").orderBy("key"))).where("n = 1")
    some = one.withColumn("n", F.row_number().over(Window.partitionBy("product", "hard").orderBy("key"))).where(F.col("n") <= 2 * per_product)
    # At most as many as could be needed of either kind.
    top = some.withColumn("n", F.row_number().over(Window.partitionBy("hard").orderBy("key"))).where(F.col("n") <= 8 * maximum)
    pool = sorted(top.select("hard", "key", "image", "gi", "product").collect(), key=lambda r: r["key"])
    chosen, images, products = [], {}, {}

    def take(some_: list, limit: int) -> None:
        for r in some_:
            if len(chosen) >= limit:
                return
            if images.get(r["image"], 0) < 1 and products.get(r["product"], 0) < per_product:
                chosen.append((r["image"], r["gi"]))
                images[r["image"]] = 1
                products[r["product"]] = products.get(r["product"], 0) + 1

    take([r for r in pool if r["hard"]], maximum - max(1, maximum // 4))
    take([r for r in pool if not r["hard"]], maximum)
    take([r for r in pool if r["hard"]], maximum)
    return chosen


def checklist(**checks: DataFrame) -> dict[str, bool]:
    """Each check's name, and whether its table of problems is empty; ``training_ready`` if all are."""
    out = {name: df.isEmpty() for name, df in checks.items()}
    return out | {"training_ready": all(out.values())}
