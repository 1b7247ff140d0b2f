"""Boxes: overlap, conversions, size and position classes, the class hierarchy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The competition's overlap thresholds, and squared side lengths that part small, medium and large.
IOU_VEHICLE, IOU_OTHER = 0.35, 0.50
THRESHOLDS = {"ship": IOU_OTHER, "aircraft": IOU_OTHER, "vehicle": IOU_VEHICLE}
SMALL, MEDIUM = 32.0**2, 96.0**2
EDGE_FRACTION = 0.02
CROWD_FACTOR = 2.0


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def coarse_group(fine: Column | str) -> Column:
    """0-3 ship, 4-23 aircraft, 24 vehicle; anything else null."""
    fine = _c(fine)
    return F.when(fine.between(0, 3), "ship").when(fine.between(4, 23), "aircraft").when(fine == 24, "vehicle")


def iou_threshold(group: Column | str) -> Column:
    return F.when(_c(group) == "vehicle", F.lit(IOU_VEHICLE)).otherwise(F.lit(IOU_OTHER))


def area(b: Column) -> Column:
    return F.greatest(b["x2"] - b["x1"], F.lit(0.0)) * F.greatest(b["y2"] - b["y1"], F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two corner structs; the denominator is 1e-9 at least."""
    both = intersection(a, b)
    return both / F.greatest(area(a) + area(b) - both, F.lit(1e-9))


def corners(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Normalised centre and size to pixel corners."""
    return F.struct(((x - w / 2) * width).alias("x1"), ((y - h / 2) * height).alias("y1"), ((x + w / 2) * width).alias("x2"), ((y + h / 2) * height).alias("y2"))


def centred(b: Column, width: Column, height: Column) -> Column:
    """Pixel corners to normalised centre and size."""
    return F.struct(((b["x1"] + b["x2"]) / 2 / width).alias("x"), ((b["y1"] + b["y2"]) / 2 / height).alias("y"), ((b["x2"] - b["x1"]) / width).alias("w"), ((b["y2"] - b["y1"]) / height).alias("h"))


def letterbox_scale(width: Column, height: Column, size: int = 640) -> Column:
    return F.least(F.lit(float(size)) / width, F.lit(float(size)) / height)


def letterboxed(b: Column, width: Column, height: Column, size: int = 640) -> Column:
    """Pixel corners scaled and padded into a square, then normalised by it."""
    scale = letterbox_scale(width, height, size)
    left, top = (F.lit(size) - width * scale) / 2, (F.lit(size) - height * scale) / 2
    moved = F.struct((b["x1"] * scale + left).alias("x1"), (b["y1"] * scale + top).alias("y1"), (b["x2"] * scale + left).alias("x2"), (b["y2"] * scale + top).alias("y2"))
    return centred(moved, F.lit(float(size)), F.lit(float(size)))


def size_bucket(pixels: Column) -> Column:
    """small, medium or large by area after letterboxing."""
    return F.when(pixels < SMALL, "small").when(pixels < MEDIUM, "medium").otherwise("large")


def at_edge(b: Column, width: Column, height: Column, fraction: float = EDGE_FRACTION) -> Column:
    """Whether a box comes within this share of any border, the limit included."""
    return (b["x1"] <= width * fraction) | (b["y1"] <= height * fraction) | (b["x2"] >= width * (1 - fraction)) | (b["y2"] >= height * (1 - fraction))


def expanded(b: Column, factor: float, width: Column, height: Column) -> Column:
    """A box scaled about its centre and clipped to the image."""
    cx, cy = (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2
    w, h = (b["x2"] - b["x1"]) * factor / 2, (b["y2"] - b["y1"]) * factor / 2
    zero = F.lit(0.0)
    return F.struct(F.greatest(cx - w, zero).alias("x1"), F.greatest(cy - h, zero).alias("y1"), F.least(cx + w, width).alias("x2"), F.least(cy + h, height).alias("y2"))


def valid_label(fine: Column, x: Column, y: Column, w: Column, h: Column, classes: int = 25) -> Column:
    """A known class, a centre inside the image, and a size over 0 up to 1; false for nulls and non-finite values."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c)
    return F.coalesce(fine.between(0, classes - 1) & finite(x) & finite(y) & finite(w) & finite(h) & x.between(0, 1) & y.between(0, 1) & (w > 0) & (w <= 1) & (h > 0) & (h <= 1), F.lit(False))


def tile_starts(length: Column, tile: int, stride: int) -> Column:
    """Starts of tiles along one side; the last is moved back to the border."""
    last = F.greatest(length - tile, F.lit(0))
    return F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))
