"""Identities that file names carry, and packed text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRIP = r"(?i)^(\d{2}-PAN-\d{8}-\d+)-\d+-L\d+"
_PRODUCT = r"(?i)^(\d{2}-PAN-\d{8}-\d+-\d+-L\d+)-CCD"
_SITE = r"(?i)^([EW])(\d+(?:\.\d+)?)_([NS])(\d+(?:\.\d+)?)_\d{8}_L1A\d+"
_L1A = r"(?i)^([EW]\d+(?:\.\d+)?_[NS]\d+(?:\.\d+)?_\d{8}_L1A\d+)-PAN\d+"
_FSC = r"(?i)-([NS]\d+(?:\.\d+)?)-([EW]\d+(?:\.\d+)?)"


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def folded(text: Column) -> Column:
    """Lower case with sharp s written out, for comparisons."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def entry_split(path: Column, kind: str = "images") -> Column:
    """train, val or test of an archive entry, else null."""
    return F.nullif(F.lower(F.regexp_extract(path, rf"(?i)(?:^|/){kind}/(train|val|test)/[^/]+$", 1)), F.lit(""))


def _part(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, pattern, group)


def strict_scene(path: Column) -> Column:
    """The strongest source scene in an official file name."""
    s = stem(path)
    return (
        F.when(s.rlike(_PRODUCT), F.concat(F.lit("satellite:"), _part(s, _PRODUCT)))
        .when(s.rlike(_L1A), F.concat(F.lit("l1a:"), _part(s, _L1A)))
        .when(F.lower(s).startswith("fsc_") & s.rlike(_FSC), F.concat(F.lit("fsc:"), F.upper(_part(s, _FSC)), F.lit(":"), F.upper(_part(s, _FSC, 2))))
        .when(F.upper(s).startswith("MAR20_"), F.concat(F.lit("mar20:"), s))
        .when(s.rlike(r"(?i)_crop\d+$"), F.regexp_replace(s, r"(?i)(?:-CCD\d+_\d+)?_crop\d+$", ""))
        .otherwise(s)
    )


def conservative_scene(path: Column) -> Column:
    """Strip or one-degree site of an official file name, else its strict scene. Degrees round half to even."""
    s = stem(path)

    def degree(sign: int, value: int, negative: str, width: int) -> Column:
        number = F.bround(_part(s, _SITE, value).try_cast("double"), 0).cast("int")
        return F.format_string(f"%+0{width}d", F.when(F.upper(_part(s, _SITE, sign)) == negative, -number).otherwise(number))

    return (
        F.when(s.rlike(_STRIP), F.concat(F.lit("pan_strip:"), F.upper(_part(s, _STRIP))))
        .when(s.rlike(_SITE), F.concat(F.lit("geo_site:"), degree(1, 2, "W", 4), F.lit(":"), degree(3, 4, "S", 3)))
        .otherwise(strict_scene(path))
    )


def source_family(scene: Column, path: Column) -> Column:
    return (
        F.when(scene.startswith("satellite:") | scene.startswith("pan_strip:"), "official_pan_l_product")
        .when(scene.startswith("l1a:") | scene.startswith("geo_site:"), "official_coordinate_l1a")
        .when(scene.startswith("fsc:"), "official_fsc_location")
        .when(F.upper(basename(path)).startswith("MAR20_"), "official_mar20")
        .otherwise("official_other")
    )


def added_scene(path: Column) -> Column:
    """Struct (scene, family) of an added file name."""
    s = stem(path)
    numeric, sequence, page = r"^(\d+_\d+_\d+)_\d+$", r"(?i)^((?:AU|RU)(?:AU|RU)\d{2})\d+$", r"(?i)^P\d+(?:\s*\(\d+\))?$"
    scene = (
        F.when(s.rlike(numeric), F.concat(F.lit("added_numeric:"), _part(s, numeric)))
        .when(s.rlike(sequence), F.concat(F.lit("added_sequence:"), F.upper(_part(s, sequence))))
        .when(s.rlike(page), F.concat(F.lit("added_p:"), F.upper(F.regexp_replace(s, r"\s*\(\d+\)$", ""))))
        .otherwise(F.concat(F.lit("added_single:"), s))
    )
    family = F.when(s.rlike(numeric), "added_numeric_ship").when(s.rlike(sequence), "added_au_ru_launcher").when(s.rlike(page), "added_p_ship").otherwise("added_other")
    return F.struct(scene.alias("scene"), family.alias("family"))


def added_key(path: Column) -> Column:
    """The older grouping of added file names."""
    s = stem(path)
    numeric, sequence = r"^(\d+_\d+_\d+)_\d+$", r"^([A-Za-z]+)(\d{2})\d+$"
    return (
        F.when(s.rlike(numeric), F.concat(F.lit("numeric:"), _part(s, numeric)))
        .when(s.rlike(sequence), F.concat(F.lit("sequence:"), F.upper(_part(s, sequence)), _part(s, sequence, 2)))
        .otherwise(F.concat(F.lit("single:"), s))
    )


def crop_identities(path: Column) -> Column:
    """Struct (scene, product): the crop's parent, and the product it was cut from."""
    scene = F.regexp_replace(stem(path), r"(?i)_crop\d+$", "")
    product = F.regexp_replace(F.regexp_replace(scene, r"(?i)-CCD\d+_\d+$", ""), r"(?i)-PAN\d+$", "")
    return F.struct(scene.alias("scene"), product.alias("product"))


def derived_scene(path: Column) -> Column:
    """An L number of eleven digits if there is one, else the product, else the scene."""
    number = F.upper(F.regexp_extract(stem(path), r"(?i)L\d{11}", 0))
    both = crop_identities(path)
    return F.coalesce(F.nullif(number, F.lit("")), F.nullif(both["product"], F.lit("")), both["scene"])


def scene_family(scene: Column) -> Column:
    parts = F.split(scene, "_")
    numbers = parts[0].rlike(r"^\d+$") & F.coalesce(F.try_element_at(parts, F.lit(2)).rlike(r"^\d+$"), F.lit(False))
    return (
        F.when(scene.rlike(r"L\d{5,}"), "L-number")
        .when(F.substring(scene, 1, 4).isin("AUAU", "AUJP", "LQSP"), F.concat(F.substring(scene, 1, 4), F.lit("*")))
        .when(numbers, F.concat(parts[0], F.lit("_"), F.try_element_at(parts, F.lit(2)), F.lit("_*")))
        .otherwise(F.concat(F.lit("other:"), F.substring(parts[0], 1, 16)))
    )


def packed(counts: Column) -> Column:
    """A map of counts as ``k:v;k:v``, keys sorted, zeros dropped."""
    kept = F.array_sort(F.filter(F.map_entries(counts), lambda e: e["value"] != 0))
    return F.array_join(F.transform(kept, lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ";")


def unpacked(text: Column) -> Column:
    """``k:v;k:v`` as a map of counts; empty text is an empty map."""
    pairs = F.filter(F.split(F.coalesce(text, F.lit("")), ";"), lambda p: p != "")
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.substring_index(p, ":", 1), F.substring_index(p, ":", -1).cast("long"))))


def source_metadata(path: Column, scene: Column) -> Column:
    """Struct (family, product, date, x, y, lon, lat, sequence) of a file name; what a family lacks is null."""
    s = stem(path)
    pan = r"(?i)^(\d{2})-PAN-(\d{8})-(\d+)-(\d+)-(L\d+)-CCD"
    site = r"(?i)^([EW])(\d+(?:\.\d+)?)_([NS])(\d+(?:\.\d+)?)_(\d{8})_(L1A\d+)-PAN"
    fsc, mar = r"(?i)-([NS])(\d+(?:\.\d+)?)-([EW])(\d+(?:\.\d+)?)", r"(?i)^MAR20_(\d+)$"
    is_pan, is_site, is_mar = s.rlike(pan), s.rlike(site), s.rlike(mar)
    is_fsc = F.lower(s).startswith("fsc_") & s.rlike(fsc)
    degree = lambda p, sign, value, minus: _part(s, p, value).try_cast("double") * F.when(F.upper(_part(s, p, sign)) == minus, -1).otherwise(1)
    return F.struct(
        F.when(is_pan, "pan_l_product").when(is_site, "coordinate_l1a").when(is_fsc, "fsc_location").when(is_mar, "mar20").otherwise("other").alias("family"),
        F.when(is_pan, F.concat(_part(s, pan), F.lit(":"), _part(s, pan, 5))).when(is_site, F.upper(_part(s, site, 6))).otherwise(scene).alias("product"),
        F.when(is_pan, _part(s, pan, 2)).when(is_site, _part(s, site, 5)).alias("date"),
        F.when(is_pan, _part(s, pan, 3).try_cast("int")).alias("x"),
        F.when(is_pan, _part(s, pan, 4).try_cast("int")).alias("y"),
        F.when(is_site, degree(site, 1, 2, "W")).when(is_fsc & ~is_pan, degree(fsc, 3, 4, "W")).alias("lon"),
        F.when(is_site, degree(site, 3, 4, "S")).when(is_fsc & ~is_pan, degree(fsc, 1, 2, "S")).alias("lat"),
        F.when(is_mar, _part(s, mar).try_cast("int")).alias("sequence"),
    )


def metadata_relation(a: Column, b: Column) -> Column:
    """Struct (same_product, nearby, reason) of two :func:`source_metadata` values."""
    far = F.hypot(a["lat"] - b["lat"], a["lon"] - b["lon"])
    grid = (a["date"] == b["date"]) & (F.abs(a["x"] - b["x"]) <= 1) & (F.abs(a["y"] - b["y"]) <= 1)
    step = F.abs(a["sequence"] - b["sequence"])
    family = F.when(a["family"] == b["family"], a["family"])
    nearby = (
        F.when(family == "pan_l_product", grid)
        .when(family == "coordinate_l1a", far <= 0.25)
        .when(family == "fsc_location", far <= 0.05)
        .when(family == "mar20", step <= 2)
    )
    nearby = F.coalesce(nearby, F.lit(False))
    reason = (
        F.when(family.isNull(), "different_family")
        .when(~nearby, "")
        .when(family == "pan_l_product", "same_date_adjacent_grid")
        .when(family == "mar20", F.format_string("sequence_delta=%d", step))
        .otherwise(F.format_string("coordinate_distance_deg=%.4f", far))
    )
    return F.struct(a["product"].eqNullSafe(b["product"]).alias("same_product"), nearby.alias("nearby"), reason.alias("reason"))
