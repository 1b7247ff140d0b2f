"""Paths, identifiers, addresses and times as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What an identifier may be made of, and characters with a meaning in HTML.
SAFE = "^[A-Za-z0-9._-]+$"
HTML = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))


def relative_image(split: Column, image: Column) -> Column:
    return F.concat_ws("/", F.lit("images"), split, image)


def relative_label(split: Column, label: Column) -> Column:
    return F.concat_ws("/", F.lit("labels"), split, label)


def label_of(image: Column, images: str, labels: str) -> Column:
    """The label file of an image below ``images``: the same place below ``labels``, ending in .txt. Null for an image elsewhere."""
    root = images.rstrip("/") + "/"
    below = F.when(F.startswith(image, F.lit(root)), F.substr(image, F.lit(len(root) + 1)))
    return F.concat(F.lit(labels.rstrip("/") + "/"), F.regexp_replace(below, r"(?<=[^/])\.[^./]*$", ""), F.lit(".txt"))


def image_key(path: Column) -> Column:
    """The name of a cached entry: SHA-1 of the absolute path in lower case."""
    return F.sha1(F.lower(path))


def below_train(path: Column) -> Column:
    """What follows images/train/ in a path with either kind of slash, null where that isn't in it."""
    found = F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), "(?:^|.*/)images/train/(.+)$", 1)
    return F.when(found != "", found)


def safe_id(value: Column) -> Column:
    """A trimmed identifier, null if it is empty or has other characters than letters, digits, dots, lines and hyphens."""
    text = F.trim(value)
    return F.when(text.rlike(SAFE), text)


def namespace(dataset_id: Column, fingerprint: Column) -> Column:
    """The folder name of what is made from a dataset: its identifier and twelve digits of its fingerprint; null without one."""
    return F.concat(safe_id(dataset_id), F.lit("__"), F.substring(fingerprint, 1, 12))


def run_folder(root: str, experiment: Column, space: Column) -> Column:
    """A run's folder below its dataset's namespace, or below the root without one; null for an unsafe name, and for dots that lead upwards."""
    name = F.when(~experiment.isin(".", ".."), safe_id(experiment))
    return F.when(name.isNotNull(), F.concat_ws("/", F.lit(root), space, name))


def split_and_image(label: Column, suffix: str = ".jpg") -> Column:
    """Struct (split, image) of a label file's path labels/split/name.txt; the image is taken to end in ``suffix``."""
    parts = F.split(F.replace(label, F.lit("\\"), F.lit("/")), "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    return F.struct(F.try_element_at(parts, F.lit(-2)).alias("split"), F.concat(stem, F.lit(suffix)).alias("image"))


def data_uri(content: Column, kind: str = "image/jpeg") -> Column:
    """Bytes as an address that holds them."""
    return F.concat(F.lit(f"data:{kind};base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


def escaped(text: Column) -> Column:
    """Text whose characters mean nothing in HTML."""
    for plain, written in HTML:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def utc_now() -> Column:
    """The time of the query in UTC as ISO text, to the second."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def seconds_between(begin: Column, end: Column) -> Column:
    """Seconds between two ISO times with a zone."""
    return (F.unix_micros(F.to_timestamp(end)) - F.unix_micros(F.to_timestamp(begin))) / 1e6
