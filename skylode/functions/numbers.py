"""Rates, vectors, distributions and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def rates(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """false_alarm_rate, precision, recall and f1. Without predictions precision is 1."""
    alarm = fp / F.greatest(fp + tp, F.lit(1))
    recall = tp / F.greatest(tp + fn, F.lit(1))
    precision = F.lit(1.0) - alarm
    return {"false_alarm_rate": alarm, "precision": precision, "recall": recall, "f1": F.lit(2.0) * precision * recall / F.greatest(precision + recall, F.lit(1e-12))}


def grid(start: float, stop: float, step: float) -> list[float]:
    """An inclusive grid, rounded to 10 places."""
    if step <= 0 or stop < start:
        raise ValueError("the grid needs a step over 0 and a stop not before its start")
    return [round(start + i * step, 10) for i in range(int((stop - start) / step + 1e-9) + 1)]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def length(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (length(a) * length(b))


def unit(v: Column) -> Column:
    """A vector over its length, or itself if that is 0."""
    n = length(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def softmax(v: Column, temperature: float = 1.0) -> Column:
    top = F.array_max(v)
    weights = F.transform(v, lambda x: F.exp((x - top).cast("double") / temperature))
    return F.transform(weights, lambda x: x / F.aggregate(weights, F.lit(0.0), lambda s, y: s + y))


def entropy(p: Column) -> Column:
    """Entropy over the logarithm of the number of classes."""
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + F.when(x > 0, x * F.log(x)).otherwise(0.0))
    return F.when(F.size(p) > 1, -total / F.log(F.size(p).cast("double"))).otherwise(0.0)


def margin(p: Column) -> Column:
    """The largest value less the second largest."""
    ordered = F.sort_array(p, asc=False)
    return ordered[0] - F.coalesce(F.try_element_at(ordered, F.lit(2)), F.lit(0.0))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hex16(x: Column) -> Column:
    return F.lpad(F.lower(F.hex(x)), 16, "0")


def canonical(**fields: Column) -> Column:
    """JSON text with sorted keys, nulls kept and no blanks; for strings, integers, booleans and what nests them."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def is_digest(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]{64}$"), F.lit(False))
