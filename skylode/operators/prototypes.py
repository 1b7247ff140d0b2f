"""Class prototypes that leave a scene out, confusion and temperature reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylode.functions.numbers import entropy, margin, softmax, unit

CONFIDENCE, MARGIN = 0.70, 0.10


def gate(logits: Column, coarse_ok: Column) -> Column:
    """The first rule that a teacher's signal fails, null for one that counts."""
    p = softmax(logits)
    return F.when(F.array_max(p) < CONFIDENCE, "low_confidence").when(margin(p) < MARGIN, "low_margin").when(~F.coalesce(coarse_ok, F.lit(False)), "wrong_coarse")


def vector_sums(rows: DataFrame, *key: str, vector: str = "embedding") -> DataFrame:
    """Rows (key, sum, n): unit vectors summed by component. Components are the grouping's rows, so sums combine in the map side and no group is gathered."""
    each = rows.where(F.col(vector).isNotNull()).select(*key, F.posexplode(unit(F.col(vector))).alias("i", "x"))
    parts = each.groupBy(*key, "i").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    # A group has as many rows here as a vector has components.
    return parts.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("sum"), F.max("n").alias("n"))


def leave_one_out(sums: DataFrame, key: str = "key", scene: str = "scene", min_count: int = 2) -> DataFrame:
    """Rows (key, scene, n, prototype) from the sums of each (key, scene): the unit mean of all other scenes, null if fewer than ``min_count`` vectors are left."""
    each = sums.select(key, F.posexplode("sum").alias("i", "x"), "n")
    whole = each.groupBy(key, "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("all_sum"), F.max("n").alias("all_n"))
    both = sums.join(whole, key)
    left = F.col("all_n") - F.col("n")
    rest = F.zip_with("all_sum", "sum", lambda a, b: a - b)
    return both.select(key, scene, left.alias("n"), F.when(left >= min_count, unit(rest)).alias("prototype"))


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Rows (truth, predicted, n, share of the truth's rows)."""
    cells = rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    whole = cells.groupBy("truth").agg(F.sum("n").alias("t"))
    return cells.join(whole, "truth").select("truth", "predicted", "n", (F.col("n") / F.col("t")).alias("share"))


def temperature_profile(rows: DataFrame, logits: str, truth: str, temperatures: list[float]) -> DataFrame:
    """Rows (temperature, n, mean_confidence, mean_entropy, mean_margin, accuracy) of softmax values at each temperature."""
    each = None
    for t in temperatures:
        p = softmax(F.col(logits), t)
        one = rows.where(F.col(logits).isNotNull()).select(F.lit(t).alias("temperature"), p.alias("p"), F.col(truth).alias("y"))
        each = one if each is None else each.unionByName(one)
    right = (F.array_position("p", F.array_max("p")) - 1 == F.col("y")).cast("double")
    return each.groupBy("temperature").agg(
        F.count("*").alias("n"), F.avg(F.array_max("p")).alias("mean_confidence"), F.avg(entropy(F.col("p"))).alias("mean_entropy"), F.avg(margin(F.col("p"))).alias("mean_margin"), F.avg(right).alias("accuracy")
    )
