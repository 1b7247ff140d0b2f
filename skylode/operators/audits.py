"""Leakage and contract audits over manifests and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class ContractError(ValueError):
    """Rows break a rule that the result depends on."""


def require(df: DataFrame, **rules: Column) -> DataFrame:
    """``df`` itself if every rule holds for every row, else an error with the numbers of rows that break each. One aggregate."""
    broken = df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()]).first().asDict()
    if any(broken.values()):
        raise ContractError(f"rows break the contract: { {k: v for k, v in broken.items() if v} }")
    return df


def unique(df: DataFrame, *key: str) -> DataFrame:
    """``df`` itself if no key occurs twice, else an error."""
    twice = df.groupBy(*key).count().where("count > 1")
    if rows := twice.limit(3).collect():
        raise ContractError(f"keys occur more than once, such as {[tuple(r)[:-1] for r in rows]}")
    return df


def split_groups(rows: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Rows (group, splits, n_splits, rows) of groups that lie in more than one split."""
    return (
        rows.where(F.col(group).isNotNull())
        .groupBy(F.col(group).alias("group"))
        .agg(F.array_sort(F.collect_set(split)).alias("s"), F.count("*").alias("rows"))
        .where("size(s) > 1")
        .select("group", F.array_join("s", ";").alias("splits"), F.size("s").cast("long").alias("n_splits"), "rows")
    )


def split_overlap(rows: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Rows (left_split, right_split, shared_groups, left_rows, right_rows) for each pair of splits that share groups. Splits are few, so a group meets itself a bounded number of times."""
    per = rows.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("g"), F.col(split).alias("s")).agg(F.count("*").alias("n"))
    a, b = per.alias("a"), per.alias("b")
    pairs = a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.s") < F.col("b.s")))
    return pairs.groupBy(F.col("a.s").alias("left_split"), F.col("b.s").alias("right_split")).agg(F.count("*").alias("shared_groups"), F.sum("a.n").alias("left_rows"), F.sum("b.n").alias("right_rows"))


def manifest_differences(manifest: DataFrame, found: DataFrame, key: str, value: str) -> DataFrame:
    """Rows (key, problem): missing from what was found, unmanifested, or different in value. One full join."""
    m = manifest.select(F.col(key).alias("key"), F.col(value).alias("mv"), F.lit(True).alias("m"))
    f = found.select(F.col(key).alias("key"), F.col(value).alias("fv"), F.lit(True).alias("f"))
    problem = F.when(F.col("f").isNull(), "missing").when(F.col("m").isNull(), "unmanifested").when(~F.col("mv").eqNullSafe(F.col("fv")), "different")
    return m.join(f, "key", "full").select("key", problem.alias("problem")).where("problem is not null")


def reviewed(pairs: DataFrame, reviews: DataFrame, left: str = "left_id", right: str = "right_id") -> DataFrame:
    """``pairs`` with the ``decision`` of their review, unresolved without one. The key is unordered, and of several reviews the last (by ``position``) counts."""
    key = lambda: [F.least(left, right).alias("ka"), F.greatest(left, right).alias("kb")]
    last = reviews.select(*key(), "decision", "position").groupBy("ka", "kb").agg(F.max_by("decision", "position").alias("decision"))
    return pairs.select("*", *key()).join(last, ["ka", "kb"], "left").withColumn("decision", F.coalesce("decision", F.lit("unresolved"))).drop("ka", "kb")


def review_states(candidates: DataFrame, reviews: DataFrame, allowed: tuple[str, ...] = ("same_scene", "different_scene")) -> DataFrame:
    """Rows (state, rows): how many candidates and reviews are confirmed, unreviewed, unknown, duplicate or invalid. Both have ``id``."""
    r = reviews.groupBy("id").agg(F.count("*").alias("n"), F.max("decision").alias("decision"))
    both = candidates.select("id", F.lit(True).alias("c")).join(r, "id", "full")
    state = F.when(F.col("c").isNull(), "unknown").when(F.col("n").isNull(), "unreviewed").when(F.col("n") > 1, "duplicate").when(~F.col("decision").isin(*allowed), "invalid").otherwise(F.col("decision"))
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("rows"))


def coverage(expected: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    """Rows (key, times) of expected keys not covered exactly once, and of covered ones not expected."""
    c = covered.groupBy(key).agg(F.count("*").alias("times"))
    both = expected.select(key, F.lit(True).alias("e")).join(c, key, "full")
    return both.where("e is null or coalesce(times, 0) != 1").select(F.col(key).alias("key"), F.coalesce("times", F.lit(0)).cast("long").alias("times"))


def duplicate_label_rows(labels: DataFrame) -> DataFrame:
    """Rows (image, row, times, lines): texts of label lines that occur more than once in an image, white space being equal."""
    row = F.trim(F.regexp_replace("row", r"\s+", " "))
    return (
        labels.where(F.trim("row") != "")
        .groupBy("image", row.alias("row"))
        .agg(F.count("*").alias("times"), F.array_sort(F.collect_list("line_no")).alias("l"))
        .where("times > 1")
        .select("image", "row", "times", F.array_join(F.transform("l", lambda x: x.cast("string")), ",").alias("lines"))
    )


def first_labels(labels: DataFrame, exact_text: bool = True) -> DataFrame:
    """The first of equal label lines of each image: equal by text, or with ``exact_text`` off by class and single-precision values."""
    if exact_text:
        key = [F.trim(F.regexp_replace("row", r"\s+", " "))]
    else:
        parts = F.split(F.trim("row"), r"\s+")
        key = [F.transform(F.slice(parts, 1, 5), lambda x: x.cast("float"))]
    w = Window.partitionBy("image", *key).orderBy("line_no")
    return labels.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def class_distribution(rows: DataFrame, split: str, cls: str, splits: list[str]) -> DataFrame:
    """Rows (class, one column for each split, total)."""
    wide = rows.groupBy(F.col(cls).alias("class")).pivot(split, splits).agg(F.count(F.lit(1))).na.fill(0)
    total = F.lit(0).cast("long")
    for s in splits:
        total = total + F.col(f"`{s}`")
    return wide.withColumn("total", total)


def fraction_gaps(rows: DataFrame, split: str, flags: list[str]) -> DataFrame:
    """Rows (flag, gap): over the splits, the largest share of rows with a flag less the smallest."""
    per = rows.groupBy(split).agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in flags])
    whole = per.agg(*[(F.max(f) - F.min(f)).alias(f) for f in flags])
    return whole.select(F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("gap")) for f in flags])).alias("x")).select("x.*")
