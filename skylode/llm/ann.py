"""Nearest neighbours by inner product: inverted lists scanned by adaptive dimensions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylode.llm.common import map_arrow
from skylode.runtime import cut

#: Vectors that centroids and the rotation are fitted on, at most.
SAMPLE = 20_000
#: Columns of a block, and the standard errors by which an estimate must be over the bound before its candidate is abandoned.
BLOCK, SIGMAS = 16, 2.5
#: Vectors of a list, about; the share of the sample's true neighbours that the probed lists must hold; sample vectors that give queries a first bound.
LIST, SHARE, ANCHORS = 1000, 0.96, 2048
#: Lists that a query scans first, to get a closer bound for the others.
FIRST = 3
#: Rows of a list's part, and of the queries that meet it, in one group.
PART, ASKING = 4096, 2048
TOP = 20


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of vectors without nulls as rows."""
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def inner(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """The inner products of rows with one vector (or with a row each), summed from the first component to the last.

    Elementwise steps in one order, so a pair of vectors has one score wherever and with whatever others it is computed;
    a matrix product rounds by its shape.
    """
    out = np.zeros(len(vectors))
    for i in range(vectors.shape[1]):
        out = out + vectors[:, i] * query[..., i]
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, embedding array<double>) of the vectors that take part: not null or zero, without null or non-finite components."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(v.isNotNull() & (F.size(v) > 0) & fine)


class Model:
    """A random rotation, and centroids in the rotated and augmented space.

    A further component of sqrt(M^2 - |x|^2), zero for queries, makes the order by distance that by
    inner product. M is the largest norm of all vectors.
    """

    def __init__(self, sample: np.ndarray, lists: int, top_norm: float, seed: int = 7, rounds: int = 8):
        random = np.random.default_rng(seed)
        self.top_norm = top_norm
        width = sample.shape[1] + 1
        self.rotation = np.linalg.qr(random.standard_normal((width, width)))[0]
        points = self.rotated(sample)
        lists = max(1, min(lists, len(points)))
        self.centroids = points[random.permutation(len(points))[:lists]]
        for _ in range(rounds):
            near = self.nearest(points, 1)[:, 0]
            sums = np.zeros_like(self.centroids)
            np.add.at(sums, near, points)
            count = np.bincount(near, minlength=lists)
            self.centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], self.centroids)
        self.anchors = sample[:ANCHORS]

    def probes_for(self, sample: np.ndarray, top: int, share: float = SHARE) -> int:
        """Lists that a query must probe to meet this share of its nearest neighbours, as measured inside the sample."""
        home = self.nearest(self.rotated(sample), 1)[:, 0]
        asks = np.linspace(0, len(sample) - 1, min(256, len(sample))).astype(int)
        scores = sample[asks] @ sample.T
        scores[np.arange(len(asks)), asks] = -np.inf
        true = np.argsort(-scores, axis=1, kind="stable")[:, : min(top, len(sample) - 1)]
        order = self.nearest(self.rotated(sample[asks], True), len(self.centroids))
        place = np.argsort(order, axis=1)
        needed = np.sort(np.take_along_axis(place, home[true], 1).ravel())
        return int(needed[min(len(needed) - 1, math.ceil(share * len(needed)) - 1)]) + 1 if len(needed) else 1

    def first_bound(self, queries: np.ndarray, turned: np.ndarray, top: int) -> np.ndarray:
        """An upper bound of each query's distance to its top-th nearest vector: that among the anchors, which are vectors too."""
        if len(self.anchors) < top:
            return np.full(len(queries), np.inf)
        least = np.partition(queries @ self.anchors.T, -top, axis=1)[:, -top]
        return (turned**2).sum(axis=1) + self.top_norm**2 - 2 * least + 1e-9

    def rotated(self, vectors: np.ndarray, queries: bool = False) -> np.ndarray:
        rest = np.zeros(len(vectors)) if queries else np.sqrt(np.maximum(self.top_norm**2 - (vectors**2).sum(axis=1), 0))
        return np.concatenate([vectors, rest[:, None]], axis=1) @ self.rotation

    def nearest(self, points: np.ndarray, count: int) -> np.ndarray:
        """The nearest lists of each point, nearest first."""
        out = []
        for at in range(0, len(points), 4096):
            far = (self.centroids**2).sum(axis=1)[None, :] - 2 * points[at : at + 4096] @ self.centroids.T
            few = np.argpartition(far, min(count, far.shape[1]) - 1, axis=1)[:, :count]
            out.append(np.take_along_axis(few, np.take_along_axis(far, few, 1).argsort(axis=1, kind="stable"), 1))
        return np.concatenate(out) if out else np.zeros((0, count), np.int64)


def adaptive_scan(query: np.ndarray, points: np.ndarray, top: int, bound: float = math.inf, block: int = BLOCK, sigmas: float = SIGMAS) -> tuple[np.ndarray, int]:
    """Places of ``points`` that may be among the ``top`` nearest to ``query``, and the components read.

    ``bound`` limits the squared distance from outside; the first few points are measured whole and may lower it. The others
    are measured by blocks of columns. The vectors are randomly rotated, so d of D squared
    components are a random sample, and the distance that they estimate has a relative standard error of sqrt((1 - d/D) / 2d).
    The hypothesis that a candidate is within the bound is rejected, and
    the candidate abandoned, if its estimate is more than ``sigmas`` of these over.
    """
    n, width = points.shape
    start = min(n, 4 * top) if bound == math.inf else 0
    exact = ((points[:start] - query) ** 2).sum(axis=1)
    if start > top:
        bound = min(bound, np.partition(exact, top - 1)[top - 1])
    kept, partial, read = np.arange(start, n), np.zeros(n - start), start * width
    for low in range(0, width, block):
        high = min(low + block, width)
        part = (points[kept, low:high] if low else points[start:, :high]) - query[low:high]
        partial = partial + np.einsum("ij,ij->i", part, part)
        read += part.size
        alive = partial <= bound * (1 + sigmas * math.sqrt((1 - high / width) / (2 * high))) ** 2 * high / width
        kept, partial = kept[alive], partial[alive]
    places, far = np.concatenate([np.arange(start), kept]), np.concatenate([exact, partial])
    near = far <= (min(bound, np.partition(far, top - 1)[top - 1]) if len(far) > top else bound) + 1e-9
    return places[near], read


def _ids(scores: np.ndarray, members: list, count: int) -> list[tuple[float, int]]:
    """The best (score, id) of classes with these scores and members, so many at most; ties by id."""
    if len(scores) > count:
        edge = np.partition(scores, -count)[-count]
        kept = np.flatnonzero(scores >= edge)
        scores, members = scores[kept], [members[i] for i in kept]
    return sorted(((float(s), int(i)) for s, own in zip(scores, members, strict=True) for i in own), key=lambda x: (-x[0], x[1]))[:count]


def _best(hits: DataFrame, count: int) -> DataFrame:
    """The best hits of each asker; a vector counts once."""
    order = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id")
    return hits.groupBy("asker", "vec_id").agg(F.max("score").alias("score")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= count).select("asker", "score", "vec_id")


def nearest(vectors: DataFrame, queries: DataFrame, top: int = TOP, lists: int | None = None, probes: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each vector of ``queries`` the nearest others of ``vectors`` by inner product.

    Equal vectors are one class: at most ``top`` + 1 smallest ids of a class can
    be in a result, and equal queries are searched once. So a vector with any number of
    copies is scanned once. Each class is in its nearest list, each query asks its
    ``probes`` nearest lists, a few first for a close bound. Lists and their queries are cut into parts, so a
    group is bounded however large a list. Scores are double-precision inner
    products of the original vectors; ties go to the smaller vec_id. Vectors
    that take no part (see :func:`usable`) are neither queries nor results; a
    repeated vec_id counts once, with its smallest vector. An inner product needs vectors
    of one length: those of other lengths than the commonest in the table (the longest of several) take no part. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = usable(vectors).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    # Adding zero makes negative zeros positive, so that equal vectors are equal as text.
    rows = cut(rows.withColumn("class", F.sha2(F.to_json(F.transform("embedding", lambda x: x + F.lit(0.0))), 256)))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    size = rows.groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("n"), F.max(norm).alias("m")).orderBy(F.desc("n"), F.desc("width")).first()
    if size is None:
        return empty
    width = size["width"]
    rows = rows.where(F.size("embedding") == width)
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("class", "embedding").toArrow()
    base = np.array(chosen.column("embedding").to_pylist())
    lists = lists or max(1, min(4096, size["n"] // LIST))
    model = Model(base, lists, float(size["m"]))
    probes = probes or model.probes_for(base, top)

    # A class's members that can be in a result; WindowGroupLimit keeps so many in each task before the shuffle.
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy("class").orderBy("vec_id"))).where(F.col("place") <= top + 1)
    classes = first.groupBy("class").agg(F.min("embedding").alias("embedding"), F.sort_array(F.collect_list("vec_id")).alias("members"))
    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id")).distinct().join(rows.select("vec_id", "class"), "vec_id").withColumnRenamed("vec_id", "query_id")
    asking = cut(asked)
    classes = cut(classes.join(asking.select("class").distinct().withColumn("asks", F.lit(True)), "class", "left"))

    # The anchors' classes, each with its smallest ids: so many rows at most, whatever the table.
    names = spark.createDataFrame([(x,) for x in sorted(set(chosen.column("class").to_pylist()[:ANCHORS]))], "class string")
    anchors = classes.join(F.broadcast(names), "class", "left_semi").select("embedding", "members").toArrow()
    anchor_points, anchor_members = np.array(anchors.column("embedding").to_pylist()), anchors.column("members").to_pylist()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _matrix(batch.column("embedding"), width)
            near = model.nearest(model.rotated(points), 1)[:, 0] if len(points) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("class", "embedding", "members")), pa.array(near.astype(np.int32))], names=["class", "embedding", "members", "list"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _matrix(batch.column("embedding"), width)
            turned = model.rotated(points, True)
            near = model.nearest(turned, min(probes, len(model.centroids))) if len(points) else np.zeros((0, 1), np.int64)
            asked_of = pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32()))
            bound = pa.array(model.first_bound(points, turned, top + 1))
            yield pa.RecordBatch.from_arrays([batch.column("class"), batch.column("embedding"), asked_of, bound], names=["asker", "query", "lists", "bound"])

    placed = cut(map_arrow(classes.select("class", "embedding", "members"), assign, "class string, embedding array<double>, members array<long>, list int"))
    probing = cut(map_arrow(classes.where("asks").select("class", "embedding"), probe, "asker string, query array<double>, lists array<int>, bound double"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    # How many parts each list is cut into; as many rows as there are lists, 4096 at most.
    parts = cut(placed.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")))

    def scan(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"asker": [], "score": [], "vec_id": []}
        if len(left) and len(right):
            original = np.array(left["embedding"].tolist(), np.float64)
            points, members = np.ascontiguousarray(model.rotated(original)), left["members"].tolist()
            asks = np.array(right["query"].tolist(), np.float64)
            for name, ask_, bound, turned in zip(right["asker"], asks, right["bound"], model.rotated(asks, True), strict=True):
                places, _ = adaptive_scan(turned, points, top + 1, bound)
                scores = inner(original[places], ask_)
                for score, vec_id in _ids(scores, [members[i] for i in places], top + 1):
                    out["asker"].append(name)
                    out["score"].append(score)
                    out["vec_id"].append(vec_id)
        return pd.DataFrame(out).astype({"score": "float64", "vec_id": "int64"})

    def scanned(ask: DataFrame) -> DataFrame:
        """Rows (asker, score, vec_id) of what queries (asker, query, bound, list) find. Lists and their queries meet in blocks of bounded size."""
        turns = ask.groupBy("list").agg(F.ceil(F.count("*") / ASKING).cast("int").alias("turns"))
        split = F.broadcast(cut(parts.join(turns, "list")))
        part, turn = F.pmod(F.xxhash64("class"), F.col("parts").cast("long")).cast("int"), F.pmod(F.xxhash64("asker"), F.col("turns").cast("long")).cast("int")
        held = placed.join(split, "list").withColumn("part", part).withColumn("turn", every("turns")).drop("parts", "turns")
        come = ask.join(split, "list").withColumn("turn", turn).withColumn("part", every("parts")).drop("parts", "turns")
        return held.groupBy("list", "part", "turn").cogroup(come.groupBy("list", "part", "turn")).applyInPandas(scan, "asker string, score double, vec_id long")

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asks = _matrix(batch.column("query"), width)
            rough = asks @ anchor_points.T
            few = np.argpartition(-rough, min(top, rough.shape[1] - 1), axis=1)[:, : top + 1]
            found = [(at, own[0], own[1]) for at, (ask, near) in enumerate(zip(asks, few, strict=True)) for own in _ids(inner(anchor_points[near], ask), [anchor_members[i] for i in near], top + 1)]
            asker = batch.column("asker").take(pa.array([x[0] for x in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([asker, pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.int64())], names=["asker", "score", "vec_id"])

    # The anchors that gave the first bound are found already, so no query is left with fewer than its share.
    known = map_arrow(probing.select("asker", "query"), anchored, "asker string, score double, vec_id long")
    # The nearest few lists first: what they give is a bound that leaves little of the other lists, however many these are.
    near_lists = scanned(probing.select("asker", "query", "bound", F.explode(F.slice("lists", 1, FIRST)).alias("list")))
    early = cut(_best(near_lists.unionByName(known), top + 1))
    worst = early.groupBy("asker").agg(F.min("score").alias("worst"), F.count("*").alias("n"))
    closer = F.aggregate("query", F.lit(size["m"] ** 2 + 1e-9), lambda a, x: a + x * x) - 2 * F.col("worst")
    later = probing.join(worst, "asker").withColumn("bound", F.when(F.col("n") > top, F.least("bound", closer)).otherwise(F.col("bound")))
    rest = F.when(F.size("lists") > FIRST, F.slice("lists", FIRST + 1, 4096)).otherwise(F.expr("cast(array() as array<int>)"))
    hits = scanned(later.select("asker", "query", "bound", F.explode(rest).alias("list"))).unionByName(early)
    best = _best(hits, top + 1)
    answers = cut(best.groupBy("asker").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("near")))
    own = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, top)
    result = asking.join(answers.withColumnRenamed("asker", "class"), "class").select("query_id", F.posexplode(own).alias("at", "hit"))
    return result.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.far")).alias("score"))
