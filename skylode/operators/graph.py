"""Connected components by hooking, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylode.runtime import cut


def connected_components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """Rows (node, component): each node that an edge names, with its component's smallest node.

    Every round hooks each node to its smallest neighbour (a partial
    aggregate, so a hub costs one row per task), shortens the pointers to
    their roots, and contracts the edges to those between different roots.
    At least half of the remaining non-isolated nodes go each round, so rounds
    are logarithmic in the number of nodes. Nothing is collected but counts.
    Nulls, loops and repeated edges are ignored; no edges give no rows.
    """
    u, v = F.col(left), F.col(right)
    pairs = cut(edges.where(u.isNotNull() & v.isNotNull() & (u != v)).select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct())
    kind = pairs.schema["u"].dataType
    rounds: list[DataFrame] = []
    while not pairs.isEmpty():
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        roots = cut(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("component")))
        while True:
            up = roots.select(F.col("node").alias("component"), F.col("component").alias("above"))
            roots = cut(roots.join(up, "component").select("node", F.col("above").alias("component"), (F.col("above") != F.col("component")).alias("moved")))
            if roots.where("moved").isEmpty():
                break
            roots = roots.drop("moved")
        roots = roots.drop("moved")
        rounds.append(roots)
        at_u = roots.select(F.col("node").alias("u"), F.col("component").alias("cu"))
        at_v = roots.select(F.col("node").alias("v"), F.col("component").alias("cv"))
        pairs = cut(
            pairs.join(at_u, "u").join(at_v, "v").where("cu != cv").select(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).distinct()
        )
    if not rounds:
        return edges.sparkSession.createDataFrame([], f"node {kind.simpleString()}, component {kind.simpleString()}")
    out = rounds[0]
    for step in rounds[1:]:
        step = step.select(F.col("node").alias("component"), F.col("component").alias("above"))
        out = out.join(step, "component", "left").select("node", F.coalesce("above", "component").alias("component"))
    return out
