"""Connected components of an edge table, by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkatlas.llm.common import discard, stored


def components(edges: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """(node, component) of every node with an edge: component is the least node reachable.

    x and y may be of any type that can be ordered. Each round every node takes
    the least neighbour below it, and that one's (least values are taken before
    the shuffle, so a node with many edges is no burden); edges are then drawn
    between what nodes took, and those within one of them go. Edges shrink from
    round to round, each written to the shared folder; rounds end when none is
    left, after a number that grows with the logarithm of the longest path. Then
    the rounds are followed backwards. Null ends and loops are left out.
    """
    u, v = F.col("u"), F.col("v")

    def pairs(table: DataFrame) -> DataFrame:
        return stored(table.where(u != v).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")

    left = pairs(edges.select(F.col(x).alias("u"), F.col(y).alias("v")).where(u.isNotNull() & v.isNotNull()))
    taken: list[DataFrame] = []
    while left.limit(1).count():
        near = left.groupBy("v").agg(F.min("u").alias("p"))
        beyond = near.select(F.col("v").alias("p"), F.col("p").alias("q"))
        step = stored(near.join(beyond, "p", "left").select("v", F.coalesce("q", "p").alias("p")), "taken")
        as_u = step.select(F.col("v").alias("u"), F.col("p").alias("pu"))
        drawn = left.join(step, "v").join(as_u, "u", "left").select(F.coalesce("pu", "u").alias("u"), F.col("p").alias("v"))
        # a node taken that has taken another itself stays tied to it
        tied = step.select(F.col("p").alias("v")).distinct().join(step, "v").select(F.col("p").alias("u"), "v")
        before, left = left, pairs(drawn.unionByName(tied))
        discard(before)
        taken.append(step)
    discard(left)
    if not taken:
        return left.select(F.col("u").alias("node"), F.col("u").alias("component")).where(F.lit(False))
    label = taken.pop()
    for step in reversed(taken):
        at = label.select(F.col("v").alias("p"), F.col("p").alias("far"))
        whole = step.join(at, "p", "left").select("v", F.coalesce("far", "p").alias("p"))
        before, label = label, stored(whole.unionByName(label.join(step, "v", "left_anti")), "labels")
        discard(before, step)
    roots = label.select("p").distinct()
    return label.select(F.col("v").alias("node"), F.col("p").alias("component")).unionByName(roots.select(F.col("p").alias("node"), F.col("p").alias("component")))
