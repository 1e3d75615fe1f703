"""Connected components of an edge table, by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspan.llm.common import BROADCAST_ROWS, discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """v and component of every vertex of edges (a, b); a component is named after one of its vertices.

    In each round every vertex joins the first of its neighbours and itself, in an order that a hash
    makes anew for each round; edges are carried over to the merged vertices, and duplicates and
    loops go. Whatever the graph, the vertices that still have edges are expected to shrink by a
    constant factor each time (a path: by half), so the rounds grow with the logarithm of the
    vertices. Nothing is collected but counts.
    """
    steps: list[DataFrame] = []
    edges = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    while n := edges.count():
        place = lambda c, k=len(steps): F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("v"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = materialise(both.groupBy("a").agg(F.min(place("b")).alias("m")).select("a", F.least("m", place("a"))["v"].alias("m")))
        steps.append(step)
        near = F.broadcast(step) if 2 * n <= BROADCAST_ROWS else step  # two vertices an edge at most
        one = edges.join(near.select(F.col("a"), F.col("m").alias("x")), "a")
        two = one.join(near.select(F.col("a").alias("b"), F.col("m").alias("y")), "b")
        old, edges = edges, materialise(two.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        discard(old)
    if not steps:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("component"))
    discard(edges)
    # from the last and smallest step back: each vertex takes the name that the one it joined has come to
    label = materialise(steps[-1].select(F.col("a").alias("v"), F.col("m").alias("component")))
    for step in reversed(steps[:-1]):
        end = label.select(F.col("v").alias("m"), "component")
        end = F.broadcast(end) if label.count() <= BROADCAST_ROWS else end
        old, label = label, materialise(step.join(end, "m", "left").select(F.col("a").alias("v"), F.coalesce("component", "m").alias("component")))
        discard(old)
    discard(*steps)
    return label
