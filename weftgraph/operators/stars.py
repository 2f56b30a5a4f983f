"""Connected components by alternating large-star and small-star steps.

Every round rewires each edge towards the least known neighbour; the edges left at the fixed
point are stars whose centre is the least node of its component. The number of rounds grows with
the logarithm of the component size, not with its diameter. Minima are partial aggregates and
the join that follows can be split by AQE, so a node with very many edges is no bottleneck.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.lineage import cut


def star_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every end of an edge; ``component`` is the least node reachable.

    Directions, self-loops, repeated edges and edges with a null end are ignored, except that a
    node with self-loops only is its own component.
    """
    ends = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).dropna()
    loops = ends.filter("u = v").select(F.col("u").alias("node"))
    kept = cut(ends.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(rounds):
        kept = cut(_small(_large(kept)))
        state = kept.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = kept.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    found = kept.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    alone = loops.distinct().join(found.select("node"), "node", "left_anti")
    return found.unionByName(alone.withColumn("component", F.col("node")))


def _large(kept: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is moved to the least of the node and its neighbours."""
    both = kept.select("u", "v").unionByName(kept.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return (
        both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    )


def _small(kept: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are moved to the least of those; edges have u > v."""
    least = kept.groupBy("u").agg(F.min("v").alias("m"))
    moved = kept.join(least, "u")
    return (
        moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(moved.select("u", F.col("m").alias("v")))
        .filter("u <> v")
        .distinct()
    )
