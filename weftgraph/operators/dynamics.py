"""Results kept up to date under edge insertions: only what an insertion changes is computed again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.lineage import cut
from weftgraph.operators.stars import star_components


def with_edges(g: Graph, new: DataFrame) -> Graph:
    """The graph with more edges ``(src, dst, w)`` and their ends."""
    from weftgraph.graph import graph

    more = graph(new, directed=g.directed, w="w")
    return Graph(g.nodes.unionByName(more.nodes).distinct(), g.edges.select("src", "dst", "w").unionByName(more.edges), g.directed, g.weighted)


def distances_after(g: Graph, known: DataFrame, new: DataFrame, weighted: bool = False) -> DataFrame:
    """``(source, node, dist)`` of the grown graph ``g``, from the distances before and the inserted edges
    ``(src, dst, w)``: rounds start from the ends that an inserted edge brings nearer, and go on only from
    nodes that came nearer."""
    w = F.col("w") if weighted else F.lit(1.0)
    near = cut(g.adjacency.select("u", "v", w.alias("w")))
    fresh = new.select(F.col("src").alias("u"), F.col("dst").alias("v"), w.alias("w"))
    if not g.directed:
        fresh = fresh.unionByName(fresh.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    best = cut(known.select("source", "node", "dist"))
    step = best.join(fresh, F.col("node") == F.col("u")).groupBy("source", F.col("v").alias("node")).agg(F.min(F.col("dist") + F.col("w")).alias("to"))
    while True:
        both = cut(best.join(step, ["source", "node"], "full").select("source", "node", F.least("dist", "to").alias("dist"), (F.col("dist").isNull() | (F.col("to") < F.col("dist"))).alias("better")))
        best, front = both.select("source", "node", "dist"), both.filter("better").select("source", "node", "dist")
        if not front.limit(1).count():
            return best
        step = front.join(near, F.col("node") == F.col("u")).groupBy("source", F.col("v").alias("node")).agg(F.min(F.col("dist") + F.col("w")).alias("to"))


def components_after(known: DataFrame, new: DataFrame) -> DataFrame:
    """``(node, component)`` after edges were inserted: the components they join are merged, a graph of
    components only."""
    ends = new.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    whole = known.unionByName(ends.join(known.select("node"), "node", "left_anti").withColumn("component", F.col("node")))
    a, b = whole.select(F.col("node").alias("src"), F.col("component").alias("a")), whole.select(F.col("node").alias("dst"), F.col("component").alias("b"))
    merged = star_components(new.select("src", "dst").join(a, "src").join(b, "dst").select("a", "b"), "a", "b").withColumnRenamed("node", "c").withColumnRenamed("component", "to")
    return whole.join(merged, F.col("component") == F.col("c"), "left").select("node", F.coalesce("to", "component").alias("component"))


def affected(g: Graph, source: int, src: int, dst: int) -> DataFrame:
    """``(node, before, after)``: nodes that an edge src-dst brings nearer to the source."""
    from weftgraph.operators import distances

    spark = g.spark
    old = cut(distances.bfs(g, spark.createDataFrame([(source,)], "id long")).select("source", "node", "dist"))
    new = spark.createDataFrame([(src, dst, 1.0)], "src long, dst long, w double")
    now = distances_after(with_edges(g, new), old, new)
    rows = now.join(old.select("node", F.col("dist").alias("before")), "node", "left")
    return rows.filter("before IS NULL OR dist < before").select("node", "before", F.col("dist").alias("after"))
