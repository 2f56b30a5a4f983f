"""Connected, weakly and strongly connected components, and what builds on them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph, spread
from weftgraph.lineage import cut
from weftgraph.operators import kernels
from weftgraph.operators.stars import star_components


def connected(g: Graph) -> DataFrame:
    """``(node, component)``, the component named by its least node; directions are ignored, so
    these are the weak components of a directed graph."""
    g = g.kept()
    if kernels.small(g):
        return kernels.whole(g, kernels.connected, "node long, component long")
    return _contracted(g)


def _contracted(g: Graph) -> DataFrame:
    """A part of the edges, drawn by a hash, joins most nodes of a dense graph; all other edges are looked at once, and
    those between the components found so far settle the rest. Edges that join nothing new thus take no part in
    the rounds. The part has three edges a node, or is what one task takes if that has nearly two."""
    n, m = g.nodes.count(), g.edges.count()
    share = m // max(1, kernels.SMALL if 2 * kernels.SMALL >= 3 * n else 3 * n) + 1
    if share == 1 or m < 6 * n:
        return _named(g.nodes, _settled(g.edges))
    known = cut(_named(g.nodes, _settled(g.edges.filter(F.pmod(F.xxhash64("src", "dst"), F.lit(share)) == 0))))
    parts = spread(g.spark, m)
    a, b = known.select(F.col("node").alias("src"), F.col("component").alias("a")), known.select(F.col("node").alias("dst"), F.col("component").alias("b"))
    both = g.edges.select("src", "dst").repartition(parts, "src").join(a, "src").repartition(parts, "dst").join(b, "dst")
    rest = cut(both.filter("a <> b").select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")).distinct())
    later = _settled(rest).select(F.col("node").alias("component"), F.col("component").alias("least"))
    return known.join(later, "component", "left").select("node", F.coalesce("least", "component").alias("component"))


def _settled(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of the ends of edges, in one task where that is allowed."""
    edges = cut(edges.select("src", "dst"))
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    part = Graph(cut(ends), edges.withColumn("w", F.lit(1.0)))
    return kernels.whole(part, kernels.connected, "node long, component long") if kernels.small(part) else star_components(edges)


def _named(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """All nodes; one without edges is its own component."""
    return nodes.join(found, F.col("id") == F.col("node"), "left").select(F.col("id").alias("node"), F.coalesce("component", "id").alias("component"))


def sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count("*").alias("size"))


def largest(g: Graph) -> Graph:
    """The subgraph of the largest component, ties for the one with the least node."""
    found = cut(connected(g))
    top = sizes(found).orderBy(F.col("size").desc(), "component").limit(1).select("component")
    inside = found.join(F.broadcast(top), "component", "left_semi").select(F.col("node").alias("id"))
    ends = inside.withColumnRenamed("id", "src")
    return replace(g, nodes=inside, edges=g.edges.join(ends, "src", "left_semi").select(g.edges.columns))


def strong(g: Graph) -> DataFrame:
    """``(node, component)``, named by its least node.

    Rounds of trimming and colouring: every node takes the least node that reaches it (forward);
    within a colour, the nodes that reach the colour's root backwards are its component. They are
    settled and taken out; nodes without in- or out-edges are settled at once."""
    g = g.kept()
    if kernels.small(g) and g.directed:
        return kernels.whole(g, kernels.strong, "node long, component long")
    return _strong(g)


def _strong(g: Graph) -> DataFrame:
    edges = cut(g.edges.filter("src <> dst").select("src", "dst").distinct())
    left = cut(g.nodes)
    done = None

    def settle(rows: DataFrame) -> None:
        nonlocal done
        done = cut(rows if done is None else done.unionByName(rows))

    while True:
        while True:  # trim
            fine = edges.select(F.col("src").alias("id")).intersect(edges.select(F.col("dst").alias("id")))
            single = cut(left.join(fine, "id", "left_anti"))
            if not single.limit(1).count():
                break
            settle(single.select(F.col("id").alias("node"), F.col("id").alias("component")))
            left = cut(left.join(single, "id", "left_anti"))
            edges = _inside(edges, left)
        if not left.limit(1).count():
            return done if done is not None else left.select(F.col("id").alias("node"), F.col("id").alias("component"))
        colour = _spread(left.select("id", F.col("id").alias("c")), edges)
        inner = edges.join(colour.select(F.col("id").alias("src"), F.col("c").alias("a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("b")), "dst").filter("a = b").select("src", "dst")
        inner = cut(inner)
        reach = cut(colour.filter("id = c"))
        front = reach
        while True:
            new = front.select(F.col("id").alias("dst"), "c").join(inner, "dst").select(F.col("src").alias("id"), "c").distinct().join(reach, ["id", "c"], "left_anti")
            front = cut(new)
            if not front.limit(1).count():
                break
            reach = cut(reach.unionByName(front))
        settle(reach.select(F.col("id").alias("node"), F.col("c").alias("component")))
        left = cut(left.join(reach.select("id"), "id", "left_anti"))
        edges = _inside(edges, left)


def biconnected(g: Graph) -> DataFrame:
    """``(node, block)``: the nodes of each biconnected component, of two nodes at least; a cut node
    is in several. The search is sequential, so the graph must fit one task."""
    g = g.kept()
    if not kernels.small(g):
        raise ValueError("biconnected components need a graph that fits one task")
    return kernels.whole(g, kernels.biconnected, "node long, block long")


def _inside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    a, b = nodes.select(F.col("id").alias("src")), nodes.select(F.col("id").alias("dst"))
    return cut(edges.join(a, "src", "left_semi").join(b, "dst", "left_semi").select("src", "dst"))


def _spread(state: DataFrame, edges: DataFrame) -> DataFrame:
    """Each node takes the least value of those that reach it."""
    state = cut(state)
    while True:
        got = edges.join(state, F.col("src") == F.col("id")).groupBy("dst").agg(F.min("c").alias("m"))
        new = cut(state.join(got, F.col("id") == F.col("dst"), "left").select("id", F.least("c", F.coalesce("m", "c")).alias("c"), (F.col("m") < F.col("c")).alias("moved")))
        state = new.select("id", "c")
        if not new.filter("moved").limit(1).count():
            return state
