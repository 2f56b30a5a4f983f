"""Whole-graph functions: sizes, degrees, subgraphs, set operations, renumbering, sampling."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.graph import Graph, canonical, numbered


def size(g: Graph) -> DataFrame:
    """``(n, m)``"""
    return g.nodes.agg(F.count("*").alias("n")).crossJoin(g.edges.agg(F.count("*").alias("m")))  # one row each


def density(g: Graph) -> DataFrame:
    """``(density)``: edges without loops over possible ones; 0 for one node at most."""
    loops = g.edges.agg(F.count(F.when(F.col("src") != F.col("dst"), 1)).alias("m"))
    one = g.nodes.agg(F.count("*").alias("n")).crossJoin(loops)  # one row each
    factor = 1 if g.directed else 2
    n = F.col("n").cast("double")
    return one.select(F.when(F.col("n") <= 1, 0.0).otherwise(F.col("m") * factor / (n * (n - 1))).alias("density"))


def max_degree(g: Graph) -> DataFrame:
    """``(max_out, max_in, max_weighted_out, max_weighted_in)``"""
    out = g.degrees().agg(F.max("degree").alias("max_out"), F.max("weighted").alias("max_weighted_out"))
    into = g.degrees(incoming=True).agg(F.max("degree").alias("max_in"), F.max("weighted").alias("max_weighted_in"))
    return out.crossJoin(into).select("max_out", "max_in", "max_weighted_out", "max_weighted_in")  # one row each


def degree_distribution(g: Graph) -> DataFrame:
    """``(degree, n)``"""
    return g.degrees().groupBy("degree").agg(F.count("*").alias("n"))


def self_loops(g: Graph) -> DataFrame:
    return g.edges.filter("src = dst")


def volume(g: Graph, chosen: DataFrame | None = None, incoming: bool = False) -> DataFrame:
    """``(volume)``: weighted degrees of all or some nodes ``(id)``, self-loops twice."""
    found = g.degrees(incoming=incoming, twice=not g.directed)
    if chosen is not None:
        found = found.join(chosen.select("id").distinct(), "id", "left_semi")
    return found.agg(F.coalesce(F.sum("weighted"), F.lit(0.0)).alias("volume"))


def induced(g: Graph, chosen: DataFrame) -> Graph:
    """The subgraph of the nodes ``(id)`` and the edges between them."""
    ids = chosen.select("id").distinct()
    nodes = g.nodes.join(ids, "id", "left_semi")
    edges = g.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return replace(g, nodes=nodes, edges=edges.select(g.edges.columns))


def around(g: Graph, chosen: DataFrame) -> Graph:
    """The nodes ``(id)``, their neighbours, and all edges with an end among the chosen."""
    ids = chosen.select("id").distinct()
    by_src = g.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select(g.edges.columns)
    rest = g.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").select(g.edges.columns)
    edges = by_src.unionByName(rest.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(g.edges.columns))
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).union(g.nodes.join(ids, "id", "left_semi").select("id"))
    return replace(g, nodes=ends.distinct(), edges=edges)


def undirected(g: Graph) -> Graph:
    """Directions dropped; an edge that ran both ways stays once, with the summed weight."""
    edges = g.edges.select(*canonical(), "w").groupBy("src", "dst").agg(F.sum("w").alias("w"))
    return Graph(g.nodes, edges, False, g.weighted)


def unweighted(g: Graph) -> Graph:
    return replace(g, edges=g.edges.withColumn("w", F.lit(1.0)), weighted=False)


def weighted(g: Graph) -> Graph:
    return replace(g, weighted=True)


def transpose(g: Graph) -> Graph:
    if not g.directed:
        raise ValueError("only a directed graph has a transpose")
    return replace(g, edges=g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def without_loops(g: Graph) -> Graph:
    return replace(g, edges=g.edges.filter("src <> dst"))


def without_multi_edges(g: Graph) -> Graph:
    """One of the edges between two nodes stays, with the least weight."""
    return replace(g, edges=g.edges.groupBy("src", "dst").agg(F.min("w").alias("w")))


def without_edges(g: Graph, gone: DataFrame) -> Graph:
    """Without the edges ``(src, dst)``; either orientation if undirected."""
    rows = gone.select("src", "dst") if g.directed else gone.select(*canonical())
    return replace(g, edges=g.edges.join(rows, ["src", "dst"], "left_anti").select(g.edges.columns))


def without_nodes(g: Graph, gone: DataFrame) -> Graph:
    return induced(g, g.nodes.join(gone.select("id"), "id", "left_anti"))


def append(g: Graph, other: Graph) -> Graph:
    """Disjoint union: the other's ids are shifted beyond the greatest id here."""
    shift = g.nodes.agg(F.coalesce(F.max("id") + 1, F.lit(0)).alias("shift"))
    nodes = other.nodes.crossJoin(shift).select((F.col("id") + F.col("shift")).alias("id"))  # one row
    edges = other.edges.crossJoin(shift).select((F.col("src") + F.col("shift")).alias("src"), (F.col("dst") + F.col("shift")).alias("dst"), "w")
    return replace(g, nodes=g.nodes.unionByName(nodes), edges=g.edges.select("src", "dst", "w").unionByName(edges))


def merge(g: Graph, other: Graph) -> Graph:
    """Union of nodes and edges; where both have an edge, this graph's stays."""
    extra = other.edges.select("src", "dst", "w").join(g.edges.select("src", "dst"), ["src", "dst"], "left_anti")
    return replace(g, nodes=g.nodes.unionByName(other.nodes).distinct(), edges=g.edges.select("src", "dst", "w").unionByName(extra))


def continuous_ids(g: Graph, seed: int | None = None) -> DataFrame:
    """``(id, new)``: dense ids in id order, or in a seeded random order."""
    if seed is None:
        return numbered(g.nodes, ["id"], "new")
    return numbered(g.nodes.withColumn("_at", F.xxhash64(F.lit(seed), "id")), ["_at", "id"], "new").drop("_at")


def remap(g: Graph, ids: DataFrame) -> Graph:
    """The graph under new ids ``(id, new)``; nodes without one are left out, with their edges."""
    a, b = ids.select(F.col("id").alias("src"), F.col("new").alias("_s")), ids.select(F.col("id").alias("dst"), F.col("new").alias("_d"))
    nodes = g.nodes.join(ids, "id").select(F.col("new").alias("id"))
    rows = g.edges.join(a, "src").join(b, "dst").select(F.col("_s").alias("src"), F.col("_d").alias("dst"), "w")
    return replace(g, nodes=nodes, edges=rows if g.directed else rows.select(*canonical(), "w"))


def compact(g: Graph) -> Graph:
    return remap(g, continuous_ids(g))


def restore(g: Graph, ids: DataFrame) -> Graph:
    """Undoes ``remap``."""
    return remap(g, ids.select(F.col("new").alias("id"), F.col("id").alias("new")))


def sorted_adjacency(g: Graph) -> DataFrame:
    """``(u, neighbours)``: by weight, then id."""
    return g.adjacency.groupBy("u").agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "v"))), lambda x: x["v"]).alias("neighbours"))


def random_nodes(g: Graph, k: int, seed: int) -> DataFrame:
    return g.nodes.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(k)


def random_edges(g: Graph, k: int, seed: int) -> DataFrame:
    """``k`` different edges, uniformly."""
    return g.edges.orderBy(F.xxhash64(F.lit(seed), "src", "dst"), "src", "dst").limit(k)


def random_neighbour(g: Graph, seed: int) -> DataFrame:
    """``(u, v)``: a uniform out-neighbour of each node that has one."""
    return g.adjacency.groupBy("u").agg(F.max_by("v", F.struct(F.xxhash64(F.lit(seed), "u", "v"), "v")).alias("v"))


def ranking(scores: DataFrame, key: str = "node", score: str = "score") -> DataFrame:
    """``(…, rank)``: by score downwards, then id. A global order: for reports."""
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(F.col(score).desc(), key)))


# --- questions about single nodes and edges ---


def has_node(g: Graph, u: int) -> bool:
    return g.nodes.filter(F.col("id") == u).limit(1).count() > 0


def edges_between(g: Graph, u: int, v: int) -> DataFrame:
    """The edges from u to v (either way if undirected)."""
    if g.directed:
        return g.edges.filter((F.col("src") == u) & (F.col("dst") == v))
    return g.edges.filter((F.col("src") == max(u, v)) & (F.col("dst") == min(u, v)))


def has_edge(g: Graph, u: int, v: int) -> bool:
    return edges_between(g, u, v).limit(1).count() > 0


def weight(g: Graph, u: int, v: int) -> float:
    """Of the edge between u and v, 0 if there is none."""
    row = edges_between(g, u, v).agg(F.min("w")).first()
    return row[0] or 0.0


def with_weight(g: Graph, u: int, v: int, w: float) -> Graph:
    """The edge u-v, made if there is none, with weight w."""
    a, b = (u, v) if g.directed else (max(u, v), min(u, v))
    rest = g.edges.select("src", "dst", "w").filter(~((F.col("src") == a) & (F.col("dst") == b)))
    ends = g.spark.createDataFrame([(u,), (v,)], "id long")
    return replace(g, nodes=g.nodes.unionByName(ends).distinct(), edges=rest.unionByName(g.spark.createDataFrame([(a, b, float(w))], "src long, dst long, w double")), weighted=True)


def isolated(g: Graph) -> DataFrame:
    """``(id)`` of nodes without edges to other nodes or themselves."""
    ends = g.edges.select(F.col("src").alias("id")).unionByName(g.edges.select(F.col("dst").alias("id")))
    return g.nodes.join(ends, "id", "left_anti")


def is_empty(g: Graph) -> bool:
    return g.nodes.limit(1).count() == 0


def id_bound(g: Graph) -> int:
    """One more than the greatest id."""
    found = g.nodes.agg(F.max("id")).first()[0]
    return 0 if found is None else found + 1


def total_weight(g: Graph) -> float:
    return g.edges.agg(F.sum("w")).first()[0] or 0.0


def consistent(g: Graph) -> bool:
    """Edges end at live nodes, undirected ones are canonical and no edge is there twice."""
    ends = g.edges.select(F.col("src").alias("id")).unionByName(g.edges.select(F.col("dst").alias("id")))
    loose = ends.join(g.nodes, "id", "left_anti").limit(1).count()
    turned = 0 if g.directed else g.edges.filter("src < dst").limit(1).count()
    twice = g.edges.groupBy("src", "dst").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
    return not (loose or turned or twice)


def without_edges_of(g: Graph, u: int, incoming: bool = True, outgoing: bool = True) -> Graph:
    """The node stays, its edges go; of a directed graph those into or out of it."""
    if not g.directed:
        return replace(g, edges=g.edges.filter((F.col("src") != u) & (F.col("dst") != u)))
    gone = (F.lit(outgoing) & (F.col("src") == u)) | (F.lit(incoming) & (F.col("dst") == u))
    return replace(g, edges=g.edges.filter(~gone))


def without_all_edges(g: Graph) -> Graph:
    return replace(g, edges=g.edges.limit(0))


def node_pairs(g: Graph, near: DataFrame) -> DataFrame:
    """``(u, v)``, u < v: pairs of live nodes among candidates ``(u, v)``; all pairs of nodes are never
    made."""
    fine = near.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v").distinct()
    return fine.join(g.nodes.withColumnRenamed("id", "u"), "u", "left_semi").join(g.nodes.withColumnRenamed("id", "v"), "v", "left_semi").select("u", "v")
