"""Distances, paths and what is summed over them. Rows are ``(source, node, dist, paths)``; a node
that cannot be reached has no row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.lineage import cut
from weftgraph.operators import kernels

PAIRS = "source long, node long, dist double, paths double"


def bfs(g: Graph, sources: DataFrame, incoming: bool = False, limit: int | None = None) -> DataFrame:
    """Hops from each source ``(id)`` with the number of shortest paths: a round for each layer
    over all sources at once, only the frontier is joined."""
    near = (g.reverse if incoming else g.adjacency).select("u", "v")
    front = cut(sources.select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(0.0).alias("dist"), F.lit(1.0).alias("paths")).distinct())
    seen, hops = front, 0
    while limit is None or hops < limit:
        hops += 1
        step = front.join(near, F.col("node") == F.col("u")).groupBy("source", F.col("v").alias("node")).agg(F.sum("paths").alias("paths"))
        front = cut(step.join(seen.select("source", "node"), ["source", "node"], "left_anti").select("source", "node", F.lit(float(hops)).alias("dist"), "paths"))
        if not front.limit(1).count():
            break
        seen = cut(seen.unionByName(front)) if hops % 4 == 0 else seen.unionByName(front)
    return seen


def dijkstra(g: Graph, sources: DataFrame, incoming: bool = False, bound: Column | None = None) -> DataFrame:
    """``(source, node, dist)`` over non-negative weights: only improved nodes are relaxed in a
    round. ``bound``: a condition on (source, node, dist) for rows worth keeping (A*: dist plus a
    lower bound of the rest is under the best known)."""
    near = (g.reverse if incoming else g.adjacency).select("u", "v", "w")
    best = cut(sources.select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(0.0).alias("dist")).distinct())
    front = best
    while True:
        step = front.join(near, F.col("node") == F.col("u")).groupBy("source", F.col("v").alias("node")).agg(F.min(F.col("dist") + F.col("w")).alias("to"))
        if bound is not None:
            step = step.withColumnRenamed("to", "dist").filter(bound).withColumnRenamed("dist", "to")
        both = cut(best.join(step, ["source", "node"], "full").select("source", "node", F.least("dist", "to").alias("dist"), (F.col("dist").isNull() | (F.col("to") < F.col("dist"))).alias("better")))
        front = both.filter("better").select("source", "node", "dist")
        best = both.select("source", "node", "dist")
        if not front.limit(1).count():
            return best


def pairs(g: Graph, sources: DataFrame | None = None, weighted: bool | None = None) -> DataFrame:
    """Distances and path counts from all or some nodes; by the broadcast kernel where the graph
    fits, by rounds of joins beyond (without path counts if weighted)."""
    sources = g.nodes if sources is None else sources
    weighted = g.weighted if weighted is None else weighted
    if kernels.fits(g):
        return kernels.per_source(g, sources, kernels.cheapest_rows if weighted else kernels.hop_rows, PAIRS)
    return dijkstra(g, sources).withColumn("paths", F.lit(None).cast("double")) if weighted else bfs(g, sources)


def closeness(g: Graph, normalized: bool = True, generalized: bool = False, weighted: bool = False, check: bool = True) -> DataFrame:
    """``(node, score)``. Standard: 1 over the sum of distances, normalised times n - 1, refused if
    a node does not reach all; without ``check`` over the nodes reached, infinite where that is none but
    itself; generalised: (r - 1) / sum / (n - 1) with r the nodes reached, normalised times r - 1."""
    per = pairs(g, weighted=weighted).groupBy("source").agg(F.sum("dist").alias("s"), F.count("*").alias("r"))
    rows = per.crossJoin(g.nodes.agg(F.count("*").alias("n")))  # one row
    if not generalized:
        rows = cut(rows)
        if check and rows.filter("r < n").limit(1).count():
            raise ValueError("standard closeness needs a connected graph")
        score = F.lit(1.0) / F.col("s") * ((F.col("n") - 1) if normalized else 1)
    else:
        score = (F.col("r") - 1) / F.col("s") / (F.col("n") - 1) * ((F.col("r") - 1) if normalized else 1)
    least = 0.0 if check or generalized else float("inf")
    return rows.select(F.col("source").alias("node"), F.when(F.col("s") > 0, score).otherwise(least).alias("score"))


def harmonic(g: Graph, normalized: bool = True, weighted: bool = False) -> DataFrame:
    """``(node, score)``: sum of 1 / distance, normalised by n - 1."""
    per = pairs(g, weighted=weighted).groupBy("source").agg(F.sum(F.when(F.col("dist") > 0, 1 / F.col("dist")).otherwise(0.0)).alias("s"))
    by = (F.col("n") - 1) if normalized else F.lit(1)
    return per.crossJoin(g.nodes.agg(F.count("*").alias("n"))).select(F.col("source").alias("node"), F.when(by > 0, F.col("s") / by).otherwise(0.0).alias("score"))  # one row


def top(scores: DataFrame, k: int, trail: bool = False) -> DataFrame:
    """The ``k`` best ``(node, score)``; with ``trail`` all that tie with the last."""
    if not trail:
        return scores.orderBy(F.col("score").desc(), "node").limit(k)
    last = scores.orderBy(F.col("score").desc()).limit(k).agg(F.min("score").alias("last"))
    return scores.crossJoin(last).filter("score >= last").drop("last")  # one row


def betweenness(g: Graph, normalized: bool = False, weighted: bool = False, sources: DataFrame | None = None) -> DataFrame:
    """``(node, score)``: sums over ordered pairs, so an undirected pair counts twice; normalised by
    (n - 1)(n - 2). ``sources``: only pairs from these."""
    g = g.kept()
    chosen = g.nodes if sources is None else sources
    if kernels.fits(g):
        part = kernels.per_source(g, chosen, kernels.dependencies(weighted), "node long, score double")
        found = part.groupBy("node").agg(F.sum("score").alias("score"))
    elif weighted:
        raise ValueError("weighted betweenness needs a graph that fits the kernel")
    else:
        found = _layered(g, chosen)
    rows = g.nodes.join(found, F.col("id") == F.col("node"), "left").select(F.col("id").alias("node"), F.coalesce("score", F.lit(0.0)).alias("score"))
    if normalized:
        n = g.nodes.count()
        rows = rows.select("node", (F.col("score") / max(1, (n - 1) * (n - 2))).alias("score"))
    return rows


def _layered(g: Graph, sources: DataFrame) -> DataFrame:
    """Brandes by joins: path counts layer by layer, then dependencies back from the last layer."""
    seen = cut(bfs(g, sources))
    last = int(seen.agg(F.max("dist")).first()[0] or 0)
    near = g.adjacency.select("u", "v")
    state = None
    whole = None
    for d in range(last - 1, 0, -1):
        here = seen.filter(F.col("dist") == d).select("source", F.col("node").alias("u"), F.col("paths").alias("pu"))
        below = seen.filter(F.col("dist") == d + 1).select("source", F.col("node").alias("v"), F.col("paths").alias("pv"))
        if state is not None:
            below = below.join(state, ["source", "v"], "left")
        else:
            below = below.withColumn("part", F.lit(0.0))
        give = here.join(near, "u").join(below, ["source", "v"]).groupBy("source", "u").agg(F.sum(F.col("pu") / F.col("pv") * (1 + F.coalesce("part", F.lit(0.0)))).alias("part"))
        state = cut(give.select("source", F.col("u").alias("v"), "part"))
        whole = state if whole is None else whole.unionByName(state)
    if whole is None:
        return g.nodes.select(F.col("id").alias("node"), F.lit(0.0).alias("score"))
    return whole.groupBy(F.col("v").alias("node")).agg(F.sum("part").alias("score"))


def eccentricity(g: Graph, sources: DataFrame | None = None) -> DataFrame:
    """``(node, ecc, farthest)``: greatest distance and the least node at it."""
    per = pairs(g, sources, weighted=False).groupBy("source").agg(F.max(F.struct("dist", (-F.col("node")).alias("far"))).alias("m"))
    return per.select(F.col("source").alias("node"), F.col("m.dist").alias("ecc"), (-F.col("m.far")).alias("farthest"))


def diameter(g: Graph, weighted: bool = False) -> DataFrame:
    """``(diameter)`` over pairs that reach each other."""
    return pairs(g, weighted=weighted).agg(F.max("dist").alias("diameter"))


def effective_diameter(g: Graph, ratio: float = 0.9) -> DataFrame:
    """``(effective_diameter)``: average over nodes of the hops that reach ``ratio`` of all nodes."""
    n = g.nodes.count()
    layer = pairs(g, weighted=False).groupBy("source", "dist").agg(F.count("*").alias("c"))
    upto = layer.withColumn("s", F.sum("c").over(Window.partitionBy("source").orderBy("dist")))
    need = -(-int(ratio * n * 1_000_000) // 1_000_000)
    return upto.filter(F.col("s") >= need).groupBy("source").agg(F.min("dist").alias("d")).agg(F.avg("d").alias("effective_diameter"))


def neighborhood_function(g: Graph) -> DataFrame:
    """``(dist, pairs)``: ordered pairs of different nodes within each number of hops."""
    per = pairs(g, weighted=False).filter("dist > 0").groupBy("dist").agg(F.count("*").alias("c"))
    return per.select("dist", F.sum("c").over(Window.orderBy("dist")).alias("pairs"))  # a row for each distance


def hop_plot(g: Graph) -> DataFrame:
    """``(dist, share)``: share of all ordered pairs, a node with itself included."""
    n = g.nodes.count()
    per = pairs(g, weighted=False).groupBy("dist").agg(F.count("*").alias("c"))
    return per.select("dist", (F.sum("c").over(Window.orderBy("dist")) / (n * n)).alias("share"))  # a row for each distance


def reachable(g: Graph) -> DataFrame:
    """``(node, reachable)``, the node itself included."""
    if not g.directed:
        from weftgraph.operators.components import connected, sizes

        found = connected(g)
        return found.join(sizes(found), "component").select("node", F.col("size").alias("reachable"))
    return pairs(g, weighted=False).groupBy(F.col("source").alias("node")).agg(F.count("*").alias("reachable"))


def simple_paths(g: Graph, source: int, target: int, cutoff: int) -> DataFrame:
    """``(path)``: all paths without repeated nodes of ``cutoff`` edges at most; a path goes on only
    to nodes that can still reach the target in time."""
    spark = g.spark
    back = cut(bfs(g, spark.createDataFrame([(target,)], "id long"), incoming=True, limit=cutoff).select(F.col("node").alias("v"), F.col("dist").alias("rest")))
    near = cut(g.adjacency.select("u", "v").distinct().join(back, "v"))
    rows = spark.createDataFrame([([source],)], "path array<long>")
    found = None
    for k in range(1, cutoff + 1):
        step = rows.join(near, F.element_at("path", -1) == F.col("u")).filter(~F.array_contains("path", F.col("v")) & (F.col("rest") <= cutoff - k))
        step = cut(step.select(F.concat("path", F.array("v")).alias("path")))
        done = step.filter(F.element_at("path", -1) == target)
        found = done if found is None else found.unionByName(done)
        rows = step.filter(F.element_at("path", -1) != target)
    return found


def spanning_forest(g: Graph, heaviest: bool = False) -> DataFrame:
    """``(src, dst, w)`` of a forest of least (or greatest) weight, ties by ends: every component
    takes its best outgoing edge in a round, components are merged."""
    from weftgraph.operators.stars import star_components

    edges = cut(g.edges.filter("src <> dst").select("src", "dst", "w"))
    state = cut(g.nodes.select("id", F.col("id").alias("c")))
    order = F.struct((-F.col("w") if heaviest else F.col("w")).alias("w"), "src", "dst")
    found = None
    live = edges
    while True:
        live = cut(live.select("src", "dst", "w").join(state.select(F.col("id").alias("src"), F.col("c").alias("a")), "src").join(state.select(F.col("id").alias("dst"), F.col("c").alias("b")), "dst").filter("a <> b"))
        if not live.limit(1).count():
            return found if found is not None else edges.limit(0)
        both = live.withColumn("c", F.col("a")).unionByName(live.withColumn("c", F.col("b")))
        best = cut(both.groupBy("c").agg(F.min_by(F.struct("src", "dst", "w", "a", "b"), order).alias("e")).select("e.*").distinct())
        found = best.select("src", "dst", "w") if found is None else found.unionByName(best.select("src", "dst", "w"))
        joined = star_components(best, "a", "b").select(F.col("node").alias("c"), "component")
        state = cut(state.join(joined, "c", "left").select("id", F.coalesce("component", "c").alias("c")))


def matching(g: Graph) -> DataFrame:
    """``(src, dst, w)``: locally heaviest edges, a maximal matching of at least half the greatest
    weight; ties by ends. Each round keeps the edges both ends like best."""
    live = cut(g.edges.filter("src <> dst").groupBy("src", "dst").agg(F.max("w").alias("w")))
    found = None
    while live.limit(1).count():
        both = live.withColumn("u", F.col("src")).unionByName(live.withColumn("u", F.col("dst")))
        best = both.groupBy("u").agg(F.max(F.struct("w", "src", "dst")).alias("e"))
        picked = cut(best.groupBy("e").agg(F.count("*").alias("k")).filter("k = 2").select("e.src", "e.dst", "e.w"))
        found = picked if found is None else found.unionByName(picked)
        used = picked.select(F.col("src").alias("x")).unionByName(picked.select(F.col("dst").alias("x")))
        live = cut(live.join(used.withColumnRenamed("x", "src"), "src", "left_anti").join(used.withColumnRenamed("x", "dst"), "dst", "left_anti").select("src", "dst", "w"))
    return found if found is not None else live


def independent_set(g: Graph, seed: int = 1) -> DataFrame:
    """``(id)``: a maximal independent set; in each round nodes whose seeded random number is
    the least around them enter. Isolated nodes are in."""
    near = cut(g.adjacency.filter("u <> v").select("u", "v").distinct())
    if g.directed:
        near = cut(near.unionByName(near.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    left = cut(g.nodes)
    found, k = None, 0
    while left.limit(1).count():
        drawn = left.select("id", F.xxhash64(F.lit(seed), F.lit(k), "id").alias("r"))
        around = near.join(drawn.select(F.col("id").alias("v"), F.col("r").alias("rv")), "v").groupBy("u").agg(F.min(F.struct("rv", "v")).alias("m"))
        enter = cut(drawn.join(around, F.col("id") == F.col("u"), "left").filter(F.col("m").isNull() | (F.struct(F.col("r").alias("rv"), F.col("id").alias("v")) < F.col("m"))).select("id"))
        found = enter if found is None else found.unionByName(enter)
        out = enter.unionByName(near.join(enter, F.col("u") == F.col("id")).select(F.col("v").alias("id"))).distinct()
        left = cut(left.join(out, "id", "left_anti"))
        near = cut(near.join(left.withColumnRenamed("id", "u"), "u", "left_semi").join(left.withColumnRenamed("id", "v"), "v", "left_semi").select("u", "v"))
        k += 1
    return found if found is not None else left
