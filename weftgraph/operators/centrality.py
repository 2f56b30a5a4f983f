"""Centralities that are one plan, or a loop of one join and one aggregate for each round."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.lineage import cut
from weftgraph.operators.triangles import node_triangles
from weftgraph.operators import kernels

EVERY = 5  # rounds between lineage cuts


def degree(g: Graph, normalized: bool = False, incoming: bool = False, loops: bool = False) -> DataFrame:
    """``(node, score)``. Normalised by n - 1 if the graph has loops that are not counted, else by n."""
    found = g.degrees(incoming=incoming, loops=loops).select(F.col("id").alias("node"), F.col("degree").cast("double").alias("score"))
    if not normalized:
        return found
    n = g.nodes.agg(F.count("*").alias("n"))
    has = g.edges.agg((F.count(F.when(F.col("src") == F.col("dst"), 1)) > 0).alias("has"))
    by = F.when(F.col("has") & F.lit(not loops), F.col("n") - 1).otherwise(F.col("n"))
    return found.crossJoin(n).crossJoin(has).select("node", (F.col("score") / by).alias("score"))  # one row each


def _total(df: DataFrame, value: Column) -> float:
    return df.agg(value).first()[0] or 0.0


def pagerank(g: Graph, damp: float = 0.85, tol: float = 1e-8, normalized: bool = False, iterations: int | None = None) -> DataFrame:
    """``(node, score)``. The mass of nodes without out-edges is dropped and scores are scaled to
    sum 1 at the end, or, normalised, divided by what a node without in-edges would have."""
    g = g.kept()
    n = g.nodes.count()
    if not n:
        return g.nodes.select(F.col("id").alias("node"), F.lit(0.0).alias("score"))
    if kernels.small(g):
        return kernels.whole(g, kernels.pagerank(g.directed, damp, tol, iterations, normalized), "node long, score double")
    out = g.adjacency.groupBy("u").agg(F.sum("w").alias("total"))
    share = cut(g.adjacency.join(out, "u").select("u", "v", (F.col("w") / F.col("total")).alias("share")))
    score = g.nodes.select(F.col("id").alias("node"), F.lit(1.0 / n).alias("score"))
    for at in range(0, iterations or 1000, EVERY):
        for _ in range(min(EVERY, (iterations or 1000) - at)):  # rounds that one job computes
            got = share.join(score.select("node", "score"), F.col("u") == F.col("node")).groupBy("v").agg(F.sum(F.col("score") * F.col("share")).alias("got"))
            old = score.select("node", F.col("score").alias("old"))
            score = old.join(got, F.col("node") == F.col("v"), "left").select("node", "old", (damp * F.coalesce("got", F.lit(0.0)) + (1 - damp) / n).alias("score"))
        score = cut(score)
        if iterations is None and math.sqrt(_total(score, F.sum((F.col("score") - F.col("old")) ** 2))) <= tol:
            break
    score = score.select("node", "score")
    if normalized:
        sinks = g.nodes.join(out, F.col("id") == F.col("u"), "left_anti").withColumnRenamed("id", "node")
        base = (1 - damp + damp * _total(score.join(sinks, "node"), F.sum("score"))) / n
        return score.select("node", (F.col("score") / base).alias("score"))
    whole = _total(score, F.sum("score"))
    return score.select("node", (F.col("score") / whole).alias("score"))


def eigenvector(g: Graph, tol: float = 1e-9, iterations: int | None = None) -> DataFrame:
    """``(node, score)``: power iteration over in-edges from all ones; it stops when the lengths of
    two vectors in a row differ by ``tol`` at most."""
    return _power(g, lambda s: F.coalesce(s, F.lit(0.0)), lambda w, x: w * x, tol, iterations, True)


def katz(g: Graph, alpha: float | None = None, beta: float = 0.1, tol: float = 1e-8, iterations: int | None = None) -> DataFrame:
    """``(node, score)``: ``x = beta + sum over in-edges of w * alpha * (1 + x)``, scaled to length 1
    at the end; alpha defaults to 1 / (1 + greatest degree)."""
    if alpha is None:
        alpha = 1 / (1 + (g.degrees().agg(F.max("degree")).first()[0] or 0))
    return _power(g, lambda s: beta + alpha * F.coalesce(s, F.lit(0.0)), lambda w, x: w * (1 + x), tol, iterations, False, alpha, beta)


def _power(g: Graph, value, term, tol: float, iterations: int | None, scale: bool, alpha: float = 0.0, beta: float = 0.0) -> DataFrame:
    g = g.kept()
    if kernels.small(g):
        return kernels.whole(g, kernels.power(g.directed, alpha, beta, tol, iterations, scale), "node long, score double")
    score = g.nodes.select(F.col("id").alias("node"), F.lit(1.0).alias("score"))
    before = math.sqrt(g.nodes.count())
    length = before
    for at in range(0, iterations or 1000, EVERY):
        steps = min(EVERY, (iterations or 1000) - at)
        for _ in range(steps):  # rounds that one job computes; they are linear, so lengths can wait
            got = g.reverse.join(score, F.col("v") == F.col("node")).groupBy("u").agg(F.sum(term(F.col("w"), F.col("score"))).alias("got"))
            score = score.select("node").join(got, F.col("node") == F.col("u"), "left").select("node", value(F.col("got")).alias("score"))
        score = cut(score)
        length = math.sqrt(_total(score, F.sum(F.col("score") ** 2)))
        if scale and length:
            score = score.select("node", (F.col("score") / length).alias("score"))
            length **= 1 / steps  # the mean growth of a round
        if iterations is None and abs(length - before) <= tol:
            break
        before = length
    return score if scale or not length else score.select("node", (F.col("score") / length).alias("score"))


def laplacian(g: Graph, normalized: bool = False) -> DataFrame:
    """``(node, score)``: drop of the Laplacian energy; weighted degrees are cut to whole numbers."""
    deg = g.degrees().select("id", F.floor("weighted").alias("d"))
    near = g.adjacency.join(deg, F.col("v") == F.col("id")).groupBy("u").agg(F.sum(F.col("w") * (F.col("w") + 2 * F.col("d"))).alias("near"), F.sum(F.col("w") * F.col("w")).alias("squares"))
    rows = deg.join(near, F.col("id") == F.col("u"), "left")
    score = rows.select(F.col("id").alias("node"), (F.col("d") * F.col("d") + F.coalesce("near", F.lit(0.0))).alias("score"), (F.col("d") * F.col("d") + F.coalesce("squares", F.lit(0.0))).alias("energy"))
    if not normalized:
        return score.select("node", "score")
    whole = score.agg(F.sum("energy").alias("whole"))
    return score.crossJoin(whole).select("node", (F.col("score") / F.col("whole")).alias("score"))  # one row


def sfigality(g: Graph) -> DataFrame:
    """``(node, score)``: share of neighbours with a higher degree; null for isolated nodes."""
    deg = g.degrees().select("id", "degree")
    a, b = deg.select(F.col("id").alias("u"), F.col("degree").alias("du")), deg.select(F.col("id").alias("v"), F.col("degree").alias("dv"))
    got = g.adjacency.join(a, "u").join(b, "v").groupBy("u").agg(F.avg((F.col("du") < F.col("dv")).cast("double")).alias("score"))
    return g.nodes.join(got, F.col("id") == F.col("u"), "left").select(F.col("id").alias("node"), "score")


def local_clustering(g: Graph) -> DataFrame:
    """``(node, score)``: closed pairs of neighbours over all; 0 below two neighbours."""
    deg = g.degrees().select("id", "degree")
    t = node_triangles(g)
    d = F.col("degree").cast("double")
    score = F.when(F.col("degree") < 2, 0.0).otherwise(2 * F.coalesce("triangles", F.lit(0)) / (d * (d - 1)))
    return deg.join(t, F.col("id") == F.col("node"), "left").select(F.col("id").alias("node"), score.alias("score"))


def partition_coverage(g: Graph, blocks: DataFrame) -> DataFrame:
    """``(node, score)``: share of a node's weight that stays in its block; blocks ``(node, block)``."""
    a, b = blocks.select(F.col("node").alias("u"), F.col("block").alias("bu")), blocks.select(F.col("node").alias("v"), F.col("block").alias("bv"))
    got = g.adjacency.join(a, "u").join(b, "v").groupBy("u").agg((F.sum(F.when(F.col("bu") == F.col("bv"), F.col("w")).otherwise(0.0)) / F.sum("w")).alias("score"))
    return g.nodes.join(got, F.col("id") == F.col("u"), "left").select(F.col("id").alias("node"), F.coalesce("score", F.lit(0.0)).alias("score"))


def permanence(g: Graph, blocks: DataFrame) -> DataFrame:
    """``(node, score)``: ``I / (Emax * degree) - (1 - cin)``: neighbours inside over the most in
    another block (at least 1), less the share of open pairs of neighbours inside."""
    a, b = blocks.select(F.col("node").alias("u"), F.col("block").alias("bu")), blocks.select(F.col("node").alias("v"), F.col("block").alias("bv"))
    both = g.adjacency.filter("u <> v").join(a, "u").join(b, "v")
    per = both.groupBy("u", "bu", "bv").agg(F.count("*").alias("c"))
    near = per.groupBy("u").agg(
        F.coalesce(F.sum(F.when(F.col("bu") == F.col("bv"), F.col("c"))), F.lit(0)).alias("inside"),
        F.greatest(F.coalesce(F.max(F.when(F.col("bu") != F.col("bv"), F.col("c"))), F.lit(1)), F.lit(1)).alias("most"),
        F.sum("c").alias("d"),
    )
    within = both.filter("bu = bv").select(F.greatest("u", "v").alias("src"), F.least("u", "v").alias("dst")).distinct().withColumn("w", F.lit(1.0))
    t = node_triangles(Graph(g.nodes, within))
    i = F.col("inside").cast("double")
    cin = F.when(i < 2, 0.0).otherwise(2 * F.coalesce("triangles", F.lit(0)) / (i * (i - 1)))
    rows = near.join(t, F.col("u") == F.col("node"), "left")
    got = rows.select("u", (i / F.col("most") / F.col("d") - (1 - cin)).alias("score"))
    return g.nodes.join(got, F.col("id") == F.col("u"), "left").select(F.col("id").alias("node"), "score")


def core(g: Graph, normalized: bool = False) -> DataFrame:
    """``(node, score)``: core numbers, by lowering each node's value to the h-index of its
    neighbours' values until nothing moves. Graphs with self-loops are refused."""
    if g.edges.filter("src = dst").limit(1).count():
        raise ValueError("core numbers need a graph without self-loops")
    g = g.kept()
    if kernels.small(g):
        found = kernels.whole(g, kernels.cores, "node long, score double")
    else:
        found = _cores(g)
    if normalized:
        found = found.crossJoin(found.agg(F.max("score").alias("most"))).select("node", (F.col("score") / F.col("most")).alias("score"))  # one row
    return found


def _cores(g: Graph) -> DataFrame:
    state = cut(g.degrees().select(F.col("id").alias("node"), F.col("degree").alias("c")))
    while True:
        seen = g.adjacency.join(state, F.col("v") == F.col("node")).groupBy("u", "c").agg(F.count("*").alias("k"))
        # h-index: the greatest c with at least c neighbours of value c or more, from the histogram.
        falling = F.reverse(F.array_sort(F.collect_list(F.struct("c", "k"))))
        step = F.aggregate(
            falling,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("h")),
            lambda a, x: F.struct((a["n"] + x["k"]).alias("n"), F.greatest(a["h"], F.least(a["n"] + x["k"], x["c"])).alias("h")),
        )
        h = seen.groupBy("u").agg(step["h"].alias("h"))
        new = cut(state.join(h, F.col("node") == F.col("u"), "left").select("node", F.least("c", F.coalesce("h", F.lit(0))).alias("c"), (F.coalesce("h", F.lit(0)) < F.col("c")).alias("moved")))
        state = new.select("node", "c")
        if not new.filter("moved").limit(1).count():
            break
    return state.select("node", F.col("c").cast("double").alias("score"))


def centralization(scores: DataFrame, most: float) -> DataFrame:
    """``(centralization)``: distance of all scores from the greatest over that from ``most``."""
    top = scores.agg(F.max("score").alias("top"))
    return scores.crossJoin(top).agg((F.sum(F.col("top") - F.col("score")) / F.sum(F.lit(float(most)) - F.col("score"))).alias("centralization"))  # one row
