"""Link prediction over pairs ``(u, v)``, and its evaluation.

A score needs common neighbours only where there are some: wedges over the pairs asked for are
joined from both ends, never all pairs of nodes. Loops and repeated edges play no part; directed
graphs are refused. A pair of one node with itself scores 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.operators.triangles import simple_pairs


def _neighbours(g: Graph) -> tuple[DataFrame, DataFrame]:
    """``(u, x)`` both ways and ``(u, d)``."""
    if g.directed:
        raise ValueError("link prediction needs an undirected graph")
    pairs = simple_pairs(g)
    near = pairs.select(F.col("src").alias("u"), F.col("dst").alias("x")).unionByName(pairs.select(F.col("dst").alias("u"), F.col("src").alias("x")))
    return near, near.groupBy("u").agg(F.count("*").alias("d"))


def candidates(g: Graph) -> DataFrame:
    """``(u, v)``, u < v: pairs with a common neighbour and no edge, which are all that common-
    neighbour indices can tell apart."""
    near, _ = _neighbours(g)
    wedge = near.select(F.col("x").alias("m"), "u").join(near.select(F.col("x").alias("m"), F.col("u").alias("v")), "m").filter("u < v").select("u", "v").distinct()
    edges = simple_pairs(g).select(F.col("dst").alias("u"), F.col("src").alias("v"))
    return wedge.join(edges, ["u", "v"], "left_anti")


def missing_links(g: Graph, distance: int = 2) -> DataFrame:
    """``(u, v)``, u < v: pairs at exactly this distance."""
    near, _ = _neighbours(g)
    seen = near.select("u", F.col("x").alias("v"))
    ring = seen
    for _ in range(distance - 1):
        ring = ring.join(near.select(F.col("u").alias("v"), F.col("x").alias("y")), "v").select("u", F.col("y").alias("v")).filter("u <> v").distinct().join(seen, ["u", "v"], "left_anti")
        seen = seen.unionByName(ring)
    return ring.filter("u < v")


def indices(g: Graph, pairs: DataFrame) -> DataFrame:
    """``(u, v)`` with every neighbourhood index: common_neighbors, jaccard, adamic_adar,
    resource_allocation, preferential_attachment, total_neighbors, neighborhood_distance,
    adjusted_rand, u_degree, v_degree."""
    near, deg = _neighbours(g)
    wanted = pairs.select("u", "v").distinct()
    mid = near.join(deg.select(F.col("u").alias("x"), F.col("d").alias("dx")), "x")
    met = wanted.join(mid, "u").join(near.select(F.col("u").alias("v"), "x"), ["v", "x"]).filter("u <> v")
    common = met.groupBy("u", "v").agg(F.count("*").alias("c"), F.sum(1 / F.log("dx")).alias("aa"), F.sum(1 / F.col("dx")).alias("ra"))
    rows = wanted.join(deg.select("u", F.col("d").alias("du")), "u", "left").join(deg.select(F.col("u").alias("v"), F.col("d").alias("dv")), "v", "left").join(common, ["u", "v"], "left")
    n = g.nodes.agg(F.count("*").alias("n"))
    rows = rows.crossJoin(n).select("u", "v", "n", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("du", "dv", "c")], *[F.coalesce(x, F.lit(0.0)).alias(x) for x in ("aa", "ra")])  # one row
    c, du, dv = (F.col(x).cast("double") for x in ("c", "du", "dv"))
    union = du + dv - c
    same = F.col("u") == F.col("v")
    # As in the original measure's known form: both one-sided counts are taken of the union.
    a, b, d = c, union, F.col("n") - union
    below = (a + b) * (b + d) + (a + b) * (b + d)
    rand = F.when(below == 0, 0.0).otherwise(2 * (a * d - b * b) / below)

    def zero(x):
        return F.when(same, F.lit(0.0)).otherwise(x)

    return rows.select(
        "u", "v",
        zero(c).alias("common_neighbors"),
        zero(F.when(union == 0, 0.0).otherwise(c / union)).alias("jaccard"),
        zero(F.col("aa")).alias("adamic_adar"),
        zero(F.col("ra")).alias("resource_allocation"),
        zero(du * dv).alias("preferential_attachment"),
        zero(union).alias("total_neighbors"),
        zero(F.when(du * dv == 0, 0.0).otherwise(c / F.sqrt(du * dv))).alias("neighborhood_distance"),
        zero(rand).alias("adjusted_rand"),
        zero(du).alias("u_degree"),
        zero(dv).alias("v_degree"),
    )


def neighbors_measure(g: Graph, pairs: DataFrame) -> DataFrame:
    """``(u, v, score)``: pairs of neighbours x of u and y of v that are equal or adjacent."""
    near, _ = _neighbours(g)
    wanted = pairs.select("u", "v").distinct().filter("u <> v")
    reach = near.select(F.col("u").alias("x"), F.col("x").alias("y")).unionByName(near.select("u").distinct().select(F.col("u").alias("x"), F.col("u").alias("y")))
    met = wanted.join(near, "u").join(reach, "x").join(near.select(F.col("u").alias("v"), F.col("x").alias("y")), ["v", "y"])
    found = met.groupBy("u", "v").agg(F.count("*").cast("double").alias("score"))
    return pairs.select("u", "v").distinct().join(found, ["u", "v"], "left").select("u", "v", F.coalesce("score", F.lit(0.0)).alias("score"))


def katz_index(g: Graph, pairs: DataFrame, longest: int = 5, damping: float = 0.005) -> DataFrame:
    """``(u, v, score)``: damped hits of v from the end with fewer neighbours. A level counts how
    many distinct nodes of the last frontier lead to v, so these are not path counts."""
    near, deg = _neighbours(g)
    wanted = pairs.select("u", "v").distinct()
    rows = wanted.join(deg.select("u", F.col("d").alias("du")), "u", "left").join(deg.select(F.col("u").alias("v"), F.col("d").alias("dv")), "v", "left").na.fill(0, ["du", "dv"])
    turned = F.col("du") > F.col("dv")
    rows = rows.select("u", "v", F.when(turned, F.col("v")).otherwise(F.col("u")).alias("s"), F.when(turned, F.col("u")).otherwise(F.col("v")).alias("t"))
    frontier = rows.select("s", F.col("s").alias("x")).distinct()
    hits = None
    for level in range(1, longest + 1):
        step = frontier.join(near.select(F.col("u").alias("x"), F.col("x").alias("t")), "x").groupBy("s", "t").agg(F.count("*").alias("k"))
        part = step.select("s", "t", (F.col("k") * damping**level).alias("part"))
        hits = part if hits is None else hits.unionByName(part)
        frontier = step.select("s", F.col("t").alias("x"))
    score = hits.groupBy("s", "t").agg(F.sum("part").alias("score"))
    return rows.join(score, ["s", "t"], "left").select("u", "v", F.when(F.col("u") == F.col("v"), 0.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"))


def same_community(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    a, b = blocks.select(F.col("node").alias("u"), F.col("block").alias("bu")), blocks.select(F.col("node").alias("v"), F.col("block").alias("bv"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", (F.col("bu") == F.col("bv")).cast("double").alias("score"))


def by_score(scored: DataFrame, least: float) -> DataFrame:
    return scored.filter(F.col("score") >= least).select("u", "v")


def by_count(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best pairs, ties by pair."""
    return scored.orderBy(F.col("score").desc(), "u", "v").limit(k).select("u", "v")


def by_percentage(scored: DataFrame, share: float) -> DataFrame:
    return by_count(scored, round(scored.count() * share))


def training_graph(g: Graph, share: float, seed: int = 1) -> Graph:
    """A random part of the edges, all nodes kept."""
    from weftgraph.operators.tools import random_edges

    return Graph(g.nodes, random_edges(g, round(g.edges.count() * share), seed), g.directed, g.weighted)


def confusion(scored: DataFrame, links: DataFrame, points: int = 100) -> DataFrame:
    """``(threshold, tp, fp, tn, fn)``: counts when the best ``threshold`` predictions are taken as
    links, at ``points`` thresholds from 0 to all, spread evenly."""
    real = links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().withColumn("real", F.lit(1))
    rows = scored.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "score").join(real, ["u", "v"], "left").select("u", "v", "score", F.coalesce("real", F.lit(0)).alias("real"))
    order = Window.orderBy(F.col("score").desc(), "u", "v")  # predictions are a report's rows
    place = rows.select(F.row_number().over(order).alias("threshold"), F.sum("real").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("tp"))
    start = scored.sparkSession.createDataFrame([(0, 0)], "threshold int, tp long")
    whole = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("real"), F.lit(0)).alias("p"))
    steps = whole.select("n", "p", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).select("n", "p", F.ceil(F.col("n") * F.col("i") / (points - 1)).cast("int").alias("threshold")).distinct()
    got = steps.join(place.unionByName(start), "threshold")
    return got.select("threshold", "tp", (F.col("threshold") - F.col("tp")).alias("fp"), (F.col("n") - F.col("p") - F.col("threshold") + F.col("tp")).alias("tn"), (F.col("p") - F.col("tp")).alias("fn"))


def roc(counts: DataFrame) -> DataFrame:
    """``(x, y)``: false and true positive rates; of points with one x the greatest y."""
    x = F.when(F.col("fp") + F.col("tn") > 0, F.col("fp") / (F.col("fp") + F.col("tn"))).otherwise(0.0)
    y = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    return counts.select(x.alias("x"), y.alias("y")).groupBy("x").agg(F.max("y").alias("y"))


def precision_recall(counts: DataFrame) -> DataFrame:
    """``(x, y)``: recall and precision, 1 where undefined."""
    x = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(1.0)
    y = F.when(F.col("threshold") > 0, F.col("tp") / F.col("threshold")).otherwise(1.0)
    return counts.select("threshold", x.alias("x"), y.alias("y")).groupBy("x").agg(F.max_by("y", F.col("threshold")).alias("y"))


def area(points: DataFrame) -> DataFrame:
    """``(area)`` under the points, by trapezoids."""
    order = Window.orderBy("x")  # at most as many rows as thresholds
    width, height = F.col("x") - F.lag("x").over(order), (F.col("y") + F.lag("y").over(order)) / 2
    return points.select((width * height).alias("a")).agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("area"))
