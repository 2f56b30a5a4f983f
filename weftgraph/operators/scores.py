"""Edge scores and sparsification. Scores are ``(src, dst, w, score)``."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.graph import Graph, spread
from weftgraph.lineage import cut
from weftgraph.operators.triangles import common_degrees, edge_triangles


def _ends(g: Graph, rows: DataFrame) -> DataFrame:
    deg = g.degrees().select("id", "degree")
    return rows.join(deg.select(F.col("id").alias("src"), F.col("degree").alias("ds")), "src").join(deg.select(F.col("id").alias("dst"), F.col("degree").alias("dd")), "dst")


def jaccard_distance(g: Graph) -> DataFrame:
    """1 less common neighbours over all neighbours of the two ends."""
    t = F.col("score")
    return _ends(g, edge_triangles(g)).select("src", "dst", "w", (1 - t / (F.col("ds") + F.col("dd") - t)).alias("score"))


def adamic_adar_distance(g: Graph) -> DataFrame:
    """1 over the sum of 1 / ln(degree) of the common neighbours; infinite without any."""
    g = g.kept()
    s = common_degrees(g, g.degrees().select("id", "degree"), _by_log).withColumnRenamed("total", "s")
    return g.edges.join(s, ["src", "dst"], "left").select("src", "dst", "w", F.coalesce(1 / F.col("s"), F.lit(float("inf"))).alias("score"))


def _by_log(degree: np.ndarray) -> np.ndarray:
    some, at = np.unique(degree, return_inverse=True)
    return np.array([1 / math.log(d) for d in some.tolist()])[at]  # numpy's logarithm has other last bits now and then


def scan_similarity(g: Graph) -> DataFrame:
    return _ends(g, edge_triangles(g)).select("src", "dst", "w", ((F.col("score") + 1) / F.sqrt((F.col("ds") + 1) * (F.col("dd") + 1))).alias("score"))


def chance_corrected_triangles(g: Graph) -> DataFrame:
    n = g.nodes.agg(F.count("*").alias("n"))
    t, a, b = F.col("score"), F.col("ds") - 1, F.col("dd") - 1
    score = F.when(t > 0, t * (F.col("n") - 2) / (a * b)).when((a == 0) | (b == 0), 1.0).otherwise(0.0)
    return _ends(g, edge_triangles(g)).crossJoin(n).select("src", "dst", "w", score.alias("score"))  # one row


def geometric_mean(scored: DataFrame) -> DataFrame:
    """A score over the root of the product of its ends' sums."""
    both = scored.select(F.col("src").alias("u"), "score").unionByName(scored.filter("src <> dst").select(F.col("dst").alias("u"), "score"))
    s = both.groupBy("u").agg(F.sum("score").alias("s"))
    rows = scored.join(s.select(F.col("u").alias("src"), F.col("s").alias("a")), "src").join(s.select(F.col("u").alias("dst"), F.col("s").alias("b")), "dst")
    return rows.select("src", "dst", "w", F.when(F.col("score") > 0, F.col("score") / F.sqrt(F.col("a") * F.col("b"))).otherwise(0.0).alias("score"))


def normalize(scored: DataFrame, lower: float = 0.0, upper: float = 1.0, invert: bool = False) -> DataFrame:
    ends = scored.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    part = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    part = 1 - part if invert else part
    return scored.crossJoin(ends).select("src", "dst", "w", (lower + part * (upper - lower)).alias("score"))  # one row


def linearize(scored: DataFrame, seed: int = 1, invert: bool = False) -> DataFrame:
    """Ranks spread over [0, 1], ties in a seeded random order; 0.5 for a single edge."""
    from weftgraph.graph import numbered

    keyed = scored.withColumn("_r", F.xxhash64(F.lit(seed), "src", "dst")).withColumn("_s", -F.col("score") if invert else F.col("score"))
    m = scored.count()
    at = numbered(keyed, ["_s", "_r", "src", "dst"], "_at")
    return at.select("src", "dst", "w", (F.col("_at") / (m - 1) if m > 1 else F.lit(0.5)).alias("score"))


def blend(a: DataFrame, b: DataFrame, chosen: DataFrame) -> DataFrame:
    """``b``'s score for the chosen edges ``(src, dst)``, else ``a``'s."""
    other = b.select("src", "dst", F.col("score").alias("_b")).join(chosen.select("src", "dst"), ["src", "dst"], "left_semi")
    return a.join(other, ["src", "dst"], "left").select("src", "dst", "w", F.coalesce("_b", "score").alias("score"))


def as_weight(g: Graph, scored: DataFrame, squared: bool = False, offset: float = 1.0, factor: float = 1.0) -> Graph:
    s = F.col("score") * F.col("score") if squared else F.col("score")
    return replace(g, edges=scored.select("src", "dst", (offset + factor * s).alias("w")), weighted=True)


def random_score(g: Graph, seed: int) -> DataFrame:
    return g.edges.select("src", "dst", "w", (F.pmod(F.xxhash64(F.lit(seed), "src", "dst"), F.lit(1 << 52)) / (1 << 52)).alias("score"))


def _sides(rows: DataFrame) -> DataFrame:
    """Each edge from both ends: ``(src, dst, w, u, v, …)``."""
    return rows.withColumn("u", F.col("src")).withColumn("v", F.col("dst")).unionByName(rows.withColumn("u", F.col("dst")).withColumn("v", F.col("src")))


def local_degree(g: Graph) -> DataFrame:
    """The greater, over both ends, of 1 - ln(rank) / ln(degree), where neighbours are ranked by
    their degrees, ties alike."""
    g = g.kept()
    parts = spread(g.spark, g.edges.count())
    deg = cut(g.degrees().select("id", "degree"))
    a, b = deg.select(F.col("id").alias("src"), F.col("degree").alias("ds")), deg.select(F.col("id").alias("dst"), F.col("degree").alias("dd"))
    # An edge gets both degrees before it is taken from both ends.
    known = g.edges.select("src", "dst", "w").repartition(parts, "src").join(a, "src").repartition(parts, "dst").join(b, "dst")
    sides = [F.struct(F.col(u).alias("u"), F.col(du).alias("du"), F.col(dv).alias("dv")) for u, du, dv in (("src", "ds", "dd"), ("dst", "dd", "ds"))]
    both = known.select("src", "dst", "w", F.explode(F.array(*sides)).alias("e")).select("src", "dst", "w", "e.*").repartition(2 * parts, "u")
    rank = F.rank().over(Window.partitionBy("u").orderBy(F.col("dv").desc()))
    score = F.when(F.col("du") > 1, 1 - F.log("r") / F.log("du")).otherwise(1.0)
    scored = both.withColumn("r", rank).select("src", "dst", "w", score.alias("score"))
    return scored.repartition(2 * parts, "src", "dst").groupBy("src", "dst", "w").agg(F.max("score").alias("score"))


def local_filter(scored: DataFrame, logarithmic: bool = True) -> DataFrame:
    """The same over the ranks of any score."""
    both = _sides(scored)
    w = Window.partitionBy("u")
    ranked = both.withColumn("r", F.rank().over(w.orderBy(F.col("score").desc()))).withColumn("d", F.count("*").over(w))
    part = 1 - F.log("r") / F.log("d") if logarithmic else 1 - (F.col("r") - 1) / (F.col("d") - 1)
    return ranked.groupBy("src", "dst", "w").agg(F.max(F.when(F.col("d") > 1, part).otherwise(1.0)).alias("score"))


def multiscale(scored: DataFrame) -> DataFrame:
    """The greater, over both ends, of 1 - (1 - share)^(degree - 1), share being the edge's part of
    its end's sum of scores."""
    both = _sides(scored)
    sums = both.groupBy("u").agg(F.sum("score").alias("s"), F.count("*").alias("d"))
    rows = both.join(sums, "u")
    return rows.groupBy("src", "dst", "w").agg(F.max(1 - F.pow(1 - F.col("score") / F.col("s"), F.col("d") - 1)).alias("score"))


def simmelian_overlap(g: Graph, most: int) -> DataFrame:
    """Common neighbours among the ``most`` first ranks of both ends, neighbours ranked by
    triangles over the edge to them, ties alike."""
    t = edge_triangles(g)
    rank = F.rank().over(Window.partitionBy("u").orderBy(F.col("score").desc()))
    top = _sides(t).select("u", "v", rank.alias("r")).filter(F.col("r") <= most).select("u", F.col("v").alias("x"))
    met = g.edges.select("src", "dst").join(top.select(F.col("u").alias("src"), "x"), "src").join(top.select(F.col("u").alias("dst"), "x"), ["dst", "x"])
    c = met.filter("x <> src AND x <> dst").groupBy("src", "dst").agg(F.count("*").alias("score"))
    return g.edges.join(c, ["src", "dst"], "left").select("src", "dst", "w", F.coalesce("score", F.lit(0)).cast("double").alias("score"))


def keep(g: Graph, scored: DataFrame, threshold: float, above: bool = True) -> Graph:
    """The sparsified graph: edges on the right side of the threshold, all nodes."""
    c = F.col("score") >= threshold if above else F.col("score") <= threshold
    return replace(g, edges=scored.filter(c).select("src", "dst", "w"))


def keep_share(g: Graph, scored: DataFrame, share: float) -> Graph:
    """The ``share`` of edges with the greatest scores, ties by ends."""
    k = round(g.edges.count() * share)
    return replace(g, edges=scored.orderBy(F.col("score").desc(), "src", "dst").limit(k).select("src", "dst", "w"))
