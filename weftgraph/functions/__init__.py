"""Figures of tables of scores, as plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.graph import Graph, numbered


def gini(scores: DataFrame, score: str = "score") -> DataFrame:
    """``(gini)`` of non-negative values: twice the rank-weighted sum over n times the sum, less
    (n + 1) / n. Ranks are distributed; those of equal values do not matter."""
    at = numbered(scores.select(F.col(score).cast("double").alias("x")), ["x"], "i", 1)
    n, s = F.count("*"), F.sum("x")
    return at.agg(F.when(s > 0, 2 * F.sum(F.col("x") * F.col("i")) / (n * s) - (n + 1) / n).otherwise(0.0).alias("gini"))


def ranked(scores: DataFrame, key: str = "node", score: str = "score") -> DataFrame:
    """``(key, rank)``: mean rank among equal scores, greatest first, from one row for each score."""
    by = scores.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("c"))
    before = Window.orderBy(F.col("s").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row for each different score
    rank = by.select("s", (F.coalesce(F.sum("c").over(before), F.lit(0)) + (F.col("c") + 1) / 2).alias("rank"))
    return scores.join(rank, F.col(score) == F.col("s")).select(key, "rank")


def correlation(a: DataFrame, b: DataFrame, kind: str = "spearman", key: str = "node") -> DataFrame:
    """``(correlation)`` of two tables of scores: pearson, or spearman (of mean ranks)."""
    if kind == "spearman":
        a, b = ranked(a, key).withColumnRenamed("rank", "score"), ranked(b, key).withColumnRenamed("rank", "score")
    return a.select(key, F.col("score").alias("x")).join(b.select(key, F.col("score").alias("y")), key).agg(F.corr("x", "y").alias("correlation"))


def rank_errors(a: DataFrame, b: DataFrame, key: str = "node") -> DataFrame:
    """``(key, error)``: rank in the second over rank in the first."""
    x, y = ranked(a, key).withColumnRenamed("rank", "x"), ranked(b, key).withColumnRenamed("rank", "y")
    return x.join(y, key).select(key, (F.col("y") / F.col("x")).alias("error"))


def summary(scores: DataFrame, score: str = "score") -> DataFrame:
    """``(n, least, q1, median, q3, most, mean, deviation, skewness, kurtosis)``"""
    s = F.col(score)
    q = lambda p: F.percentile_approx(s, F.lit(p), F.lit(10000))
    return scores.agg(F.count(s).alias("n"), F.min(s).alias("least"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.max(s).alias("most"), F.avg(s).alias("mean"), F.stddev_samp(s).alias("deviation"), F.skewness(s).alias("skewness"), F.kurtosis(s).alias("kurtosis"))


def per_degree(g: Graph, scores: DataFrame) -> DataFrame:
    """``(degree, score, n)``: mean score of the nodes of each degree."""
    return g.degrees().join(scores.select(F.col("node").alias("id"), "score"), "id").groupBy("degree").agg(F.avg("score").alias("score"), F.count("*").alias("n"))


def core_sequence(cores: DataFrame) -> DataFrame:
    """``(core, n)``: nodes in each core, which lie in one another."""
    by = cores.groupBy(F.col("score").cast("long").alias("core")).agg(F.count("*").alias("c"))
    return by.select("core", F.sum("c").over(Window.orderBy(F.col("core").desc())).alias("n"))  # a row for each core number


def profile(g: Graph) -> DataFrame:
    """``(measure, n, least, ..., gini)``: figures of degree, clustering, PageRank and core number, a row
    for each."""
    from weftgraph.operators import centrality

    g = g.kept()
    found = {"degree": centrality.degree(g), "clustering": centrality.local_clustering(g), "pagerank": centrality.pagerank(g), "core": centrality.core(g)}
    rows = [summary(s).crossJoin(gini(s)).select(F.lit(k).alias("measure"), "*") for k, s in found.items()]  # one row each
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
