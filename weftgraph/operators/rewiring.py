"""Random graphs with the degrees of a given one."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.graph import Graph, canonical, numbered
from weftgraph.lineage import cut
from weftgraph.operators import kernels


def edge_switching(g: Graph, rounds: int = 10, seed: int = 1) -> Graph:
    """In each round all edges are paired at random and swap their far ends. A swap is undone that
    would make a loop, an edge that is there already or one that two pairs make; so the graph stays
    simple and all degrees stay. A round is one numbering and two joins, whatever the edges."""
    edges = cut(g.edges.select("src", "dst").filter("src <> dst").distinct())
    for k in range(rounds):
        drawn = edges.select("src", "dst", F.xxhash64(F.lit(seed), F.lit(k), "src", "dst").alias("r"))
        if not g.directed:  # which end is the far one is drawn too
            flip = F.pmod(F.col("r"), F.lit(2)) == 0
            drawn = drawn.select(F.when(flip, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(flip, F.col("dst")).otherwise(F.col("src")).alias("dst"), "r")
        at = numbered(drawn, ["r", "src", "dst"], "at").withColumn("pair", F.floor(F.col("at") / 2))
        two = cut(at.groupBy("pair").agg(F.collect_list(F.struct("src", "dst")).alias("e")))
        a, b = F.col("e")[0], F.get("e", F.lit(1))
        ends = lambda x, y: F.struct(x.alias("src"), y.alias("dst")) if g.directed else F.struct(F.greatest(x, y).alias("src"), F.least(x, y).alias("dst"))
        new = two.filter("size(e) = 2").select("pair", F.explode(F.array(ends(a["src"], b["dst"]), ends(b["src"], a["dst"]))).alias("n")).select("pair", "n.src", "n.dst")
        new = cut(new)
        taken = new.join(edges, ["src", "dst"], "left_semi").select("pair")
        twice = new.groupBy("src", "dst").agg(F.count("*").alias("c"), F.collect_set("pair").alias("p")).filter("c > 1").select(F.explode("p").alias("pair"))
        bad = taken.unionByName(twice).unionByName(new.filter("src = dst").select("pair")).distinct()
        fine = new.select("pair").distinct().join(bad, "pair", "left_anti")
        moved = new.join(fine, "pair", "left_semi").select("src", "dst")
        stay = two.join(fine, "pair", "left_anti").select(F.explode("e").alias("x")).select("x.src", "x.dst")
        stay = stay if g.directed else stay.select(*canonical())
        edges = cut(moved.unionByName(stay))
    return replace(g, edges=edges.withColumn("w", F.lit(1.0)), weighted=False)


def uniform_trades(spark: SparkSession, trades: int, n: int, seed: int = 1) -> DataFrame:
    """``(t, u, v)``: pairs of different nodes, uniformly."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.lit("u"), "id"), F.lit(n))
    v = F.pmod(F.xxhash64(F.lit(seed), F.lit("v"), "id"), F.lit(n - 1))
    return spark.range(trades).select(F.col("id").alias("t"), u.alias("u"), F.pmod(u + 1 + v, F.lit(n)).alias("v"))


def global_trades(spark: SparkSession, rounds: int, n: int, seed: int = 1) -> DataFrame:
    """``(t, u, v)``: in each round every node trades once (one is left over if they are odd)."""
    rows = spark.range(rounds * n).select(F.floor(F.col("id") / n).alias("round"), F.pmod("id", F.lit(n)).alias("node"))
    at = numbered(rows.withColumn("r", F.xxhash64(F.lit(seed), "round", "node")), ["round", "r", "node"], "at")
    place = F.col("at") - F.col("round") * n
    pair = at.withColumn("pair", F.floor(place / 2)).filter(place < n - n % 2).groupBy("round", "pair").agg(F.min("node").alias("u"), F.max("node").alias("v"))
    return pair.select((F.col("round") * (n // 2) + F.col("pair")).cast("long").alias("t"), "u", "v")


def curveball(g: Graph, trades: DataFrame | None = None, rounds: int = 20, seed: int = 1) -> Graph:
    """Trades of neighbours: two nodes put the neighbours that only one of them has together and deal
    them out again at random, each as many as before. Trades follow each other, so an undirected graph
    must fit one task; ``trades``: (t, u, v), else ``rounds`` global ones."""
    g = g.kept()
    if not kernels.small(g):
        raise ValueError("trades need a graph that fits one task; edge_switching does not")
    order = None
    if trades is not None:
        order = g.spark.sparkContext.broadcast([(r["u"], r["v"]) for r in trades.orderBy("t").toLocalIterator()])
    directed = g.directed

    def kernel(ids: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> dict:
        r = np.random.default_rng(seed)
        n = len(ids)
        near: list[set[int]] = [set() for _ in range(n)]
        for a, b in zip(u.tolist(), v.tolist(), strict=True):
            if a != b:
                near[a].add(b)
                if not directed:
                    near[b].add(a)
        if order is not None:
            deals = [tuple(np.searchsorted(ids, x).tolist()) for x in order.value]
        else:
            deals = [(int(p[i]), int(p[i + 1])) for p in (r.permutation(n) for _ in range(rounds)) for i in range(0, n - 1, 2)]
        for a, b in deals:
            one, two = sorted(near[a] - near[b] - {b}), sorted(near[b] - near[a] - {a})
            pool = r.permutation(one + two).tolist()
            for new, old, me in ((set(pool[: len(one)]), one, a), (set(pool[len(one) :]), two, b)):
                for x in set(old) - new:
                    near[me].discard(x)
                    if not directed:
                        near[x].discard(me)
                near[me] |= new
            if not directed:
                for me in (a, b):
                    for x in near[me]:
                        near[x].add(me)
        rows = [(a, b) for a in range(n) for b in near[a] if directed or a > b]
        return {"src": ids[np.array([a for a, _ in rows], np.int64)], "dst": ids[np.array([b for _, b in rows], np.int64)]}

    rows = kernels.whole(g, kernel, "src long, dst long")
    return replace(g, edges=cut(rows.withColumn("w", F.lit(1.0))), weighted=False)


def degree_shuffle(g: Graph, seed: int = 1) -> Graph:
    """Nodes of one (out- and in-) degree change places at random."""
    deg = g.degrees().select("id", "degree").join(g.degrees(incoming=True).select("id", F.col("degree").alias("into")), "id")
    was = numbered(deg, ["degree", "into", "id"], "at").select("at", "id")
    then = numbered(deg.withColumn("r", F.xxhash64(F.lit(seed), "id")), ["degree", "into", "r", "id"], "at").select("at", F.col("id").alias("new"))
    from weftgraph.operators.tools import remap

    return remap(g, cut(was.join(then, "at").select("id", "new")))


def congruential(n: int, seed: int = 0):
    """A bijection of the numbers below the prime that is n or the next one, as a function of a column."""
    p = n
    while any(p % q == 0 for q in range(2, int(p**0.5) + 1)) or p < 2:
        p += 1
    r = np.random.default_rng(seed)
    a, b = int(r.integers(1, p)), int(r.integers(0, p))
    return lambda x: F.pmod(x * a + b, F.lit(p))
