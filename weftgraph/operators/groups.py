"""Central groups of nodes: greedy choices whose rounds score all candidates at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.lineage import cut
from weftgraph.operators import distances, kernels


def _ids(spark, group: list[int]) -> DataFrame:
    return spark.createDataFrame([(x,) for x in group], "id long")


def degree_score(g: Graph, group: list[int], own: bool = True) -> int:
    """Nodes that a group covers: its neighbours, and itself if ``own``."""
    chosen = _ids(g.spark, group)
    around = g.adjacency.join(chosen.withColumnRenamed("id", "u"), "u", "left_semi").select(F.col("v").alias("id")).distinct()
    rest = around.join(chosen, "id", "left_anti").count()
    return rest + (len(set(group)) if own else 0)


def group_degree(g: Graph, k: int, own: bool = True) -> list[int]:
    """``k`` nodes that cover most others, each the best addition, ties by id. A round is one join of
    the edges with the uncovered nodes and one partial aggregate."""
    near = cut(g.adjacency.filter("u <> v").select("u", "v").distinct())
    left, group = cut(g.nodes), []
    for _ in range(k):
        gain = near.join(left.withColumnRenamed("id", "v"), "v").groupBy("u").agg(F.count("*").alias("n"))
        options = g.nodes.join(_ids(g.spark, group), "id", "left_anti") if group else g.nodes
        scored = options.join(gain, F.col("id") == F.col("u"), "left").join(left.select("id", F.lit(1).alias("bare")), "id", "left")
        total = F.coalesce("n", F.lit(0)) + (F.coalesce("bare", F.lit(0)) if own else 0)
        best = scored.orderBy(total.desc(), "id").limit(1).first()
        if best is None:
            break
        group.append(best["id"])
        hit = near.filter(F.col("u") == best["id"]).select(F.col("v").alias("id")).unionByName(_ids(g.spark, [best["id"]]))
        left = cut(left.join(hit, "id", "left_anti"))
    return group


def _distance_to(g: Graph, group: list[int]) -> DataFrame:
    """``(node, dist)`` to the nearest member; nodes without one are left out."""
    found = distances.bfs(g, _ids(g.spark, group))
    return found.groupBy("node").agg(F.min("dist").alias("dist"))


def closeness_score(g: Graph, group: list[int]) -> float:
    """(n - size) over the sum of distances to the group."""
    total = _distance_to(g, group).agg(F.sum("dist")).first()[0] or 0.0
    return (g.nodes.count() - len(set(group))) / total if total else 0.0


def harmonic_score(g: Graph, group: list[int]) -> float:
    """Sum of 1 over the distance to the group, over nodes outside it."""
    return _distance_to(g, group).filter("dist > 0").agg(F.sum(1 / F.col("dist"))).first()[0] or 0.0


def _scored(g: Graph, group: list[int], harmonic: bool) -> DataFrame:
    """``(node, score)`` of the group with each candidate added: one search from every candidate, which
    ends where the group is nearer."""
    csr_free = g.spark.sparkContext.broadcast(group)

    def kernel(csr: kernels.Csr, at: np.ndarray) -> Iterator[dict]:
        n = len(csr.ids)
        near = np.full(n, np.inf)
        for x in csr_free.value:
            d = csr.hops(int(np.searchsorted(csr.ids, x)))[0]
            near = np.minimum(near, np.where(d < 0, np.inf, d))
        out = []
        for s in at.tolist():
            d = csr.hops(s)[0]
            d = np.minimum(near, np.where(d < 0, np.inf, d))
            out.append((1 / d[np.isfinite(d) & (d > 0)]).sum() if harmonic else -np.where(np.isfinite(d), d, n).sum())
        yield {"node": csr.ids[at], "score": np.array(out)}

    return kernels.per_source(g, g.nodes, kernel, "node long, score double")


def group_closeness(g: Graph, k: int, harmonic: bool = False) -> list[int]:
    """Greedy group of least total distance (or of greatest harmonic closeness), ties by id; nodes out
    of reach count as n away."""
    g = g.kept()
    group: list[int] = []
    for _ in range(k):
        scored = _scored(g, group, harmonic)
        if group:
            scored = scored.filter(~F.col("node").isin(group))
        best = scored.orderBy(F.col("score").desc(), "node").limit(1).first()
        if best is None:
            break
        group.append(best["node"])
    return group


def swapped(g: Graph, group: list[int], swaps: int = 10, harmonic: bool = False) -> list[int]:
    """Local search: the best exchange of a member for another node, as long as it helps."""
    g = g.kept()
    score = (lambda x: harmonic_score(g, x)) if harmonic else (lambda x: closeness_score(g, x))
    now = score(group)
    for _ in range(swaps):
        best = None
        for x in sorted(group):
            rest = [y for y in group if y != x]
            found = _scored(g, rest, harmonic).filter(~F.col("node").isin(group)).orderBy(F.col("score").desc(), "node").limit(1).first()
            if found is not None:
                value = score([*rest, found["node"]])
                if value > now + 1e-12 and (best is None or value > best[0]):
                    best = (value, [*rest, found["node"]])
        if best is None:
            break
        now, group = best
    return group


def group_betweenness(g: Graph, k: int, samples: int = 1000, seed: int = 1) -> list[int]:
    """Greedy cover of sampled shortest paths: each round takes the node on most paths not yet hit."""
    from weftgraph.operators.sampling import sampled_paths

    paths = cut(sampled_paths(g, samples, seed).select("path_id", F.explode("path").alias("node")))
    group: list[int] = []
    for _ in range(k):
        best = paths.groupBy("node").agg(F.countDistinct("path_id").alias("n")).orderBy(F.col("n").desc(), "node").limit(1).first()
        if best is None:
            break
        group.append(best["node"])
        hit = paths.filter(F.col("node") == best["node"]).select("path_id").distinct()
        paths = cut(paths.join(hit, "path_id", "left_anti"))
    return group


def walk_score(g: Graph, group: list[int], alpha: float | None = None, longest: int = 30) -> float:
    """Walks of length 1 to ``longest`` that touch the group, each of length i weighing alpha^i; alpha is
    under 1 over the greatest degree, which it defaults to half of."""
    alpha = alpha or 0.5 / max(1, g.degrees().agg(F.max("degree")).first()[0] or 1)
    near = cut(g.adjacency.groupBy("u", "v").agg(F.count("*").alias("k")))
    chosen = _ids(g.spark, group)

    def total(nodes: DataFrame) -> float:
        rows = near.join(nodes.withColumnRenamed("id", "u"), "u", "left_semi").join(nodes.withColumnRenamed("id", "v"), "v", "left_semi")
        state, out = nodes.select("id", F.lit(1.0).alias("x")), 0.0
        rows = cut(rows)
        for i in range(1, longest + 1):
            step = rows.join(state, F.col("v") == F.col("id")).groupBy(F.col("u").alias("id")).agg(F.sum(F.col("k") * F.col("x")).alias("x"))
            state = cut(step)
            part = alpha**i * (state.agg(F.sum("x")).first()[0] or 0.0)
            out += part
            if part < 1e-9 * max(out, 1e-300):
                break
        return out

    return total(g.nodes) - total(g.nodes.join(chosen, "id", "left_anti"))
