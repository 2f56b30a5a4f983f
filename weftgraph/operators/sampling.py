"""Scores by sampling: searches from sampled sources or pairs over a broadcast adjacency."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.lineage import cut
from weftgraph.operators import algebra, kernels


def sampled_paths(g: Graph, samples: int, seed: int = 1) -> DataFrame:
    """``(path_id, path)``: inner nodes of a uniform shortest path between each of so many uniform pairs
    of different nodes; empty where there is none."""
    g = g.kept()
    if not kernels.fits(g):
        raise ValueError("sampled paths need a graph whose adjacency can be broadcast")
    draws = g.spark.range(samples).select("id")
    shared = g.spark.sparkContext.broadcast(kernels.collect(g))

    def kernel(batches):
        import pyarrow as pa

        csr = shared.value
        n = len(csr.ids)
        back = None
        for batch in batches:
            paths = []
            for k in batch.column(0).to_pylist():
                r = np.random.default_rng([seed, k])
                if n < 2:
                    paths.append([])
                    continue
                s, t = r.choice(n, 2, replace=False).tolist()
                dist, sigma, layers = csr.hops(s)
                path, x = [], t
                if dist[t] > 0:
                    if back is None:
                        back = reverse(csr)
                    while dist[x] > 1:
                        near = back.target[back.start[x] : back.start[x + 1]]
                        near = near[dist[near] == dist[x] - 1]
                        x = int(r.choice(near, p=sigma[near] / sigma[near].sum()))
                        path.append(int(csr.ids[x]))
                paths.append(path)
            yield pa.RecordBatch.from_pydict({"path_id": batch.column(0), "path": pa.array(paths, pa.list_(pa.int64()))})

    return draws.repartition(max(1, g.spark.sparkContext.defaultParallelism), "id").mapInArrow(kernel, "path_id long, path array<long>")


def reverse(csr: kernels.Csr) -> kernels.Csr:
    n = len(csr.ids)
    u = np.repeat(np.arange(n), np.diff(csr.start))
    order = np.argsort(csr.target, kind="stable")
    return kernels.Csr(csr.ids, np.concatenate(([0], np.cumsum(np.bincount(csr.target, minlength=n)))), u[order], csr.weight[order])


def approx_betweenness(g: Graph, eps: float = 0.05, delta: float = 0.1, constant: float = 0.5, seed: int = 1) -> DataFrame:
    """``(node, score)``: within ``eps`` of betweenness over n (n - 1) with probability 1 - delta; the
    number of paths follows from a bound of the nodes on a shortest path."""
    from weftgraph.operators import distances

    g = g.kept()
    first = g.adjacency.groupBy("u").agg(F.count("*").alias("d")).orderBy(F.col("d").desc(), "u").limit(1).select(F.col("u").alias("id"))
    far = distances.bfs(g, first).agg(F.max("dist")).first()[0] or 0.0
    on_path = 2 * far + 1
    samples = math.ceil(constant / eps**2 * (math.floor(math.log2(max(2, on_path - 2))) + 1 + math.log(1 / delta)))
    hits = sampled_paths(g, samples, seed).select(F.explode("path").alias("node")).groupBy("node").agg((F.count("*") / samples).alias("score"))
    return g.nodes.join(hits, F.col("id") == F.col("node"), "left").select(F.col("id").alias("node"), F.coalesce("score", F.lit(0.0)).alias("score"))


def adaptive_betweenness(g: Graph, eps: float = 0.05, delta: float = 0.1, batch: int = 1000, seed: int = 1) -> DataFrame:
    """``(node, score, lower, upper)``: batches of sampled paths until each node's confidence interval
    (empirical Bernstein, with a union bound over nodes and batches) is within ``eps``, at the latest at the number
    that suffices for any graph."""
    g = g.kept()
    n = max(2, g.nodes.count())
    last = math.ceil(0.5 / eps**2 * (math.log2(n) + 1 + math.log(1 / delta)))
    rounds = max(1, math.ceil(last / batch))
    log = math.log(2 * n * rounds / delta)
    hits, taken = None, 0
    for k in range(rounds):
        new = sampled_paths(g, batch, seed + k).select(F.explode("path").alias("node")).groupBy("node").agg(F.count("*").alias("c"))
        hits = cut(new if hits is None else hits.unionByName(new).groupBy("node").agg(F.sum("c").alias("c")))
        taken += batch
        p = F.col("c") / taken
        width = F.sqrt(2 * p * (1 - p) * log / taken) + 3 * log / taken
        if (hits.agg(F.max(width)).first()[0] or 3 * log / taken) <= eps:
            break
    p = F.coalesce("c", F.lit(0)) / taken
    width = F.sqrt(2 * p * (1 - p) * log / taken) + 3 * log / taken
    rows = g.nodes.join(hits, F.col("id") == F.col("node"), "left")
    return rows.select(F.col("id").alias("node"), p.alias("score"), F.greatest(F.lit(0.0), p - width).alias("lower"), F.least(F.lit(1.0), p + width).alias("upper"))


def approx_closeness(g: Graph, samples: int, seed: int = 1) -> DataFrame:
    """``(node, score)``: closeness from the distances to so many pivots, scaled to all nodes; the
    graph is undirected and connected."""
    from weftgraph.operators import distances, tools

    g = g.kept()
    pivots = tools.random_nodes(g, samples, seed)
    n, k = g.nodes.count(), min(samples, g.nodes.count())
    per = distances.pairs(g, pivots).groupBy("node").agg(F.sum("dist").alias("s"))
    return per.select("node", F.when(F.col("s") > 0, (n - 1) / (F.col("s") * n / k)).otherwise(0.0).alias("score"))


def top_closeness(g: Graph, k: int, probe: int = 64) -> DataFrame:
    """``(node, score)``: the ``k`` best of closeness, exactly, on a connected graph. The searches of the ``probe``
    nodes of greatest degree give a bound; all others stop as soon as the layers seen, with the
    rest one layer further at best, cannot beat it."""
    g = g.kept()
    n = g.nodes.count()
    probe = max(probe, k)
    ranked = cut(g.degrees().orderBy(F.col("degree").desc(), "id").limit(probe).select("id"))

    def exact(csr: kernels.Csr, at: np.ndarray) -> Iterator[dict]:
        yield {"node": csr.ids[at], "far": np.array([float(csr.hops(s)[0].sum()) for s in at.tolist()])}

    first = cut(kernels.per_source(g, ranked, exact, "node long, far double"))
    bound = sorted(r["far"] for r in first.collect())[: k][-1]  # ``probe`` rows

    def pruned(csr: kernels.Csr, at: np.ndarray) -> Iterator[dict]:
        node, far = [], []
        for s in at.tolist():
            seen = np.zeros(len(csr.ids), bool)
            seen[s] = True
            front, d, total, met = np.array([s]), 0, 0.0, 1
            while len(front):
                d += 1
                v = csr.target[csr.neighbours(front)[0]]
                front = np.unique(v[~seen[v]])
                seen[front] = True
                total, met = total + d * len(front), met + len(front)
                if total + (d + 1) * (len(csr.ids) - met) > bound:
                    break
            else:
                node.append(csr.ids[s])
                far.append(total)
        yield {"node": np.array(node, np.int64), "far": np.array(far, float)}

    rest = kernels.per_source(g, g.nodes.join(ranked, "id", "left_anti"), pruned, "node long, far double")
    return first.unionByName(rest).orderBy("far", "node").limit(k).select("node", F.when(F.col("far") > 0, (n - 1) / F.col("far")).otherwise(0.0).alias("score"))


def k_path(g: Graph, k: int, samples: int, seed: int = 1) -> DataFrame:
    """``(node, score)``: how often random walks without repeated nodes, of up to ``k`` steps, pass a
    node, scaled by k n over the walks."""
    g = g.kept()
    shared = g.spark.sparkContext.broadcast(kernels.collect(g))

    def kernel(batches):
        import pyarrow as pa

        csr = shared.value
        hit = np.zeros(len(csr.ids), np.int64)
        for batch in batches:
            for i in batch.column(0).to_pylist():
                r = np.random.default_rng([seed, i])
                x, seen = int(r.integers(len(csr.ids))), set()
                for _ in range(int(r.integers(1, k + 1))):
                    seen.add(x)
                    a, b = csr.start[x], csr.start[x + 1]
                    fine = [j for j in range(a, b) if int(csr.target[j]) not in seen]
                    if not fine:
                        break
                    w = 1 / csr.weight[fine]
                    x = int(csr.target[r.choice(fine, p=w / w.sum())])
                    hit[x] += 1
        at = np.flatnonzero(hit)
        yield pa.RecordBatch.from_pydict({"node": csr.ids[at], "c": hit[at]})

    found = g.spark.range(samples).mapInArrow(kernel, "node long, c long").groupBy("node").agg(F.sum("c").alias("c"))
    n = g.nodes.count()
    return g.nodes.join(found, F.col("id") == F.col("node"), "left").select(F.col("id").alias("node"), (F.coalesce("c", F.lit(0)) * k * n / samples).alias("score"))


def resistances(g: Graph, eps: float = 0.3, seed: int = 1, probes: int | None = None) -> DataFrame:
    """``(src, dst, w, score)``: effective resistance of each edge, within 1 +- eps, by projection of the
    weighted incidence matrix on random signs and one Laplacian system for each."""
    from weftgraph.graph import index_edges

    g = index_edges(g).kept()
    k = probes or math.ceil(4 * math.log(max(2, g.nodes.count())) / eps**2)
    b = cut(algebra.incidence(g))
    total = None
    ends = cut(g.edges.select("src", "dst", "w"))
    for p in range(k):
        sign = F.when(F.pmod(F.xxhash64(F.lit(seed), F.lit(p), "j"), F.lit(2)) == 0, 1.0).otherwise(-1.0)
        y = b.groupBy("i").agg(F.sum(F.col("v") * sign).alias("v"))
        x = cut(algebra.conjugate_gradient(algebra.laplacian(g), y, 1e-4))
        part = ends.join(x.select(F.col("i").alias("src"), F.col("v").alias("a")), "src").join(x.select(F.col("i").alias("dst"), F.col("v").alias("c")), "dst").select("src", "dst", "w", ((F.col("a") - F.col("c")) ** 2 / k).alias("score"))
        total = part if total is None else cut(total.unionByName(part).groupBy("src", "dst", "w").agg(F.sum("score").alias("score")))
    return total


def spanning_edges(g: Graph, trees: int = 200, seed: int = 1) -> DataFrame:
    """``(src, dst, w, score)``: the share of uniform random spanning trees that hold an edge, which is
    its weight times its effective resistance. Trees are drawn by loop-erased walks, each in one task."""
    g = g.kept()
    shared = g.spark.sparkContext.broadcast(kernels.collect(g))

    def kernel(batches):
        import pyarrow as pa

        csr = shared.value
        n = len(csr.ids)
        hits: dict[tuple[int, int], int] = {}
        for batch in batches:
            for i in batch.column(0).to_pylist():
                for u, v in random_tree(csr, np.random.default_rng([seed, i])):
                    key = (max(u, v), min(u, v))
                    hits[key] = hits.get(key, 0) + 1
        del n
        yield pa.RecordBatch.from_pydict({"src": csr.ids[np.array([k[0] for k in hits], np.int64)], "dst": csr.ids[np.array([k[1] for k in hits], np.int64)], "c": np.array(list(hits.values()), np.int64)})

    found = g.spark.range(trees).repartition(g.spark.sparkContext.defaultParallelism, "id").mapInArrow(kernel, "src long, dst long, c long").groupBy("src", "dst").agg(F.sum("c").alias("c"))
    return g.edges.select("src", "dst", "w").join(found, ["src", "dst"], "left").select("src", "dst", "w", (F.coalesce("c", F.lit(0)) / trees).alias("score"))


def random_tree(csr: kernels.Csr, r: np.random.Generator) -> list[tuple[int, int]]:
    """Edges of a uniform spanning forest (weights as conductances), by Wilson's walks."""
    n = len(csr.ids)
    done, out = np.zeros(n, bool), []
    todo = np.ones(n, bool)
    while todo.any():  # a root for each component
        root = int(np.flatnonzero(todo)[0])
        member = csr.hops(root)[0] >= 0
        todo &= ~member
        done[root] = True
        for s in np.flatnonzero(member).tolist():
            step: dict[int, int] = {}
            x = s
            while not done[x]:
                a, b = csr.start[x], csr.start[x + 1]
                w = csr.weight[a:b]
                step[x] = int(csr.target[a + r.choice(b - a, p=w / w.sum())])
                x = step[x]
            x = s
            while not done[x]:
                done[x] = True
                out.append((x, step[x]))
                x = step[x]
    return out


def random_spanning_forest(g: Graph, seed: int = 1) -> DataFrame:
    """``(src, dst)`` of one uniform spanning forest; the walk is sequential, so the graph must fit one
    task."""
    g = g.kept()
    if not kernels.small(g):
        raise ValueError("a random forest needs a graph that fits one task")

    def kernel(ids: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> dict:
        a, b, c = kernels.both_ways(u, v, w)
        order = np.argsort(a, kind="stable")
        csr = kernels.Csr(ids, np.concatenate(([0], np.cumsum(np.bincount(a, minlength=len(ids))))), b[order], c[order])
        rows = random_tree(csr, np.random.default_rng(seed))
        return {"src": ids[np.array([max(x) for x in rows], np.int64)], "dst": ids[np.array([min(x) for x in rows], np.int64)]}

    return kernels.whole(g, kernel, "src long, dst long")


def commute_times(g: Graph, eps: float = 0.3, seed: int = 1, probes: int | None = None) -> DataFrame:
    """``(src, dst, w, score)`` of each edge: effective resistance times the volume."""
    volume = g.degrees(twice=True).agg(F.sum("weighted")).first()[0] or 0.0
    return resistances(g, eps, seed, probes).withColumn("score", F.col("score") * volume)


def neighborhood_sketch(g: Graph, rounds: int = 32, precision: int = 12) -> DataFrame:
    """``(dist, pairs)``: ordered pairs within each number of hops, themselves included, by one HyperLogLog
    sketch for each node that takes in its neighbours' in a round; it stops when the sum does."""
    g = g.kept()
    state = cut(g.nodes.groupBy("id").agg(F.hll_sketch_agg("id", F.lit(precision)).alias("s")))
    near = cut(g.adjacency.filter("u <> v").select("u", "v").distinct())
    out, before = [], 0
    for k in range(rounds + 1):
        total = state.agg(F.sum(F.hll_sketch_estimate("s"))).first()[0] or 0
        if k and total <= before:
            break
        out.append((float(k), int(total)))
        before = total
        seen = near.join(state.select(F.col("id").alias("v"), "s"), "v").select(F.col("u").alias("id"), "s").unionByName(state)
        state = cut(seen.groupBy("id").agg(F.hll_union_agg("s").alias("s")))
    return g.spark.createDataFrame(out, "dist double, pairs long")
