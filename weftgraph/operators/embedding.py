"""Walks and vectors, epidemics, layouts, flows and depth-first orders."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.lineage import cut
from weftgraph.operators import distances, kernels, tools


def walks(g: Graph, per_node: int = 10, length: int = 80, back: float = 1.0, out: float = 1.0, seed: int = 1) -> DataFrame:
    """``(node, k, walk)``: second-order random walks from every node. A step weighs 1 / back to return,
    1 to a neighbour of the node before, 1 / out otherwise (times the edge's weight)."""
    g = g.kept()
    if not kernels.fits(g):
        raise ValueError("walks need a graph whose adjacency can be broadcast")

    def kernel(csr: kernels.Csr, at: np.ndarray) -> Iterator[dict]:
        for s in at.tolist():
            rows = []
            for k in range(per_node):
                r = np.random.default_rng([seed, s, k])
                path, before = [s], -1
                while len(path) < length:
                    x = path[-1]
                    near, w = csr.target[csr.start[x] : csr.start[x + 1]], csr.weight[csr.start[x] : csr.start[x + 1]]
                    if not len(near):
                        break
                    if before >= 0:
                        known = csr.target[csr.start[before] : csr.start[before + 1]]
                        w = w * np.where(near == before, 1 / back, np.where(np.isin(near, known), 1.0, 1 / out))
                    before = x
                    path.append(int(near[np.searchsorted(np.cumsum(w), r.random() * w.sum(), side="right")]))
                rows.append(csr.ids[path].tolist())
            yield {"node": np.full(per_node, csr.ids[s]), "k": np.arange(per_node), "walk": rows}

    return kernels.per_source(g, g.nodes, kernel, "node long, k long, walk array<long>")


def node_vectors(g: Graph, dims: int = 32, per_node: int = 10, length: int = 40, window: int = 5, back: float = 1.0, out: float = 1.0, seed: int = 1) -> DataFrame:
    """``(node, vector)``: the walks' co-occurrences within ``window``, counted by Spark, as positive
    pointwise mutual information, projected on ``dims`` random directions and smoothed by two products
    (a randomised factorisation that is a plan of joins, with no model on one machine)."""
    rows = walks(g, per_node, length, back, out, seed)
    spread = rows.select(F.posexplode("walk").alias("i", "u"), "walk")
    near = spread.select("u", F.explode(F.expr(f"slice(walk, greatest(i + 1 - {window}, 1), least(i, {window}) + 1 + {window})")).alias("v")).filter("u <> v")
    pair = cut(near.groupBy("u", "v").agg(F.count("*").alias("c")))
    one = pair.groupBy("u").agg(F.sum("c").alias("n"))
    total = one.agg(F.sum("n")).first()[0] or 1
    score = F.log(F.col("c") * total / (F.col("n") * F.col("m")))
    pmi = pair.join(one, "u").join(one.select(F.col("u").alias("v"), F.col("n").alias("m")), "v").select("u", "v", F.greatest(score, F.lit(0.0)).alias("x")).filter("x > 0")
    length_ = pmi.groupBy("u").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("l"))
    pmi = cut(pmi.join(length_, "u").select("u", "v", (F.col("x") / F.col("l")).alias("x")))
    state = g.nodes.select("id", F.array(*[((F.pmod(F.xxhash64(F.lit(seed), F.lit(d), "id"), F.lit(20001)) - 10000) / 10000) for d in range(dims)]).alias("vector"))
    for _ in range(2):
        parts = [F.sum(F.col("x") * F.col("vector")[d]).alias(f"d{d}") for d in range(dims)]
        got = pmi.join(state.select(F.col("id").alias("v"), "vector"), "v").groupBy("u").agg(*parts)
        size = F.sqrt(sum((F.col(f"d{d}") ** 2 for d in range(1, dims)), F.col("d0") ** 2))
        state = cut(got.select(F.col("u").alias("id"), F.array(*[F.coalesce(F.col(f"d{d}") / size, F.lit(0.0)) for d in range(dims)]).alias("vector")))
    return g.nodes.join(state, "id", "left").select(F.col("id").alias("node"), F.coalesce("vector", F.array_repeat(F.lit(0.0), dims)).alias("vector"))


def epidemic(g: Graph, first: DataFrame, rate: float, exposed: int, infectious: int, steps: int, seed: int = 1) -> DataFrame:
    """``(step, state, n)``: nodes susceptible (S), exposed (E) for so many steps, infectious (I), removed
    (R); an infectious node infects each susceptible neighbour with ``rate`` in each step. A step is
    one join from the infectious nodes."""
    near = cut(g.adjacency.filter("u <> v").select("u", "v").distinct())
    state = cut(g.nodes.join(first.select("id", F.lit(1).alias("sick")).distinct(), "id", "left").select("id", F.when(F.col("sick") == 1, "I").otherwise("S").alias("state"), F.lit(0).alias("since")))
    out = state.groupBy("state").agg(F.count("*").alias("n")).select(F.lit(0).alias("step"), "state", "n")
    for k in range(1, steps + 1):
        hit = near.join(state.filter("state = 'I'").select(F.col("id").alias("u")), "u")
        luck = F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "u", "v"), F.lit(1_000_000)) / 1_000_000 < rate
        caught = hit.filter(luck).select(F.col("v").alias("id"), F.lit(1).alias("caught")).distinct()
        age = F.lit(k) - F.col("since")
        new = F.when((F.col("state") == "S") & (F.col("caught") == 1), "E").when((F.col("state") == "E") & (age >= exposed), "I").when((F.col("state") == "I") & (age >= infectious), "R").otherwise(F.col("state"))
        state = cut(state.join(caught, "id", "left").withColumn("new", new).select("id", F.col("new").alias("state"), F.when(F.col("new") != F.col("state"), k).otherwise(F.col("since")).alias("since")))
        out = out.unionByName(state.groupBy("state").agg(F.count("*").alias("n")).select(F.lit(k).alias("step"), "state", "n"))
    return out


def pivot_layout(g: Graph, pivots: int = 32, dims: int = 2, seed: int = 1) -> DataFrame:
    """``(node, x)``: classical scaling of the distances to some pivots: squared distances are centred by
    row and column; the directions come from the small pivot-by-pivot product, each node's place from
    its own row."""
    chosen = tools.random_nodes(g, pivots, seed)
    rows = cut(distances.pairs(g.kept(), chosen).select("source", "node", (F.col("dist") * F.col("dist")).alias("d")))
    by_pivot = rows.groupBy("source").agg(F.avg("d").alias("p"))
    by_node = rows.groupBy("node").agg(F.avg("d").alias("q"))
    whole = rows.agg(F.avg("d")).first()[0] or 0.0
    c = cut(rows.join(F.broadcast(by_pivot), "source").join(by_node, "node").select("source", "node", ((F.col("p") + F.col("q") - F.col("d") - whole) / 2).alias("c")))
    other = c.select(F.col("source").alias("other"), "node", F.col("c").alias("e"))
    small = c.join(other, "node").groupBy("source", "other").agg(F.sum(F.col("c") * F.col("e")).alias("v")).collect()  # pivots squared
    names = sorted({r["source"] for r in small})
    at = {x: i for i, x in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for r in small:
        m[at[r["source"]], at[r["other"]]] = r["v"]
    value, vector = np.linalg.eigh(m)
    top = vector[:, ::-1][:, :dims]
    top = top * np.sign(top[np.abs(top).argmax(0), np.arange(top.shape[1])])
    table = g.spark.createDataFrame([(x, [float(v) for v in top[i]]) for x, i in at.items()], "source long, t array<double>")
    return c.join(F.broadcast(table), "source").groupBy("node").agg(F.array(*[F.sum(F.col("c") * F.col("t")[d]) for d in range(dims)]).alias("x"))


def stress_layout(g: Graph, start: DataFrame | None = None, rounds: int = 30, alpha: float = 1.0, decay: float = 0.7, dims: int = 2, seed: int = 1) -> DataFrame:
    """``(node, x)``: edges are drawn to length 1 while all nodes that are no neighbours push each other
    off, the push weighing less in later rounds. The push is summed over a coarse grid of centres, so
    a round is a join of nodes with cells."""
    g = g.kept()
    place = start if start is not None else pivot_layout(g, dims=dims, seed=seed)
    jitter = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.pmod(F.xxhash64(F.lit(seed), "node", d), F.lit(1000)) / 1000)
    state = cut(place.select("node", F.zip_with("x", jitter, lambda a, b: a + b).alias("x")))
    near = cut(g.adjacency.filter("u <> v").select("u", "v").distinct())
    unit = lambda a, b, s: F.zip_with(a, b, lambda p, q: (p - q) * s)
    for _ in range(rounds):
        far = state.select(F.col("node").alias("v"), F.col("x").alias("y"))
        both = near.join(state.select(F.col("node").alias("u"), "x"), "u").join(far, "v")
        gap = F.greatest(F.sqrt(F.aggregate(F.zip_with("x", "y", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, p: s + p)), F.lit(1e-6))
        pull = both.select("u", F.zip_with("y", unit(F.col("x"), F.col("y"), 1 / gap), lambda q, d: q + d).alias("t"))
        mean = pull.groupBy("u").agg(F.array(*[F.avg(F.col("t")[d]) for d in range(dims)]).alias("t"))
        cells = state.groupBy(*[F.round(F.col("x")[d] / 4).alias(f"c{d}") for d in range(dims)]).agg(F.count("*").alias("m"), F.array(*[F.avg(F.col("x")[d]) for d in range(dims)]).alias("y")).select("m", "y")
        reach = F.aggregate(F.zip_with("x", "y", lambda p, q: (p - q) * (p - q)), F.lit(1.0), lambda s, p: s + p)
        push = state.join(F.broadcast(cells)).groupBy("node").agg(F.array(*[F.sum((F.col("x")[d] - F.col("y")[d]) * F.col("m") / reach) for d in range(dims)]).alias("f"))  # few cells
        rows = state.join(mean, F.col("node") == F.col("u"), "left").join(push, "node")
        state = cut(rows.select("node", F.zip_with(F.coalesce("t", "x"), "f", lambda t, f: t + alpha * 0.05 * f).alias("x")))
        alpha *= decay
    return state


def max_flow(g: Graph, source: int, target: int) -> DataFrame:
    """``(src, dst, w, flow)``: a greatest flow by shortest augmenting paths; the flow's value is the sum
    out of the source. Paths follow each other, so the graph must fit one task."""
    g = g.kept()
    if not kernels.small(g):
        raise ValueError("flows need a graph that fits one task")
    directed = g.directed

    def kernel(ids: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> dict:
        n, m = len(ids), len(u)
        s, t = np.searchsorted(ids, [source, target]).tolist()
        head = np.concatenate((v, u)).tolist()
        left = np.concatenate((w, np.zeros(m) if directed else w)).tolist()
        near: list[list[int]] = [[] for _ in range(n)]
        for e, (a, b) in enumerate(zip(u.tolist(), v.tolist(), strict=True)):
            near[a].append(e)
            near[b].append(e + m)
        flow = [0.0] * (2 * m)
        while s != t:
            came = {s: -1}
            queue = deque([s])
            while queue and t not in came:
                x = queue.popleft()
                for e in near[x]:
                    if head[e] not in came and left[e] > 1e-12:
                        came[head[e]] = e
                        queue.append(head[e])
            if t not in came:
                break
            path, x = [], t
            while came[x] >= 0:
                path.append(came[x])
                x = head[(came[x] + m) % (2 * m)]
            step = min(left[e] for e in path)
            for e in path:
                back = (e + m) % (2 * m)
                left[e] -= step
                left[back] += step
                flow[e] += step
                flow[back] -= step
        return {"src": ids[u], "dst": ids[v], "w": w, "flow": np.array(flow[:m])}

    return kernels.whole(g, kernel, "src long, dst long, w double, flow double")


def depth_first(g: Graph, source: int) -> DataFrame:
    """``(node, at, parent)``: the order of a depth-first search, neighbours by id. Sequential: one task."""
    g = g.kept()
    if not kernels.small(g):
        raise ValueError("a depth-first search needs a graph that fits one task")
    directed = g.directed

    def kernel(ids: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> dict:
        if not directed:
            u, v, _ = kernels.both_ways(u, v, w)
        order = np.lexsort((v, u))
        start, near = kernels.adjacency_lists(len(ids), u[order], v[order])
        s = int(np.searchsorted(ids, source))
        at, seen, out = start[: len(ids)], {s: -1}, [s]
        stack = [s]
        while stack:
            x = stack[-1]
            while at[x] < start[x + 1] and near[at[x]] in seen:
                at[x] += 1
            if at[x] == start[x + 1]:
                stack.pop()
                continue
            y = near[at[x]]
            seen[y] = x
            out.append(y)
            stack.append(y)
        parent = pa.array([int(ids[seen[x]]) if seen[x] >= 0 else None for x in out], pa.int64())
        return {"node": ids[np.array(out)], "at": np.arange(len(out)), "parent": parent}

    return kernels.whole(g, kernel, "node long, at long, parent long")


def between_two(g: Graph, source: int | None, target: int | None, limit: int = 1 << 30) -> float | None:
    """Hops from source to target by searches from both ends, the smaller frontier first; null if there is
    no way or one of the two is null."""
    if source is None or target is None:
        return None
    spark = g.spark
    if source == target:
        return 0.0
    sides = []
    for x, near in ((source, g.adjacency), (target, g.reverse)):
        start = cut(spark.createDataFrame([(x,)], "id long"))
        sides.append([start, start, near.select("u", "v"), 1])
    hops = 0
    while hops < limit:
        k = 0 if sides[0][3] <= sides[1][3] else 1
        front, seen, near, _ = sides[k]
        new = cut(front.join(near, F.col("id") == F.col("u")).select(F.col("v").alias("id")).distinct().join(seen, "id", "left_anti"))
        size = new.count()
        if not size:
            return None
        hops += 1
        sides[k] = [new, cut(seen.unionByName(new)), near, size]
        if new.join(sides[1 - k][1], "id", "left_semi").limit(1).count():
            return float(hops)
    return None


def algebraic_distance(g: Graph, pairs: DataFrame, systems: int = 10, rounds: int = 30, omega: float = 0.5, seed: int = 1) -> DataFrame:
    """``(u, v, score)``: greatest difference, over some random start vectors, after damped averaging over
    neighbours. All vectors go through one join in a round."""
    near = g.adjacency.filter("u <> v")
    total = near.groupBy("u").agg(F.sum("w").alias("t"))
    share = cut(near.join(total, "u").select("u", "v", (F.col("w") / F.col("t")).alias("s")))
    names = [f"x{k}" for k in range(systems)]
    state = cut(g.nodes.select("id", *[(F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(1_000_000)) / 1_000_000).alias(n) for k, n in enumerate(names)]))
    for k in range(rounds):
        got = share.join(state.withColumnRenamed("id", "v"), "v").groupBy("u").agg(*[F.sum(F.col("s") * F.col(n)).alias(f"y{n}") for n in names])
        state = state.join(got, F.col("id") == F.col("u"), "left").select("id", *[((1 - omega) * F.col(n) + omega * F.coalesce(f"y{n}", n)).alias(n) for n in names])
        if k % 5 == 4:
            state = cut(state)
    a, b = state.select(F.col("id").alias("u"), *names), state.select(F.col("id").alias("v"), *[F.col(n).alias(f"z{n}") for n in names])
    gaps = [F.abs(F.col(n) - F.col(f"z{n}")) for n in names]
    return pairs.select("u", "v").join(a, "u").join(b, "v").select("u", "v", (F.greatest(*gaps) if len(gaps) > 1 else gaps[0]).alias("score"))
