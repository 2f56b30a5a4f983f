"""Communities around seeds. Each seed is a search of its own over a broadcast adjacency (see
``kernels``: checked to fit), so seeds spread over the cluster. Results are ``(seed, node)``; loops and
directions do not count."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.operators import kernels, tools

OUT = "seed long, node long"


class Around:
    """Neighbours, weights and degrees by position."""

    def __init__(self, csr: kernels.Csr):
        self.csr = csr
        self.held: dict[int, dict[int, float]] = {}

    def __call__(self, u: int) -> dict[int, float]:
        if u not in self.held:
            a, b = self.csr.start[u], self.csr.start[u + 1]
            near: dict[int, float] = {}
            for v, w in zip(self.csr.target[a:b].tolist(), self.csr.weight[a:b].tolist(), strict=True):
                if v != u:
                    near[v] = near.get(v, 0.0) + w
            self.held[u] = near
        return self.held[u]

    def degree(self, u: int) -> float:
        return sum(self(u).values())

    def cut(self, inside: set[int]) -> tuple[float, float]:
        """Weight within (each edge once) and across."""
        inner = across = 0.0
        for u in inside:
            for v, w in self(u).items():
                if v in inside:
                    inner += w / 2
                else:
                    across += w
        return inner, across


def _search(g: Graph, seeds: DataFrame, find: Callable[[Around, int], set[int]]) -> DataFrame:
    g = (tools.undirected(g) if g.directed else g).kept()
    if not kernels.fits(g):
        raise ValueError("seed searches need a graph whose adjacency can be broadcast")

    def kernel(csr: kernels.Csr, at: np.ndarray) -> Iterator[dict]:
        near = Around(csr)
        for s in at.tolist():
            found = sorted(find(near, s))
            yield {"seed": np.full(len(found), csr.ids[s]), "node": csr.ids[np.array(found, np.int64)]}

    return kernels.per_source(g, seeds, kernel, OUT)


def push(near: Around, seed: int, alpha: float, eps: float) -> dict[int, float]:
    """Approximate personalised PageRank: mass is pushed on while a node's residue is over ``eps``
    times its degree, so the work does not depend on the graph's size."""
    p, r, queue = {}, {seed: 1.0}, deque([seed])
    while queue:
        u = queue.popleft()
        d = near.degree(u)
        if d == 0:
            p[u] = p.get(u, 0.0) + r.pop(u, 0.0)
            continue
        mass = r.get(u, 0.0)
        if mass < eps * d:
            continue
        p[u] = p.get(u, 0.0) + alpha * mass
        r[u] = (1 - alpha) * mass / 2
        for v, w in near(u).items():
            before = r.get(v, 0.0)
            r[v] = before + (1 - alpha) * mass / 2 * w / d
            if before < eps * near.degree(v) <= r[v]:
                queue.append(v)
        if r[u] >= eps * d:
            queue.append(u)
    return p


def personal_pagerank(g: Graph, seeds: DataFrame, alpha: float = 0.1, eps: float = 1e-4) -> DataFrame:
    """``(seed, node, score)``"""
    g = (tools.undirected(g) if g.directed else g).kept()

    def kernel(csr: kernels.Csr, at: np.ndarray) -> Iterator[dict]:
        near = Around(csr)
        for s in at.tolist():
            p = sorted(push(near, s, alpha, eps).items())
            yield {"seed": np.full(len(p), csr.ids[s]), "node": csr.ids[np.array([u for u, _ in p], np.int64)], "score": np.array([x for _, x in p])}

    return kernels.per_source(g, seeds, kernel, "seed long, node long, score double")


def nibble(g: Graph, seeds: DataFrame, alpha: float = 0.1, eps: float = 1e-4) -> DataFrame:
    """The prefix of least conductance in the order of score over degree."""
    half = float(g.edges.filter("src <> dst").agg(F.sum("w")).first()[0] or 0.0)

    def find(near: Around, seed: int) -> set[int]:
        p = push(near, seed, alpha, eps)
        order = sorted(p, key=lambda u: (-p[u] / max(near.degree(u), 1e-300), u))
        inside: set[int] = set()
        volume = across = 0.0
        best, at = float("inf"), 1
        for i, u in enumerate(order, 1):
            to = sum(w for v, w in near(u).items() if v in inside)
            volume, across = volume + near.degree(u), across + near.degree(u) - 2 * to
            inside.add(u)
            low = min(volume, 2 * half - volume)
            value = across / low if low > 0 else 1.0
            if value < best:
                best, at = value, i
        return set(order[:at]) | {seed}

    return _search(g, seeds, find)


def _greedy(near: Around, seed: int, quality: Callable[[float, float, float, float], float], shrink: bool = False) -> set[int]:
    """Grows by the neighbour that raises ``quality(inner, across, size, border)`` most, until none does;
    with ``shrink`` members that lower it leave."""
    inside, rim = {seed}, dict(near(seed))
    inner, across = 0.0, near.degree(seed)

    def value(i: float, a: float, n: int, members: set[int]) -> float:
        return quality(i, a, n, 0.0)

    now = value(inner, across, 1, inside)
    while rim:
        best = max(((value(inner + to, across + near.degree(u) - 2 * to, len(inside) + 1, inside), -u, u) for u, to in rim.items()))
        if best[0] <= now:
            break
        u = best[2]
        to = rim.pop(u)
        inner, across, now = inner + to, across + near.degree(u) - 2 * to, best[0]
        inside.add(u)
        for v, w in near(u).items():
            if v not in inside:
                rim[v] = rim.get(v, 0.0) + w
        while shrink and len(inside) > 1:
            loss = []
            for u in inside - {seed}:
                to = sum(w for v, w in near(u).items() if v in inside)
                loss.append((value(inner - to, across - near.degree(u) + 2 * to, len(inside) - 1, inside), -u, u, to))
            if not loss or max(loss)[0] <= now:
                break
            now, _, u, to = max(loss)
            inside.discard(u)
            inner, across = inner - to, across - near.degree(u) + 2 * to
            rim[u] = to
            for v, w in near(u).items():
                if v in rim:
                    rim[v] -= w
                    if rim[v] <= 1e-12:
                        del rim[v]
    return inside


def gce(g: Graph, seeds: DataFrame, objective: str = "M") -> DataFrame:
    """Greedy expansion. M: inner over crossing weight; L: inner per member over crossing per member."""
    value = {"M": lambda i, a, n, b: i / a if a else float("inf"), "L": lambda i, a, n, b: (2 * i / n) / (a / n) if a else float("inf")}[objective]
    return _search(g, seeds, lambda near, s: _greedy(near, s, value))


def lfm(g: Graph, seeds: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Fitness 2 inner / (2 inner + crossing)^alpha, with members leaving."""
    return _search(g, seeds, lambda near, s: _greedy(near, s, lambda i, a, n, b: 2 * i / (2 * i + a) ** alpha if i + a else 0.0, shrink=True))


def local_t(g: Graph, seeds: DataFrame) -> DataFrame:
    """Greedy by triangles: those within the set times what they are more than those that leave it by
    one node. While they are fewer, nodes join that are linked with half of the set at least."""

    def find(near: Around, seed: int) -> set[int]:
        inside, now = {seed}, 0.0

        def value(members: set[int]) -> float:
            inner = outer = 0
            for u in members:
                own = [v for v in near(u) if v in members and v > u]
                for i, v in enumerate(own):
                    for w in own[i + 1 :]:
                        inner += w in near(v)
                for v in near(u):
                    if v in members and v > u:
                        outer += sum(1 for x in near(u) if x in near(v) and x not in members)
            return float(inner * max(0, inner - outer))

        while True:
            rim = {v for u in inside for v in near(u)} - inside
            best = max(((value(inside | {u}), len(near(u).keys() & inside), -u, u) for u in rim), default=None)
            if best is None or best[0] <= now and (now > 0 or 2 * best[1] < len(inside)):
                return inside
            now = best[0]
            inside = inside | {best[3]}

    return _search(g, seeds, find)


def tightness(g: Graph, seeds: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Expansion by similarity of neighbourhoods: the rim node most similar to the set joins as long
    as its inward similarity outweighs ``alpha`` times the outward."""

    def find(near: Around, seed: int) -> set[int]:
        def alike(u: int, v: int) -> float:
            a, b = near(u), near(v)
            both = sum(a[x] * b[x] for x in a.keys() & b.keys()) + a.get(v, 0.0) * (1.0 + 1.0)
            return both / max(1e-12, (sum(x * x for x in a.values()) + 1) ** 0.5 * (sum(x * x for x in b.values()) + 1) ** 0.5)

        inside = {seed}
        inner = 0.0
        outer = sum(alike(seed, v) for v in near(seed))
        while True:
            rim: dict[int, float] = {}
            for u in inside:
                for v in near(u):
                    if v not in inside:
                        rim[v] = rim.get(v, 0.0) + alike(u, v)
            tried = sorted(rim, key=lambda v: (-rim[v], v))
            for v in tried:
                out = sum(alike(v, x) for x in near(v) if x not in inside)
                gain = (outer / inner if inner else float("inf")) - (alpha * out - rim[v]) / (2 * rim[v])
                if gain > 0:
                    inside.add(v)
                    inner, outer = inner + rim[v], outer - rim[v] + out
                    break
            else:
                return inside

    return _search(g, seeds, find)


def two_phase(g: Graph, seeds: DataFrame) -> DataFrame:
    """L = inner density over border density: first all that raise it join, then members that do not hold
    it up leave."""

    def find(near: Around, seed: int) -> set[int]:
        def value(members: set[int]) -> float:
            inner, across = near.cut(members)
            border = sum(1 for u in members if any(v not in members for v in near(u)))
            return (2 * inner / len(members)) / (across / border) if across and border else float("inf") if inner else 0.0

        inside, now = {seed}, 0.0
        while rim := {v for u in inside for v in near(u)} - inside:
            best, _, u = max((value(inside | {u}), -u, u) for u in rim)
            if best <= now:
                break
            inside, now = inside | {u}, best
        for u in sorted(inside - {seed}):
            if len(inside) > 2 and value(inside - {u}) > now:
                inside, now = inside - {u}, value(inside - {u})
        return inside

    return _search(g, seeds, find)


def random_bfs(g: Graph, seeds: DataFrame, sizes: DataFrame, seed: int = 1) -> DataFrame:
    """As many nodes as wanted, layer by layer and at random within the last; ``sizes``: (id, size)."""
    want = {r["id"]: r["size"] for r in sizes.join(seeds.select("id"), "id", "left_semi").collect()}  # a row for each seed
    shared = g.spark.sparkContext.broadcast(want)
    g = (tools.undirected(g) if g.directed else g).kept()

    def kernel(csr: kernels.Csr, at: np.ndarray) -> Iterator[dict]:
        for s in at.tolist():
            r = np.random.default_rng([seed, s])
            n = shared.value.get(int(csr.ids[s]), 1)
            out: list[int] = []
            for layer in csr.hops(s)[2]:
                out += r.permutation(layer)[: n - len(out)].tolist() if len(layer) > n - len(out) else layer.tolist()
                if len(out) >= n:
                    break
            yield {"seed": np.full(len(out), csr.ids[s]), "node": csr.ids[np.array(out, np.int64)]}

    return kernels.per_source(g, seeds, kernel, OUT)


def cliques_around(near: Around, u: int, later: Callable[[int, int], bool] | None = None) -> Iterator[list[int]]:
    """Maximal cliques that hold u; with ``later``, only those in which u comes first."""
    own = set(near(u))
    first = {v for v in own if later is None or later(u, v)}
    stack = [([u], first, own - first)]
    while stack:
        clique, more, seen = stack.pop()
        if not more and not seen:
            yield clique
            continue
        pivot = max(more | seen, key=lambda x: len(more & near(x).keys()))
        for v in sorted(more - near(pivot).keys()):
            stack.append(([*clique, v], more & near(v).keys(), seen & near(v).keys()))
            more = more - {v}
            seen = seen | {v}


def clique(g: Graph, seeds: DataFrame) -> DataFrame:
    """The largest clique around each seed, ties by its nodes."""
    return _search(g, seeds, lambda near, s: set(min(cliques_around(near, s), key=lambda c: (-len(c), sorted(c)))))


def combined(g: Graph, seeds: DataFrame) -> DataFrame:
    """The largest clique around the seed, grown greedily by inner over crossing weight."""

    def find(near: Around, seed: int) -> set[int]:
        inside = set(min(cliques_around(near, seed), key=lambda c: (-len(c), sorted(c))))
        while rim := {v for u in inside for v in near(u)} - inside:
            i, a = near.cut(inside)
            now = i / a if a else float("inf")
            options = []
            for u in rim:
                to = sum(w for v, w in near(u).items() if v in inside)
                left = a + near.degree(u) - 2 * to
                options.append(((i + to) / left if left else float("inf"), -u, u))
            best = max(options)
            if best[0] <= now:
                break
            inside.add(best[2])
        return inside

    return _search(g, seeds, find)


def maximal_cliques(g: Graph, largest: bool = False) -> DataFrame:
    """``(clique)``: sorted nodes of each maximal clique, found at its first node in the order of
    degree and id, so that no clique is met twice."""
    g = (tools.undirected(g) if g.directed else g).kept()
    if not kernels.fits(g):
        raise ValueError("cliques need a graph whose adjacency can be broadcast")

    def kernel(csr: kernels.Csr, at: np.ndarray) -> Iterator[dict]:
        near = Around(csr)
        later = lambda u, v: (len(near(v)), v) > (len(near(u)), u)
        for s in at.tolist():
            found = [sorted(csr.ids[c].tolist()) for c in cliques_around(near, s, later)]
            if found:
                yield {"clique": found}

    out = kernels.per_source(g, g.nodes, kernel, "clique array<long>")
    if not largest:
        return out
    return out.crossJoin(out.agg(F.max(F.size("clique")).alias("most"))).filter("size(clique) = most").drop("most")  # one row


def against(found: DataFrame, cover: DataFrame) -> DataFrame:
    """``(seed, jaccard, precision, recall, f1)`` against the best block of a cover ``(node, block)``
    that holds the seed."""
    size = found.groupBy("seed").agg(F.count("*").alias("a"))
    known = cover.groupBy("block").agg(F.count("*").alias("b"))
    own = cover.select(F.col("node").alias("seed"), "block")
    met = found.join(cover, "node").groupBy("seed", "block").agg(F.count("*").alias("c"))
    rows = own.join(met, ["seed", "block"]).join(size, "seed").join(known, "block")
    one = F.struct((2 * F.col("c") / (F.col("a") + F.col("b"))).alias("f1"), (F.col("c") / (F.col("a") + F.col("b") - F.col("c"))).alias("jaccard"), (F.col("c") / F.col("a")).alias("precision"), (F.col("c") / F.col("b")).alias("recall"))
    return rows.groupBy("seed").agg(F.max(one).alias("m")).select("seed", "m.jaccard", "m.precision", "m.recall", "m.f1")
