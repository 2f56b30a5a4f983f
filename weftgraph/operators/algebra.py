"""Sparse matrices as tables ``(i, j, v)`` and vectors ``(i, v)`` over semirings, and solvers.

Entries that are not there are the semiring's zero. Products are one equi-join on the inner index and
one partial aggregate; there is no place where a row or column of a matrix meets in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.lineage import cut

Binary = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Semiring:
    """``add`` reduces a column, ``plus`` and ``times`` work on two; ``zero`` and ``one`` are neutral."""

    add: Callable[[Column], Column]
    plus: Binary
    times: Binary
    zero: float
    one: float


ARITHMETIC = Semiring(F.sum, lambda a, b: a + b, lambda a, b: a * b, 0.0, 1.0)
MIN_PLUS = Semiring(F.min, F.least, lambda a, b: a + b, math.inf, 0.0)
MAX_PLUS = Semiring(F.max, F.greatest, lambda a, b: a + b, -math.inf, 0.0)
MIN_MAX = Semiring(F.min, F.least, F.greatest, math.inf, -math.inf)
MAX_MIN = Semiring(F.max, F.greatest, F.least, -math.inf, math.inf)
#: Over 0 and 1.
LOGICAL = Semiring(F.max, F.greatest, F.least, 0.0, 1.0)
#: Integers modulo 2.
GALOIS = Semiring(lambda c: F.pmod(F.sum(c), F.lit(2)).cast("double"), lambda a, b: F.pmod(a + b, F.lit(2)), lambda a, b: F.pmod(a * b, F.lit(2)), 0.0, 1.0)


# --- matrices ---


def matrix(entries: DataFrame, i: str = "i", j: str = "j", v: str = "v", ring: Semiring = ARITHMETIC) -> DataFrame:
    """From triples; entries of one place are added."""
    return entries.groupBy(F.col(i).cast("long").alias("i"), F.col(j).cast("long").alias("j")).agg(ring.add(F.col(v).cast("double")).alias("v"))


def adjacency(g: Graph) -> DataFrame:
    return matrix(g.adjacency, "u", "v", "w") if g.weighted else matrix(g.adjacency.withColumn("one", F.lit(1.0)), "u", "v", "one")


def incidence(g: Graph) -> DataFrame:
    """Rows are nodes, columns edge ids ``eid``: the root of the weight at the one end, its negative
    at the other."""
    root = F.sqrt("w")
    return g.edges.select(F.col("src").alias("i"), F.col("eid").alias("j"), root.alias("v")).unionByName(g.edges.select(F.col("dst").alias("i"), F.col("eid").alias("j"), (-root).alias("v"))).filter("v <> 0")


def laplacian(g: Graph) -> DataFrame:
    """Degrees less adjacency; self-loops do not count."""
    off = g.adjacency.filter("u <> v").select(F.col("u").alias("i"), F.col("v").alias("j"), (-F.col("w")).alias("v"))
    on = off.groupBy("i").agg((-F.sum("v")).alias("v")).select("i", F.col("i").alias("j"), "v")
    return matrix(off).unionByName(on)


def normalized_laplacian(g: Graph) -> DataFrame:
    """D^-1/2 L D^-1/2."""
    lap = laplacian(g)
    d = lap.filter("i = j").select(F.col("i").alias("k"), F.col("v").alias("d"))
    a, b = d.select(F.col("k").alias("i"), F.col("d").alias("x")), d.select(F.col("k").alias("j"), F.col("d").alias("y"))
    return lap.join(a, "i").join(b, "j").select("i", "j", (F.col("v") / F.sqrt(F.col("x") * F.col("y"))).alias("v"))


def pagerank_matrix(g: Graph, damp: float = 0.85) -> DataFrame:
    """Damped transition matrix with its uniform part left out: that is rank one, (1 - damp) / n."""
    out = g.adjacency.groupBy("u").agg(F.sum("w").alias("d"))
    return matrix(g.adjacency.join(out, "u").withColumn("p", damp * F.col("w") / F.col("d")), "u", "v", "p")


def identity(n: DataFrame, i: str = "id", value: float = 1.0) -> DataFrame:
    return n.select(F.col(i).alias("i"), F.col(i).alias("j"), F.lit(value).alias("v"))


def diagonal(m: DataFrame) -> DataFrame:
    return m.filter("i = j").select("i", "v")


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def row(m: DataFrame, i: int) -> DataFrame:
    return m.filter(F.col("i") == i).select(F.col("j").alias("i"), "v")


def column(m: DataFrame, j: int) -> DataFrame:
    return m.filter(F.col("j") == j).select("i", "v")


def multiply(a: DataFrame, b: DataFrame, ring: Semiring = ARITHMETIC) -> DataFrame:
    right = b.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("v").alias("x"))
    return a.join(right, "j").groupBy("i", "k").agg(ring.add(ring.times(F.col("v"), F.col("x"))).alias("v")).select("i", F.col("k").alias("j"), "v")


def apply(a: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    """``f`` of each entry that is there."""
    return a.withColumn("v", f(F.col("v")))


def scaled(a: DataFrame, factor: float) -> DataFrame:
    return apply(a, lambda v: v * factor)


def combined(a: DataFrame, b: DataFrame, ring: Semiring = ARITHMETIC, f: Binary | None = None, both: bool = False) -> DataFrame:
    """Entry by entry: ``plus`` (or ``f``) where either is there, or, ``both``, ``times`` where both
    are. Matrices or vectors."""
    keys = [c for c in ("i", "j") if c in a.columns]
    x = b.withColumnRenamed("v", "x")
    if both:
        return a.join(x, keys).select(*keys, (f or ring.times)(F.col("v"), F.col("x")).alias("v"))
    zero = F.lit(ring.zero)
    return a.join(x, keys, "full").select(*keys, (f or ring.plus)(F.coalesce("v", zero), F.coalesce("x", zero)).alias("v"))


def reduced(a: DataFrame, ring: Semiring = ARITHMETIC) -> float:
    """All entries added up."""
    found = a.agg(ring.add(F.col("v"))).first()[0]
    return ring.zero if found is None else found


def row_sums(a: DataFrame, ring: Semiring = ARITHMETIC) -> DataFrame:
    return a.groupBy("i").agg(ring.add(F.col("v")).alias("v"))


def column_sums(a: DataFrame, ring: Semiring = ARITHMETIC) -> DataFrame:
    return row_sums(transpose(a), ring)


def submatrix(a: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Rows and columns ``(i, new)`` of the one and the other, renumbered."""
    r, c = rows.select("i", F.col("new").alias("p")), columns.select(F.col("i").alias("j"), F.col("new").alias("q"))
    return a.join(r, "i").join(c, "j").select(F.col("p").alias("i"), F.col("q").alias("j"), "v")


def symmetric(a: DataFrame) -> bool:
    return not combined(a, transpose(a), f=lambda x, y: x - y).filter("abs(v) > 1e-9").limit(1).count()


def is_laplacian(a: DataFrame) -> bool:
    """Symmetric, nothing positive off the diagonal, rows that sum to nothing."""
    fine = not a.filter("i <> j AND v > 0").limit(1).count() and not row_sums(a).filter("abs(v) > 1e-9").limit(1).count()
    return fine and symmetric(a)


def as_graph(a: DataFrame, nodes: DataFrame, directed: bool = True) -> Graph:
    rows = a.filter("v <> 0")
    rows = rows if directed else rows.filter("i >= j")
    return Graph(nodes, rows.select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("v").alias("w")), directed, True)


# --- vectors ---


def times(a: DataFrame, x: DataFrame, ring: Semiring = ARITHMETIC) -> DataFrame:
    """Matrix times vector."""
    right = x.select(F.col("i").alias("j"), F.col("v").alias("x"))
    return a.join(right, "j").groupBy("i").agg(ring.add(ring.times(F.col("v"), F.col("x"))).alias("v"))


def dot(x: DataFrame, y: DataFrame) -> float:
    return x.join(y.withColumnRenamed("v", "y"), "i").agg(F.sum(F.col("v") * F.col("y"))).first()[0] or 0.0


def length(x: DataFrame) -> float:
    return math.sqrt(x.agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 0.0)


def mean(x: DataFrame) -> float:
    return x.agg(F.avg("v")).first()[0] or 0.0


def outer(x: DataFrame, y: DataFrame, cells: DataFrame) -> DataFrame:
    """The outer product at the places ``(i, j)`` of ``cells``; the whole of it is never made."""
    return cells.select("i", "j").join(x.withColumnRenamed("v", "x"), "i").join(y.select(F.col("i").alias("j"), F.col("v").alias("y")), "j").select("i", "j", (F.col("x") * F.col("y")).alias("v"))


# --- solvers ---


def conjugate_gradient(a: DataFrame, b: DataFrame, tol: float = 1e-8, rounds: int = 1000, precondition: bool = True) -> DataFrame:
    """x with a x = b for a symmetric positive (semi)definite matrix, from 0, preconditioned by the
    diagonal (or not). For a singular matrix, as of a Laplacian, b must be in its range. The state
    is one table of four columns, so a round costs one join with the matrix."""
    a = cut(a)
    d = diagonal(a).select("i", F.col("v").alias("d"))
    state = b.join(d, "i", "left").select("i", F.lit(0.0).alias("x"), F.col("v").alias("r"), (F.col("v") / F.when(F.lit(precondition) & (F.col("d") > 0), F.col("d")).otherwise(1.0)).alias("p"), F.when(F.lit(precondition) & (F.col("d") > 0), F.col("d")).otherwise(1.0).alias("d"))
    rows = a.select("i").distinct().join(state, "i", "full").join(d.withColumnRenamed("d", "e"), "i", "left")
    one = F.coalesce("d", F.when(F.lit(precondition) & (F.col("e") > 0), F.col("e")), F.lit(1.0))
    state = cut(rows.select("i", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("r", F.lit(0.0)).alias("r"), F.coalesce("p", F.lit(0.0)).alias("p"), one.alias("d")))
    rho, goal = state.agg(F.sum(F.col("r") * F.col("r") / F.col("d")), F.sqrt(F.sum(F.col("r") * F.col("r")))).first()
    goal = (goal or 0.0) * tol
    if not rho:
        return state.select("i", F.col("x").alias("v"))
    for _ in range(rounds):
        q = times(a, state.select("i", F.col("p").alias("v"))).withColumnRenamed("v", "q")
        both = cut(state.join(q, "i", "left").withColumn("q", F.coalesce("q", F.lit(0.0))))
        curve = both.agg(F.sum(F.col("p") * F.col("q"))).first()[0] or 0.0
        if curve <= 0:
            break
        step = rho / curve
        state = both.select("i", (F.col("x") + step * F.col("p")).alias("x"), (F.col("r") - step * F.col("q")).alias("r"), "p", "d")
        new, left = state.agg(F.sum(F.col("r") * F.col("r") / F.col("d")), F.sqrt(F.sum(F.col("r") * F.col("r")))).first()
        state = state.withColumn("p", F.col("r") / F.col("d") + (new / rho) * F.col("p"))
        rho = new
        if left <= goal:
            break
    return state.select("i", F.col("x").alias("v"))


def relax(a: DataFrame, b: DataFrame, x: DataFrame | None = None, tol: float = 1e-6, rounds: int = 200, damp: float = 2 / 3) -> DataFrame:
    """Damped Jacobi relaxation, the smoother whose rows do not wait for each other (a Gauss-Seidel
    sweep is sequential)."""
    a = cut(a)
    d = diagonal(a).select("i", F.col("v").alias("d"))
    x = b.select("i", F.lit(0.0).alias("v")) if x is None else x
    for _ in range(rounds):
        got = times(a, x).withColumnRenamed("v", "ax")
        rows = x.join(b.withColumnRenamed("v", "b"), "i").join(d, "i").join(got, "i", "left")
        new = cut(rows.select("i", "v", (damp * (F.col("b") - F.coalesce("ax", F.lit(0.0))) / F.col("d")).alias("move")))
        x = new.select("i", (F.col("v") + F.col("move")).alias("v"))
        if (new.agg(F.max(F.abs("move"))).first()[0] or 0.0) <= tol:
            break
    return x


def solve_laplacian(g: Graph, b: DataFrame, tol: float = 1e-8) -> DataFrame:
    """x with L x = b and mean 0 on a connected graph; b is centred first."""
    at = mean(b)
    x = conjugate_gradient(laplacian(g), b.select("i", (F.col("v") - at).alias("v")), tol)
    x = cut(x)
    return x.select("i", (F.col("v") - mean(x)).alias("v"))


def aggregates(a: DataFrame, strong: float = 0.25) -> DataFrame:
    """``(i, block)``: pairs of rows that are each other's strongest neighbour (at least ``strong`` of
    the diagonal), the step by which a multilevel solver coarsens; other rows stay alone."""
    off = a.filter("i <> j").select("i", "j", (-F.col("v")).alias("w"))
    d = diagonal(a).withColumnRenamed("v", "d")
    best = off.groupBy("i").agg(F.max_by("j", F.struct("w", -F.col("j"))).alias("to"), F.max("w").alias("w")).join(d, "i").filter(F.col("w") >= strong * F.col("d")).select("i", "to")
    other = best.select(F.col("i").alias("to"), F.col("to").alias("back"))
    paired = best.join(other, "to").filter("back = i").select("i", F.least("i", "to").alias("block"))
    return d.select("i").join(paired, "i", "left").select("i", F.coalesce("block", "i").alias("block"))


def galerkin(a: DataFrame, blocks: DataFrame) -> DataFrame:
    """The coarse matrix: entries summed over the blocks of their row and column."""
    r, c = blocks.select("i", F.col("block").alias("p")), blocks.select(F.col("i").alias("j"), F.col("block").alias("q"))
    return matrix(a.join(r, "i").join(c, "j"), "p", "q", "v")


def multilevel(a: DataFrame, b: DataFrame, tol: float = 1e-6, cycles: int = 30, levels: int = 8, small: int = 64) -> DataFrame:
    """x with a x = b for a Laplacian: V-cycles of relaxation over ever coarser matrices, made by
    joining strong pairs, until at most ``small`` rows are left, which conjugate gradients solve."""
    steps: list[tuple[DataFrame, DataFrame]] = []
    m = cut(a)
    for _ in range(levels):
        n = diagonal(m).count()
        blocks = cut(aggregates(m))
        if n <= small or blocks.select("block").distinct().count() > 0.9 * n:
            break
        steps.append((m, blocks))
        m = cut(galerkin(m, blocks))
    goal = tol * length(b)

    def cycle(k: int, right: DataFrame) -> DataFrame:
        if k == len(steps):
            return cut(conjugate_gradient(m, right, 1e-10))
        fine, blocks = steps[k]
        x = cut(relax(fine, right, None, 0.0, 2))
        rest = combined(right, times(fine, x), f=lambda p, q: p - q)
        coarse = cut(rest.join(blocks, "i").groupBy("block").agg(F.sum("v").alias("v")).select(F.col("block").alias("i"), "v"))
        up = cycle(k + 1, coarse).select(F.col("i").alias("block"), F.col("v").alias("up"))
        x = x.join(blocks, "i").join(up, "block", "left").select("i", (F.col("v") + F.coalesce("up", F.lit(0.0))).alias("v"))
        return cut(relax(fine, right, cut(x), 0.0, 2))

    x = cut(b.select("i", F.lit(0.0).alias("v")))
    for _ in range(cycles):
        rest = cut(combined(b, times(a, x), f=lambda p, q: p - q))
        if length(rest) <= goal:
            break
        x = cut(combined(x, cycle(0, rest)))
    return x


# --- graph algorithms as products ---


def reach(g: Graph, source: int) -> DataFrame:
    """``(node, dist)``: hops, as products of the transposed adjacency over (or, and)."""
    a = cut(apply(transpose(adjacency(g)), lambda v: F.lit(1.0)))
    seen = front = cut(g.nodes.filter(F.col("id") == source).select(F.col("id").alias("i"), F.lit(1.0).alias("v")))
    out, hops = seen.select(F.col("i").alias("node"), F.lit(0.0).alias("dist")), 0
    while True:
        hops += 1
        front = cut(times(a, front, LOGICAL).join(seen.select("i"), "i", "left_anti"))
        if not front.limit(1).count():
            return out
        seen = cut(seen.unionByName(front))
        out = out.unionByName(front.select(F.col("i").alias("node"), F.lit(float(hops)).alias("dist")))


def bellman_ford(g: Graph, source: int) -> DataFrame:
    """``(node, dist)``: products over (min, plus); negative weights are fine, a negative cycle is
    refused."""
    a = cut(transpose(matrix(g.adjacency, "u", "v", "w", MIN_PLUS)))
    x = cut(g.nodes.filter(F.col("id") == source).select(F.col("id").alias("i"), F.lit(0.0).alias("v")))
    for _ in range(g.nodes.count()):
        new = cut(combined(times(a, x, MIN_PLUS), x, MIN_PLUS).join(x.withColumnRenamed("v", "old"), "i", "left"))
        x = new.select("i", "v")
        if not new.filter("old IS NULL OR v < old").limit(1).count():
            return x.select(F.col("i").alias("node"), F.col("v").alias("dist"))
    raise ValueError("a cycle of negative weight can be reached")


def pagerank(g: Graph, damp: float = 0.85, tol: float = 1e-8, rounds: int = 200) -> DataFrame:
    """``(node, score)`` by products with the transition matrix."""
    p = cut(transpose(pagerank_matrix(g, damp)))
    n = g.nodes.count()
    x = cut(g.nodes.select(F.col("id").alias("i"), F.lit(1.0 / n).alias("v")))
    for _ in range(rounds):
        new = cut(x.withColumnRenamed("v", "old").join(times(p, x), "i", "left").select("i", "old", (F.coalesce("v", F.lit(0.0)) + (1 - damp) / n).alias("v")))
        x = new.select("i", "v")
        if math.sqrt(new.agg(F.sum((F.col("v") - F.col("old")) ** 2)).first()[0]) <= tol:
            break
    whole = reduced(x)
    return x.select(F.col("i").alias("node"), (F.col("v") / whole).alias("score"))


def triangle_counts(g: Graph) -> DataFrame:
    """``(node, triangles)``: the masked product of the lower part of the adjacency with itself."""
    a = apply(adjacency(g).filter("i <> j"), lambda v: F.lit(1.0))
    low = a.filter("i > j")
    tri = low.select("i", "j").join(low.select("i", F.col("j").alias("k")), "i").filter("j > k").join(low.select(F.col("i").alias("j"), F.col("j").alias("k")), ["j", "k"])
    found = tri.select(F.explode(F.array("i", "j", "k")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    return g.nodes.join(found, F.col("id") == F.col("node"), "left").select(F.col("id").alias("node"), F.coalesce("triangles", F.lit(0)).alias("triangles"))


def eigenpairs(a: DataFrame, k: int, tol: float = 1e-9, rounds: int = 500, smallest: bool = False, seed: int = 1) -> list[tuple[float, DataFrame]]:
    """The ``k`` eigenvalues of a symmetric matrix of greatest (or smallest) value, with unit vectors, by power
    iteration; each next one is kept off those before. The matrix is shifted by a bound of its
    values, so that order is by value and not by size."""
    a = cut(a)
    bound = apply(a, F.abs).groupBy("i").agg(F.sum("v").alias("v")).agg(F.max("v")).first()[0] or 0.0
    sign = -1.0 if smallest else 1.0
    ids = cut(a.select("i").unionByName(a.select(F.col("j").alias("i"))).distinct())
    found: list[tuple[float, DataFrame]] = []
    for n in range(k):
        x = cut(ids.select("i", (F.pmod(F.xxhash64(F.lit(seed + n), "i"), F.lit(2001)) / 1000 - 1).alias("v")))
        value = math.nan
        for _ in range(rounds):
            got = times(a, x).withColumnRenamed("v", "y")
            y = cut(x.join(got, "i", "left").select("i", (bound * F.col("v") + sign * F.coalesce("y", F.lit(0.0))).alias("v")))
            for _, other in found:
                along = dot(y, other)
                y = cut(y.join(other.withColumnRenamed("v", "o"), "i").select("i", (F.col("v") - along * F.col("o")).alias("v")))
            size = length(y)
            if not size:
                break
            x = y.select("i", (F.col("v") / size).alias("v"))
            before, value = value, sign * (size - bound)
            if abs(value - before) <= tol * max(1.0, abs(value)):
                break
        found.append((value, cut(x)))
    return found
