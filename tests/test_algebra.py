"""Matrices and solvers against numpy."""

import numpy as np
import pytest

from weftgraph.graph import graph, index_edges
from weftgraph.operators import algebra as al
from weftgraph.operators import centrality, distances

N = 7
ROWS = [(0, 1, 2.0), (1, 2, 1.0), (2, 0, 3.0), (2, 3, 1.0), (3, 4, 2.0), (4, 5, 1.0), (5, 3, 1.0), (5, 6, 4.0)]


@pytest.fixture(scope="module")
def g(spark):
    return graph(spark.createDataFrame(ROWS, "src long, dst long, w double"), spark.range(N), w="w").kept()


def dense(m):
    out = np.zeros((N, N))
    for r in m.collect():
        out[r["i"], r["j"]] += r["v"]
    return out


def vector(x):
    out = np.zeros(N)
    for r in x.collect():
        out[r["i"]] = r["v"]
    return out


def frame(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i long, v double")


def test_products_over_semirings(spark, g):
    a = al.adjacency(g)
    d = dense(a)
    assert np.allclose(dense(al.multiply(a, a)), d @ d) and np.allclose(dense(al.combined(a, al.scaled(a, 2))), 3 * d)
    assert np.allclose(dense(al.combined(a, a, both=True)), d * d) and al.reduced(a) == d.sum()
    assert np.allclose(vector(al.row_sums(a)), d.sum(1)) and np.allclose(vector(al.column_sums(a)), d.sum(0))
    inf = np.where(d > 0, d, np.inf)
    want = (inf[:, :, None] + inf[None]).min(1)
    got = {(r["i"], r["j"]): r["v"] for r in al.multiply(a, a, al.MIN_PLUS).collect()}
    assert got == {(i, j): want[i, j] for i in range(N) for j in range(N) if np.isfinite(want[i, j])}
    most = {(r["i"], r["j"]): r["v"] for r in al.multiply(a, a, al.MAX_MIN).collect()}
    assert all(v == max(min(d[i, k], d[k, j]) for k in range(N) if d[i, k] and d[k, j]) for (i, j), v in most.items())
    ones = al.apply(a, lambda v: v * 0 + 1)
    assert np.allclose(dense(al.multiply(ones, ones, al.GALOIS)), ((d > 0).astype(int) @ (d > 0).astype(int)) % 2)
    part = frame(spark, range(3)).selectExpr("i", "CAST(2 - i AS LONG) AS new")
    assert np.allclose(dense(al.submatrix(a, part, part))[:3, :3], d[:3, :3][::-1, ::-1])


def test_matrices_of_a_graph(spark, g):
    d = dense(al.adjacency(g))
    lap = np.diag(d.sum(1)) - d
    assert np.allclose(dense(al.laplacian(g)), lap) and al.is_laplacian(al.laplacian(g)) and not al.is_laplacian(al.adjacency(g))
    b = al.incidence(index_edges(g))
    assert np.allclose(dense(al.multiply(b, al.transpose(b))), lap)
    root = np.sqrt(d.sum(1))
    assert np.allclose(dense(al.normalized_laplacian(g)), lap / root[:, None] / root)
    back = al.as_graph(al.adjacency(g), g.nodes, directed=False)
    assert sorted(map(tuple, back.edges.collect())) == sorted(map(tuple, g.edges.collect()))


def test_solvers(spark, g):
    b = np.array([1, -2, 3, 0, -4, 1, 1.0])
    lap = dense(al.laplacian(g))
    want = np.linalg.pinv(lap) @ b
    assert np.allclose(vector(al.solve_laplacian(g, frame(spark, b))), want, atol=1e-6)
    x = vector(al.multilevel(al.laplacian(g), frame(spark, b), small=4, cycles=2))
    assert np.linalg.norm(lap @ x - b) < 0.3 * np.linalg.norm(b)
    m = lap + 2 * np.eye(N)
    rows = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(N) for j in range(N) if m[i, j]], "i long, j long, v double")
    assert np.allclose(vector(al.conjugate_gradient(rows, frame(spark, b), precondition=False)), np.linalg.solve(m, b), atol=1e-6)
    assert np.allclose(vector(al.relax(rows, frame(spark, b), tol=0, rounds=12)), np.linalg.solve(m, b), atol=0.1)


def test_graph_algorithms_as_products(spark, g):
    want = {r["node"]: r["dist"] for r in distances.bfs(g, g.nodes.filter("id = 0")).collect()}
    assert {r["node"]: r["dist"] for r in al.reach(g, 0).collect()} == want
    want = {r["node"]: r["dist"] for r in distances.dijkstra(g, g.nodes.filter("id = 0")).collect()}
    assert {r["node"]: r["dist"] for r in al.bellman_ford(g, 0).collect()} == want
    assert {r["node"]: r["triangles"] for r in al.triangle_counts(g).collect()} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 0}
    loop = graph(spark.createDataFrame([(0, 1, -2.0), (1, 0, 1.0)], "src long, dst long, w double"), directed=True, w="w")
    with pytest.raises(ValueError):
        al.bellman_ford(loop, 0)
    mine = {r["node"]: r["score"] for r in al.pagerank(g, tol=1e-3).collect()}
    theirs = {r["node"]: r["score"] for r in centrality.pagerank(g, tol=1e-3).collect()}
    assert mine == pytest.approx(theirs, abs=2e-3)


def test_eigenpairs(spark, g):
    value, x = al.eigenpairs(al.adjacency(g), 1, rounds=25)[0]
    d = dense(al.adjacency(g))
    w, v = np.linalg.eigh(d)
    assert value == pytest.approx(w[-1], abs=0.2)
