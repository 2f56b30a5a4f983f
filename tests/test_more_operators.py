"""Seed searches, groups, sampling, rewiring, walks, dynamics and figures on small graphs."""

from collections import Counter

import numpy as np
import pytest

from weftgraph import functions
from weftgraph.graph import graph
from weftgraph.operators import distances, dynamics, embedding, groups, local, rewiring, sampling, tools

CLIQUES = [(a + k, b + k) for k in (0, 10) for a in range(5) for b in range(a)] + [(0, 10)]


def make(spark, rows, n=None, **how):
    rows = [(*r, 1.0)[:3] for r in rows]
    return graph(spark.createDataFrame(rows, "src long, dst long, w double"), spark.range(n) if n else None, w="w", **how).kept()


def ids(spark, *x):
    return spark.createDataFrame([(i,) for i in x], "id long")


@pytest.fixture(scope="module")
def two(spark):
    return make(spark, CLIQUES)


@pytest.mark.parametrize("find", [local.nibble, local.gce, local.lfm, local.local_t, local.tightness, local.two_phase, local.clique, local.combined])
def test_seeds_find_their_clique(spark, two, find):
    found = {}
    for r in find(two, ids(spark, 1, 12)).collect():
        found.setdefault(r["seed"], set()).add(r["node"])
    assert found == {1: set(range(5)), 12: set(range(10, 15))}


def test_other_seed_operators(spark, two):
    p = local.personal_pagerank(two, ids(spark, 1), eps=1e-6).collect()
    assert 0.9 < sum(r["score"] for r in p) <= 1 and max(p, key=lambda r: r["score"])["node"] == 1
    sizes = spark.createDataFrame([(1, 4)], "id long, size long")
    assert local.random_bfs(two, ids(spark, 1), sizes).count() == 4
    assert sorted(r["clique"] for r in local.maximal_cliques(two).collect()) == [[0, 1, 2, 3, 4], [0, 10], [10, 11, 12, 13, 14]]
    cover = spark.createDataFrame([(i, 7) for i in range(5)], "node long, block long")
    assert local.against(local.gce(two, ids(spark, 1)), cover).first()["f1"] == 1


def test_groups(spark, two):
    assert groups.group_degree(two, 2) == [0, 10] or sorted(groups.group_degree(two, 2)) == [0, 10]
    assert groups.degree_score(two, [0, 10]) == 10
    assert sorted(groups.group_closeness(two, 2)) == [0, 10]
    assert groups.closeness_score(two, [0, 10]) == 1 and groups.harmonic_score(two, [0, 10]) == 8
    assert groups.closeness_score(two, groups.swapped(two, [1, 2], swaps=1)) == 1
    assert sorted(groups.group_betweenness(two, 2, samples=200)) == [0, 10]
    assert groups.walk_score(two, [0]) > groups.walk_score(two, [1])


def test_sampled_scores_are_near_exact_ones(spark, two):
    exact = {r["node"]: r["score"] / 90 for r in distances.betweenness(two).collect()}
    for r in sampling.approx_betweenness(two, eps=0.05).collect():
        assert abs(r["score"] - exact[r["node"]]) < 0.05
    for r in sampling.adaptive_betweenness(two, eps=0.1).collect():
        assert r["lower"] - 1e-9 <= exact[r["node"]] <= r["upper"] + 1e-9
    close = {r["node"]: r["score"] for r in distances.closeness(two).collect()}
    top = [(r["node"], r["score"]) for r in sampling.top_closeness(two, 3, probe=3).collect()]
    want = sorted(close.items(), key=lambda x: (-x[1], x[0]))[:3]
    assert [n for n, _ in top] == [n for n, _ in want] and [x for _, x in top] == pytest.approx([x for _, x in want])
    assert {r["node"]: r["score"] for r in sampling.approx_closeness(two, 10).collect()} == pytest.approx(close)
    path = {r["node"]: r["score"] for r in sampling.k_path(two, 4, 2000).collect()}
    assert path[0] > path[1]
    trees = {(r["src"], r["dst"]): r["score"] for r in sampling.spanning_edges(two, 300).collect()}
    assert trees[10, 0] == 1 and abs(np.mean([v for k, v in trees.items() if k != (10, 0)]) - 0.4) < 0.05
    assert sampling.random_spanning_forest(two).count() == 9
    found = [r["pairs"] for r in sampling.neighborhood_sketch(two).orderBy("dist").collect()]
    assert found == pytest.approx([10, 52, 68, 100], rel=0.05)


def test_rewiring_keeps_degrees(spark):
    g = make(spark, [(i, (i * i + k) % 41) for i in range(41) for k in (1, 2, 3) if i != (i * i + k) % 41], duplicates="one")
    degree = lambda x: Counter(y for r in x.edges.collect() for y in (r["src"], r["dst"]))
    for new in (rewiring.edge_switching(g, 3), rewiring.curveball(g, rounds=5), rewiring.curveball(g, rewiring.global_trades(spark, 2, 41)), rewiring.curveball(g, rewiring.uniform_trades(spark, 30, 41))):
        assert degree(new) == degree(g) and tools.consistent(new) and new.edges.filter("src = dst").count() == 0
        assert new.edges.select("src", "dst").exceptAll(g.edges.select("src", "dst")).count() > 10
    assert sorted(degree(rewiring.degree_shuffle(g)).values()) == sorted(degree(g).values())
    f = rewiring.congruential(41)
    assert spark.range(41).select(f(__import__("pyspark").sql.functions.col("id")).alias("y")).distinct().count() == 41


def test_walks_and_layouts(spark, two):
    rows = embedding.walks(two, 2, 6).collect()
    near = {(r["u"], r["v"]) for r in two.adjacency.collect()}
    assert len(rows) == 20 and all((a, b) in near for r in rows for a, b in zip(r["walk"], r["walk"][1:], strict=False))
    v = {r["node"]: np.array(r["vector"]) for r in embedding.node_vectors(two, 8, 10, 10, 2).collect()}
    assert v[1] @ v[2] > v[1] @ v[12]
    place = {r["node"]: np.array(r["x"]) for r in embedding.pivot_layout(two, 10).collect()}
    assert np.linalg.norm(place[1] - place[2]) < np.linalg.norm(place[1] - place[12])
    place = {r["node"]: np.array(r["x"]) for r in embedding.stress_layout(two, rounds=3).collect()}
    assert len(place) == 10 and all(np.isfinite(x).all() for x in place.values())
    states = embedding.epidemic(two, ids(spark, 0), 1.0, 1, 2, 6).collect()
    last = {r["state"]: r["n"] for r in states if r["step"] == 6}
    assert sum(last.values()) == 10 and "S" not in last


def test_flows_and_searches(spark):
    g = make(spark, [(0, 1, 3.0), (0, 2, 2.0), (1, 2, 1.0), (1, 3, 2.0), (2, 3, 4.0)], directed=True)
    flow = embedding.max_flow(g, 0, 3).collect()
    assert sum(r["flow"] for r in flow if r["src"] == 0) == 5 and all(0 <= r["flow"] <= r["w"] for r in flow)
    assert [(r["node"], r["parent"]) for r in embedding.depth_first(g, 0).orderBy("at").collect()] == [(0, None), (1, 0), (2, 1), (3, 2)]
    assert embedding.between_two(g, 0, 3) == 2 and embedding.between_two(g, 3, 0) is None and embedding.between_two(g, 1, 1) == 0
    pairs = spark.createDataFrame([(0, 1), (0, 11)], "u long, v long")
    near = {(r["u"], r["v"]): r["score"] for r in embedding.algebraic_distance(make(spark, CLIQUES), pairs, 3, 5).collect()}
    assert near[0, 1] < near[0, 11]


def test_dynamics_equal_recomputing(spark, two):
    old = distances.bfs(two, ids(spark, 1)).select("source", "node", "dist")
    new = spark.createDataFrame([(3, 14, 1.0), (14, 20, 1.0)], "src long, dst long, w double")
    grown = dynamics.with_edges(two, new)
    want = {r["node"]: r["dist"] for r in distances.bfs(grown, ids(spark, 1)).collect()}
    assert {r["node"]: r["dist"] for r in dynamics.distances_after(grown, old, new).collect()} == want
    parts = spark.createDataFrame([(i, 0 if i < 5 else 10) for i in [*range(5), *range(10, 15)]], "node long, component long")
    assert {r["component"] for r in dynamics.components_after(parts, new).collect()} == {0}
    assert {r["node"] for r in dynamics.affected(two, 1, 1, 12).collect()} == {10, 11, 12, 13, 14} - {10}


def test_figures(spark, two):
    s = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 2.0), (3, 5.0)], "node long, score double")
    x = np.array([1, 2, 2, 5])
    assert functions.gini(s).first()[0] == pytest.approx(np.abs(x[:, None] - x).sum() / (2 * 16 * x.mean()))
    assert {r["node"]: r["rank"] for r in functions.ranked(s).collect()} == {3: 1, 1: 2.5, 2: 2.5, 0: 4}
    assert functions.correlation(s, s).first()[0] == pytest.approx(1) and functions.correlation(s, s, "pearson").first()[0] == pytest.approx(1)
    assert {r["error"] for r in functions.rank_errors(s, s).collect()} == {1}
    assert functions.summary(s).first()["most"] == 5


def test_single_questions(spark, two):
    assert tools.has_node(two, 3) and not tools.has_node(two, 7) and tools.has_edge(two, 0, 10) and not tools.has_edge(two, 1, 10)
    assert tools.weight(two, 10, 0) == 1 and tools.weight(tools.with_weight(two, 0, 99, 2.5), 99, 0) == 2.5
    assert tools.id_bound(two) == 15 and tools.total_weight(two) == 21 and tools.consistent(two) and not tools.is_empty(two)
    assert tools.isolated(tools.without_edges_of(two, 3)).collect()[0][0] == 3 and tools.without_all_edges(two).edges.count() == 0
