"""Operators against hand-computed values on small graphs."""

import pytest

from weftgraph.graph import graph, index_edges
from weftgraph.operators import centrality, community, components, distances, linkprediction, tools, triangles
from weftgraph.sources import text
from weftgraph.streaming import events

EIGHT = [(0, 2, 3.0), (1, 2, 2.0), (2, 3, 3.0), (2, 4, 2.0), (2, 5, 1.5), (3, 5, 3.0), (4, 5, 2.0), (5, 6, 3.0), (5, 7, 2.0)]


def make(spark, rows, n=None, **how):
    rows = [(*r, 1.0)[:3] for r in rows]
    nodes = spark.range(n) if n is not None else None
    return graph(spark.createDataFrame(rows, "src long, dst long, w double"), nodes, w="w", **how)


def values(df, key="node", value="score"):
    return {r[key]: r[value] for r in df.collect()}


def listed(df, n):
    found = values(df)
    return [found[i] for i in range(n)]


def test_degrees_with_loops_holes_and_multi_edges(spark):
    g = make(spark, [(0, 0), (0, 1), (0, 1), (3, 1)], 5)
    assert values(g.degrees(), "id", "degree") == {0: 3, 1: 3, 2: 0, 3: 1, 4: 0}
    assert values(g.degrees(twice=True), "id", "weighted")[0] == 4
    assert tools.size(g).first()[:] == (5, 4) and tools.without_multi_edges(g).edges.count() == 3
    assert sorted(r["eid"] for r in index_edges(g).edges.collect()) == [0, 1, 2, 3]


def test_pagerank_and_eigenvector(spark):
    g = make(spark, EIGHT, 8)
    want = [0.0753, 0.0565, 0.2552, 0.1319, 0.0942, 0.2552, 0.0753, 0.0565]
    assert listed(centrality.pagerank(g), 8) == pytest.approx(want, abs=1e-4)
    want = [0.2254, 0.1503, 0.5290, 0.4508, 0.3006, 0.5290, 0.2254, 0.1503]
    assert listed(centrality.eigenvector(g), 8) == pytest.approx(want, abs=1e-4)


def test_laplacian(spark):
    g = make(spark, [(0, 1, 4.0), (0, 2, 2.0), (2, 1, 1.0), (1, 3, 2.0), (1, 4, 2.0), (4, 5, 1.0)], 6)
    assert listed(centrality.laplacian(g), 6) == [140, 180, 56, 44, 52, 8]


CORE = "2-4 3-4 4-5 5-7 6-7 6-8 6-9 6-11 7-12 8-9 8-10 8-11 8-13 9-10 9-11 9-13 10-11 10-13 10-14 11-13 11-14 12-15 13-14 14-15"


def test_core_numbers_and_clustering(spark):
    g = make(spark, [tuple(map(int, e.split("-"))) for e in CORE.split()], 16)
    assert listed(centrality.core(g), 16) == [0, 0, 1, 1, 1, 1, 3, 2, 4, 4, 4, 4, 2, 4, 3, 2]
    want = [0, 0, 0, 0, 0, 0, 0.5, 0, 0.8, 0.8, 0.8, 0.6667, 0, 0.8, 0.5, 0]
    assert listed(centrality.local_clustering(g), 16) == pytest.approx(want, abs=1e-4)
    assert listed(centrality._cores(g.kept()), 16) == listed(centrality.core(g), 16)
    with pytest.raises(ValueError):
        centrality.core(make(spark, [(0, 0)], 1))


def test_betweenness_by_kernel_and_by_joins(spark):
    g = make(spark, [(0, 2), (1, 2), (2, 3), (2, 4), (3, 5), (4, 5)], 6)
    want = [0, 0, 15, 3, 3, 1]
    assert listed(distances.betweenness(g), 6) == want
    found = values(distances._layered(g, g.nodes))
    assert [found.get(i, 0) for i in range(6)] == want
    assert listed(distances.betweenness(make(spark, EIGHT, 8), weighted=True), 8) == [0, 0, 23, 0, 0, 23, 0, 0]


def test_distances_components_and_paths(spark):
    g = make(spark, [(0, 1), (1, 2), (2, 3), (3, 0), (4, 5)], 7)
    by_join = {(r["source"], r["node"]): (r["dist"], r["paths"]) for r in distances.bfs(g, g.nodes).collect()}
    assert by_join == {(r["source"], r["node"]): (r["dist"], r["paths"]) for r in distances.pairs(g).collect()} and by_join[0, 2] == (2, 2)
    assert values(components.connected(g), value="component") == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4, 6: 6}
    assert sorted(r["path"] for r in distances.simple_paths(g, 0, 2, 3).collect()) == [[0, 1, 2], [0, 3, 2]]
    w = make(spark, [(0, 1, 5.0), (0, 2, 1.0), (2, 1, 1.0)], 4)
    assert values(distances.dijkstra(w, w.nodes.filter("id = 0")), value="dist") == {0: 0, 1: 2, 2: 1}
    assert sorted(tuple(r) for r in distances.spanning_forest(w).collect()) == [(2, 0, 1.0), (2, 1, 1.0)]
    assert sorted(tuple(r) for r in distances.matching(w).collect()) == [(1, 0, 5.0)]


def test_strong_components(spark):
    g = make(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (5, 5)], 6, directed=True)
    for found in (components.strong(g), components._strong(g.kept())):
        assert values(found, value="component") == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}


def test_one_task_and_rounds_of_joins_agree(spark, monkeypatch):
    g = make(spark, EIGHT, 9).kept()
    calls = {
        "pagerank": lambda: centrality.pagerank(g, iterations=6), "normalized": lambda: centrality.pagerank(g, iterations=3, normalized=True), "eigenvector": lambda: centrality.eigenvector(g, iterations=6),
        "katz": lambda: centrality.katz(g, iterations=4), "components": lambda: components.connected(g).withColumnRenamed("component", "score"),
    }
    near = {k: values(f()) for k, f in calls.items()}
    monkeypatch.setattr(centrality.kernels, "small", lambda g: False)
    for k, f in calls.items():
        assert values(f()) == pytest.approx(near[k], abs=1e-9), k


def test_biconnected_components(spark):
    g = make(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 3)], 7)
    found = {}
    for r in components.biconnected(g).collect():
        found.setdefault(r["block"], set()).add(r["node"])
    assert sorted(map(sorted, found.values())) == [[0, 1, 2], [2, 3], [3, 4, 5]]


def test_triangles_and_links(spark):
    g = make(spark, [(0, 1), (1, 2), (2, 0), (2, 3)], 4)
    assert [tuple(sorted(r)) for r in triangles.triangles(g).collect()] == [(0, 1, 2)]
    assert triangles.transitivity(g).first()[0] == pytest.approx(0.6)
    assert sorted(tuple(r) for r in linkprediction.missing_links(g).collect()) == [(0, 3), (1, 3)]


def test_communities(spark):
    cliques = [(a + k, b + k) for k in (0, 10, 20) for a in range(5) for b in range(a)] + [(0, 10), (10, 20)]
    g = make(spark, cliques)
    blocks = community.louvain(g, levels=2, rounds=6)
    assert sorted(r["size"] for r in community.sizes(blocks).collect()) == [5, 5, 5]
    assert community.modularity(g, blocks).first()[0] > 0.5
    assert list(community.comparison(blocks, blocks).first()) == pytest.approx([0, 0, 0, 0])


def test_files_round_trip(spark, tmp_path):
    g = make(spark, EIGHT, 9)
    text.write_metis(g, f"{tmp_path}/m")
    back = text.read_metis(spark, f"{tmp_path}/m")
    assert sorted(map(tuple, back.edges.collect())) == sorted(map(tuple, g.edges.select("src", "dst", "w").collect())) and back.nodes.count() == 9
    text.write_edge_list(g, f"{tmp_path}/e", first=1)
    back, _ = text.read_edge_list(spark, f"{tmp_path}/e", first=1)
    assert sorted(map(tuple, back.edges.collect())) == sorted(map(tuple, g.edges.collect())) and back.nodes.count() == 8
    (tmp_path / "names").write_text("# c\nb a 2\na c 3\na b 9\n")
    named, ids = text.read_edge_list(spark, f"{tmp_path}/names", " ", continuous=False)
    assert values(ids, "key", "id") == {"b": 0, "a": 1, "c": 2} and sorted(map(tuple, named.edges.collect())) == [(1, 0, 2.0), (2, 1, 3.0)]


def test_events(spark):
    rows = [(0, "node_add", 9, None, None), (1, "edge_add", 1, 2, 1.0), (2, "edge_add", 2, 3, 1.0), (3, "edge_remove", 1, 2, None), (4, "edge_add", 1, 2, 4.0), (5, "weight_add", 2, 1, 0.5), (6, "node_remove", 3, None, None)]
    g = events.fold(spark.createDataFrame(rows, events.SCHEMA))
    assert sorted(map(tuple, g.edges.collect())) == [(2, 1, 4.5)] and sorted(r[0] for r in g.nodes.collect()) == [1, 2, 9]
    assert events.difference(g, g).count() == 0
