"""Steps whose tasks, disk and time must not outgrow the input, and queries on tables that leave a graph empty."""

import math
from collections import Counter
from itertools import combinations

import pytest

from weftgraph.graph import graph, spread
from weftgraph.operators import components, distances, kernels, scores, stars, triangles
from weftgraph.plans import catalogue, derived, extended  # noqa: F401 (registers its queries)


def write(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_partitions_grow_with_the_rows(spark):
    assert spread(spark, 0) == 1 and spread(spark, 100_000) <= 5
    assert spread(spark, 50_000_000) == 100


def test_copurchase_tasks_do_not_grow(spark, tmp_path, monkeypatch):
    lines = [(o, (o * (j + 3) + j * j) % 97) for o in range(400) for j in range(4)]
    sf = write(spark, tmp_path, lineitem=(lines, "l_orderkey long, l_partkey long"), part=([(p,) for p in range(97)], "p_partkey long"))
    monkeypatch.setattr(derived, "spread", lambda s, rows: spread(s, rows, 100))
    bought = {}
    for o, p in lines:
        bought.setdefault(o, set()).add(p)
    want = Counter((max(x), min(x)) for parts in bought.values() for x in combinations(parts, 2))
    for least in (1, 2):
        g = derived.copurchase(spark, sf, least)
        assert {(r["src"], r["dst"]): r["w"] for r in g.edges.collect()} == {e: w for e, w in want.items() if w >= least}
        assert g.edges.rdd.getNumPartitions() == 32  # merged to about as many as cores before
        assert g.weighted and not g.directed and g.nodes.count() == 97


@pytest.mark.parametrize(("nodes", "edges", "base", "colours", "hubs"), [(12, 30, 0, 1, 200_000), (150, 2500, -5, 3, 20), (200, 3000, 1 << 40, 5, 0), (50, 0, 0, 2, 5)])
def test_triangles_without_travelling_wedges(spark, monkeypatch, nodes, edges, base, colours, hubs):
    monkeypatch.setattr(triangles, "_colours", lambda m: colours)
    monkeypatch.setattr(triangles, "HUBS", hubs)
    # A hub at all nodes, self-loops and repeated edges.
    ends = [(x * x % nodes, (x * 7 + x // nodes * 11) % nodes) for x in range(edges)] + [(0, x) for x in range(nodes if edges else 0)]
    g = graph(spark.createDataFrame([(base + a, base + b) for a, b in ends], "src long, dst long"), spark.range(base, base + nodes))
    pairs = {(base + max(a, b), base + min(a, b)) for a, b in ends if a != b}
    near = {x: {b if a == x else a for a, b in pairs if x in (a, b)} for x in range(base, base + nodes)}
    found = triangles.triangles(g)
    assert "LeftSemi" not in found._jdf.queryExecution().toString()  # wedges met the edges in a join before
    assert Counter(tuple(sorted(r)) for r in found.collect()) == Counter({tuple(sorted((a, b, c))) for a, b in pairs for c in near[a] & near[b]})
    got = triangles.edge_triangles(g)
    assert got.count() == len(ends)
    assert {(r["src"], r["dst"]): r["score"] for r in got.filter("src <> dst").collect()} == {(a, b): len(near[a] & near[b]) for a, b in pairs}


@pytest.fixture(scope="module")
def even(spark, tmp_path_factory):
    """Every pair of nations trades the same, so that none trades more than most."""
    n = range(25)
    return write(
        spark, tmp_path_factory.mktemp("even"),
        nation=([(x,) for x in n], "n_nationkey long"), customer=([(x, x) for x in n], "c_custkey long, c_nationkey long"),
        supplier=([(x, x) for x in n], "s_suppkey long, s_nationkey long"), orders=([(x, x) for x in n], "o_orderkey long, o_custkey long"),
        lineitem=([(x, y) for x in n for y in n], "l_orderkey long, l_suppkey long"),
    )


def test_closeness_of_what_is_reached(spark, even):
    g = graph(spark.createDataFrame([(1, 0), (2, 1)], "src long, dst long"), spark.range(4))
    with pytest.raises(ValueError):
        distances.closeness(g)
    assert {r["node"]: r["score"] for r in distances.closeness(g, check=False).collect()} == {0: 1, 1: 1.5, 2: 1, 3: float("inf")}
    assert {r["score"] for r in catalogue.QUERIES["closeness"](spark, even).collect()} == {float("inf")}  # as in SQL; an error before


def test_no_distance_without_edges(spark, even):
    assert catalogue.QUERIES["source_target_distance"](spark, even).collect() == []  # 0 from null to null before


def test_adamic_adar_is_exact_but_for_one_rounding(spark, monkeypatch):
    monkeypatch.setattr(triangles, "_colours", lambda m: 3)
    pairs = {(max(a, b), min(a, b)) for a in range(70) for b in (a * a % 70, (a * 3 + 1) % 70, a // 2, a // 3, (a + 5) % 70, 0, 1) if a != b}
    near = {x: {b if a == x else a for a, b in pairs if x in (a, b)} for x in range(70)}
    want = {(a, b): math.fsum(1 / math.log(len(near[c])) for c in near[a] & near[b]) for a, b in pairs}
    got = scores.adamic_adar_distance(graph(spark.createDataFrame(sorted(pairs), "src long, dst long")))
    # The sum took its terms as they came before.
    assert {(r["src"], r["dst"]): r["score"] for r in got.collect()} == {e: 1 / s if s else math.inf for e, s in want.items()}


def test_rounding_is_that_of_the_sql(spark):
    x = 2.3992852614999998  # 2.399285261 by its decimal form
    got = catalogue.rounded(spark.createDataFrame([(x,), (-x,), (1e300,), (math.inf,), (None,)], "x double").coalesce(1), 9)
    y = math.floor(x * 1e9 + 0.5) / 1e9
    assert [r["x"] for r in got.collect()] == [y, -y, 1e300, math.inf, None]


@pytest.mark.parametrize("small", [True, False])
def test_components_of_a_dense_graph_by_a_part_of_its_edges(spark, monkeypatch, small):
    # Three dense blocks, of which two hang together by one edge, and nodes without edges.
    ends = [(x, y) for block in (0, 100, 200) for x in range(block, block + 40) for y in range(block, x)] + [(139, 205), (150, 150)]
    g = graph(spark.createDataFrame(ends, "src long, dst long"), spark.range(260))
    monkeypatch.setattr(kernels, "SMALL", 10)
    monkeypatch.setattr(kernels, "small", lambda graph, most=0: small and graph.edges.count() < 1000)
    rows = []
    monkeypatch.setattr(components, "star_components", lambda edges: rows.append(edges.count()) or stars.star_components(edges))
    found = {r["node"]: r["component"] for r in components.connected(g).collect()}
    assert found == {x: 0 if x < 40 else 100 if 100 <= x < 140 or 200 <= x < 240 else x for x in range(260)}
    assert sum(rows) < len(ends) / 2  # all edges took part in the rounds before


def test_local_degree_in_tasks_that_do_not_grow(spark, monkeypatch):
    monkeypatch.setattr(scores, "spread", lambda s, rows: 7)
    pairs = sorted({(max(a, b), min(a, b)) for a in range(40) for b in (a * a % 40, a // 2, a // 3, 0) if a != b})
    near = {x: {b if a == x else a for a, b in pairs if x in (a, b)} for x in range(40)}
    degree = {x: len(near[x]) for x in near}

    def part(u, v):
        rank = 1 + sum(degree[x] > degree[v] for x in near[u])
        return 1 - math.log(rank) / math.log(degree[u]) if degree[u] > 1 else 1.0

    got = scores.local_degree(graph(spark.createDataFrame(pairs, "src long, dst long")))
    assert got.rdd.getNumPartitions() == 14  # merged to about as many as cores before
    assert {(r["src"], r["dst"]): r["score"] for r in got.collect()} == pytest.approx({(a, b): max(part(a, b), part(b, a)) for a, b in pairs})
