"""Generators: shapes, exact recounts in plain Python, and that a graph comes out the same again."""

import math
from collections import Counter

import numpy as np
import pytest

from weftgraph.operators import generators as gen
from weftgraph.streaming import events


def edges(g):
    return sorted((r["src"], r["dst"]) for r in g.edges.collect())


def test_lattices(spark):
    assert edges(gen.ring_lattice(spark, 6, 2)) == sorted({(max(i, (i + j) % 6), min(i, (i + j) % 6)) for i in range(6) for j in (1, 2)})
    g = gen.watts_strogatz(spark, 100, 3, 0.3, seed=4)
    again = edges(gen.watts_strogatz(spark, 100, 3, 0.3, seed=4))
    assert edges(g) == again and 250 < len(again) <= 300 and len(set(again) - set(edges(gen.ring_lattice(spark, 100, 3)))) > 40


def test_pairs_with_probabilities(spark):
    assert len(edges(gen.erdos_renyi(spark, 20, 1.0))) == 190
    assert len(edges(gen.erdos_renyi(spark, 5, 1.0, directed=True))) == 20 and len(edges(gen.erdos_renyi(spark, 5, 1.0, True, True))) == 25
    found = edges(gen.erdos_renyi(spark, 400, 0.05))
    assert abs(len(found) - 3990) < 300 and len(set(found)) == len(found) and all(u > v for u, v in found)
    g, blocks = gen.clustered(spark, 200, 4, 0.5, 0.0)
    of = {r["node"]: r["block"] for r in blocks.collect()}
    want = sum(n * (n - 1) / 4 for n in Counter(of.values()).values())
    found = edges(g)
    assert all(of[u] == of[v] for u, v in found) and abs(len(found) - want) < 0.1 * want


def test_chung_lu_follows_degrees(spark):
    degrees = spark.range(300).selectExpr("id AS node", "IF(id < 30, 40, 5) AS degree")
    found = Counter(x for e in edges(gen.chung_lu(spark, degrees)) for x in e)
    assert abs(np.mean([found[i] for i in range(30)]) - 40) < 5 and abs(np.mean([found[i] for i in range(30, 300)]) - 5) < 1


def test_attachment(spark):
    rows = sorted((r["e"], r["src"], r["dst"]) for r in gen.attached(spark, 500, 2).collect())
    assert [r[1] for r in rows] == [e // 2 for e in range(1000)] and all(d <= s for _, s, d in rows)
    top = max(Counter(x for _, *e in rows for x in e).values())
    assert top > 20
    rows = sorted((r["e"], r["src"], r["dst"]) for r in gen.grown(spark, 50).collect())
    assert rows[:3] == [(0, 1, 0), (1, 2, 0), (2, 2, 1)] and len(rows) == 97
    known = {(1, 0), (2, 0), (2, 1)}
    for v in range(3, 50):
        a, b = sorted(d for _, s, d in rows if s == v)
        assert (b, a) in known
        known |= {(v, a), (v, b)}


def test_recursive_matrix(spark):
    g = gen.rmat(spark, 5, 4, 0.57, 0.19, 0.19, 0.05, weighted=True, seed=3)
    assert g.edges.agg({"w": "sum"}).first()[0] == 128 and g.nodes.count() == 32
    assert gen.rmat(spark, 5, 4, 0.57, 0.19, 0.19, 0.05, reduce=10).nodes.count() == 22
    with pytest.raises(ValueError):
        gen.rmat(spark, 2, 1, 0.5, 0.5, 0.5, 0.5)


def test_degree_sequences(spark):
    d = gen.powerlaw_degrees(spark, 1000, 2, 50)
    degrees = [r["degree"] for r in d.collect()]
    assert sum(degrees) % 2 == 0 and min(degrees) == 2 and max(degrees) <= 51 and degrees.count(2) > 300
    frame = lambda s: spark.createDataFrame(list(enumerate(s)), "node long, degree int")
    assert gen.realizable(frame([3, 3, 2, 2])) and not gen.realizable(frame([3, 3, 1, 1])) and not gen.realizable(frame([1, 1, 1]))
    g = gen.havel_hakimi(spark, frame([3, 3, 2, 2, 2]))
    assert Counter(x for e in edges(g) for x in e) == {0: 3, 1: 3, 2: 2, 3: 2, 4: 2} and len(set(edges(g))) == 6
    with pytest.raises(ValueError):
        gen.havel_hakimi(spark, frame([3, 3, 1, 1]))
    found = edges(gen.configuration(spark, d))
    assert all(u > v for u, v in found) and len(found) > 0.8 * sum(degrees) / 2


def test_lfr_keeps_most_edges_inside(spark):
    g, blocks = gen.lfr(spark, 400, 8, 40, -2.0, 20, 60, -1.0, 0.2)
    of = {r["node"]: r["block"] for r in blocks.collect()}
    found = edges(g)
    assert len(of) == 400 and 0.7 < np.mean([of[u] == of[v] for u, v in found]) < 0.9 and len(found) > 1500


def test_hyperbolic_against_all_pairs(spark):
    points, disk = gen.hyperbolic_points(spark, 300)
    at = [(r["id"], r["angle"], r["radius"]) for r in points.collect()]
    want = set()
    for i, a, r in at:
        for j, b, s in at:
            if j < i and math.cosh(r) * math.cosh(s) - math.sinh(r) * math.sinh(s) * math.cos(a - b) <= math.cosh(disk):
                want.add((i, j))
    found = edges(gen.hyperbolic(spark, 300))
    assert found == sorted(want) and 3 < 2 * len(found) / 300 < 12


def test_geometry_against_all_pairs(spark):
    points = spark.range(120).select("id", gen.uniform(1, "id").alias("x"), gen.uniform(2, "id").alias("y"))
    at = [tuple(r) for r in points.collect()]
    for torus in (False, True):
        gap = lambda a, b: min(abs(a - b), 1 - abs(a - b)) if torus else abs(a - b)
        want = sorted((i, j) for i, a, b in at for j, c, d in at if j < i and math.hypot(gap(a, c), gap(b, d)) <= 0.15)
        assert sorted((r["a"], r["b"]) for r in gen.near_pairs(points, 0.15, ["x", "y"], torus).collect()) == want
    g, _ = gen.pub_web(spark, 200, 3, 0.1, 5)
    assert max(Counter(x for e in edges(g) for x in e).values()) <= 5
    g = gen.mocnik(spark, 2, 60, 1.5)
    near = {r["id"]: [r["x0"], r["x1"]] for r in spark.range(60).select("id", gen.uniform(1, __import__("pyspark").sql.functions.lit("x0"), "id").alias("x0"), gen.uniform(1, __import__("pyspark").sql.functions.lit("x1"), "id").alias("x1")).collect()}
    want = []
    for i, p in near.items():
        d = {j: math.dist(p, q) for j, q in near.items() if j != i}
        want += [(i, j) for j in d if d[j] <= 1.5 * min(d.values())]
    assert edges(g) == sorted(want)


def test_event_streams(spark):
    g = events.fold(gen.path_events(spark, 5))
    assert edges(g) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert edges(events.fold(gen.growth_events(gen.grown(spark, 20)))) == edges(gen.dorogovtsev_mendes(spark, 20))
    assert edges(events.fold(gen.growth_events(gen.attached(spark, 30, 2)))) == edges(gen.barabasi_albert(spark, 30, 2))
    fire = gen.forest_fire_events(spark, 30, 0.3)
    assert events.fold(fire).nodes.count() == 30 and events.fold(fire).edges.count() >= 29
    moves = gen.moving_events(spark, 100, 2)
    assert {r["type"] for r in moves.collect()} <= {"edge_add", "edge_remove"}
