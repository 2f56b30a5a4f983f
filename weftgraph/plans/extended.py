"""More registered queries: paths, components, matrices, generators, sets and files; see ``catalogue``."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.operators import algebra, centrality, community, components, distances, generators, linkprediction, scores, tools, triangles
from weftgraph.plans import derived
from weftgraph.plans.catalogue import BLOCKS, EDGE_TRIANGLES, PART, TRIANGLES, WEDGE, query, rounded
from weftgraph.plans.derived import FLOWS, HEAVY, TRADE

DIST = "hop AS (SELECT id AS s, id AS v, 0 AS k FROM nodes UNION SELECT s, adj.v, k + 1 FROM hop JOIN adj ON adj.u = hop.v WHERE k < 24), dist AS MATERIALIZED (SELECT s, v, min(k) AS d FROM hop GROUP BY 1, 2)"
#: Shortest paths, one row each, and their number.
PATHS = f"{DIST}, walk AS (SELECT id AS s, id AS v, 0 AS k FROM nodes UNION ALL SELECT walk.s, adj.v, k + 1 FROM walk JOIN adj ON adj.u = walk.v JOIN dist ON dist.s = walk.s AND dist.v = adj.v AND dist.d = k + 1), sigma AS MATERIALIZED (SELECT s, v, k AS d, count(*) AS n FROM walk GROUP BY 1, 2, 3)"


# --- distances ---


@query(f"WITH RECURSIVE {FLOWS}, {PATHS} SELECT s AS source, v AS node, d::DOUBLE AS dist, n::DOUBLE AS paths FROM sigma")
def shortest_paths(spark, d):
    return distances.pairs(derived.flows(spark, d), weighted=False)


@query(f"WITH RECURSIVE {FLOWS}, {PATHS} SELECT s AS source, v AS node, d::DOUBLE AS dist, n::DOUBLE AS paths FROM sigma")
def shortest_paths_by_joins(spark, d):
    g = derived.flows(spark, d)
    return distances.bfs(g, g.nodes)


@query(f"""WITH RECURSIVE {HEAVY}, {PATHS} SELECT id AS node, round(coalesce(sum(a.n * b.n / c.n), 0), 9) AS score FROM nodes LEFT JOIN (sigma a JOIN sigma b ON a.v = b.s JOIN sigma c ON c.s = a.s AND c.v = b.v AND c.d = a.d + b.d)
ON a.v = id AND a.s <> a.v AND b.v <> b.s GROUP BY id""")
def betweenness(spark, d):
    return rounded(distances.betweenness(derived.heavy(spark, d)), 9)


@query(f"""WITH RECURSIVE {FLOWS}, {PATHS} SELECT id AS node, round(coalesce(sum(a.n * b.n / c.n), 0), 9) AS score FROM nodes LEFT JOIN (sigma a JOIN sigma b ON a.v = b.s JOIN sigma c ON c.s = a.s AND c.v = b.v AND c.d = a.d + b.d)
ON a.v = id AND a.s <> a.v AND b.v <> b.s GROUP BY id""")
def betweenness_directed(spark, d):
    return rounded(distances.betweenness(derived.flows(spark, d)), 9)


@query(f"WITH RECURSIVE {FLOWS}, {DIST}, p AS (SELECT s, sum(d) AS x, count(*) AS r FROM dist GROUP BY s) SELECT s AS node, round(CASE WHEN x > 0 THEN (r - 1.0) / x / 24 * (r - 1) ELSE 0 END, 9) AS score FROM p")
def closeness_generalized(spark, d):
    return rounded(distances.closeness(derived.flows(spark, d), generalized=True), 9)


@query(f"WITH RECURSIVE {HEAVY}, {DIST} SELECT s AS node, round(24.0 / sum(d), 9) AS score FROM dist GROUP BY s")
def closeness(spark, d):
    return rounded(distances.closeness(derived.heavy(spark, d), check=False), 9)


@query(f"WITH RECURSIVE {FLOWS}, {DIST} SELECT s AS node, round(sum(CASE WHEN d > 0 THEN 1.0 / d ELSE 0 END) / 24, 9) AS score FROM dist GROUP BY s")
def harmonic_closeness(spark, d):
    return rounded(distances.harmonic(derived.flows(spark, d)), 9)


@query(f"WITH RECURSIVE {FLOWS}, {DIST}, h AS (SELECT s, round(sum(CASE WHEN d > 0 THEN 1.0 / d ELSE 0 END) / 24, 9) AS x FROM dist GROUP BY s) SELECT s AS node, x AS score FROM h ORDER BY x DESC, s LIMIT 5")
def top_harmonic_closeness(spark, d):
    return distances.top(rounded(distances.harmonic(derived.flows(spark, d)), 9), 5)


@query(f"WITH RECURSIVE {FLOWS}, {DIST}, e AS (SELECT s, max(d) AS e FROM dist GROUP BY s) SELECT e.s AS node, e::DOUBLE AS ecc, min(v) AS farthest FROM e JOIN dist ON dist.s = e.s AND d = e GROUP BY e.s, e")
def eccentricity(spark, d):
    return distances.eccentricity(derived.flows(spark, d))


@query(f"WITH RECURSIVE {FLOWS}, {DIST} SELECT max(d)::DOUBLE AS diameter FROM dist")
def diameter(spark, d):
    return distances.diameter(derived.flows(spark, d))


@query(f"WITH RECURSIVE {HEAVY}, {DIST}, l AS (SELECT s, d, count(*) AS c FROM dist GROUP BY 1, 2), t AS (SELECT s, d, sum(c) OVER (PARTITION BY s ORDER BY d) AS c FROM l) SELECT round(avg(m), 9) AS effective_diameter FROM (SELECT s, min(d)::DOUBLE AS m FROM t WHERE c >= 23 GROUP BY s)")
def effective_diameter(spark, d):
    return rounded(distances.effective_diameter(derived.heavy(spark, d)), 9)


@query(f"WITH RECURSIVE {FLOWS}, {DIST}, c AS (SELECT d, count(*) AS c FROM dist WHERE d > 0 GROUP BY d) SELECT d::DOUBLE AS dist, (sum(c) OVER (ORDER BY d))::BIGINT AS pairs FROM c")
def neighborhood_function(spark, d):
    return distances.neighborhood_function(derived.flows(spark, d))


@query(f"WITH RECURSIVE {FLOWS}, {DIST}, c AS (SELECT d, count(*) AS c FROM dist GROUP BY d) SELECT d::DOUBLE AS dist, round(sum(c) OVER (ORDER BY d) / 625.0, 9) AS share FROM c")
def hop_plot(spark, d):
    return rounded(distances.hop_plot(derived.flows(spark, d)), 9)


@query(f"WITH RECURSIVE {FLOWS}, {DIST} SELECT s AS node, count(*) AS reachable FROM dist GROUP BY s")
def reachable_nodes(spark, d):
    return distances.reachable(derived.flows(spark, d))


@query(f"""WITH RECURSIVE {HEAVY}, ends AS (SELECT min(src) AS a, max(src) AS b FROM edges), p AS (SELECT [a] AS path FROM ends UNION ALL SELECT list_append(path, v) FROM p JOIN adj ON u = path[-1] WHERE len(path) <= 3 AND NOT list_contains(path, v) AND path[-1] <> (SELECT b FROM ends))
SELECT path FROM p WHERE path[-1] = (SELECT b FROM ends)""")
def all_simple_paths(spark, d):
    g = derived.heavy(spark, d)
    a, b = g.edges.agg(F.min("src"), F.max("src")).first()
    return distances.simple_paths(g, a, b, 3)


@query(f"""WITH RECURSIVE {HEAVY}, light AS (SELECT s, t, f FROM (SELECT src AS s, dst AS t, row_number() OVER (ORDER BY w, src, dst) AS f FROM edges)),
near AS MATERIALIZED (SELECT s, t, f FROM light UNION ALL SELECT t, s, f FROM light),
r AS (SELECT f AS e, t AS x FROM light UNION SELECT r.e, near.t FROM r JOIN near ON near.s = r.x AND near.f < r.e)
SELECT count(*) AS edges, sum(w) AS weight FROM (SELECT s, t, f FROM light WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.e = f AND r.x = s)) JOIN edges ON src = s AND dst = t""")
def spanning_forest_weight(spark, d):
    return distances.spanning_forest(derived.heavy(spark, d)).agg(F.count("*").alias("edges"), F.sum("w").alias("weight"))


@query(f"""WITH RECURSIVE {FLOWS}, {DIST} SELECT a.s AS node, min(a.v) AS component FROM dist a JOIN dist b ON a.s = b.v AND a.v = b.s GROUP BY a.s""")
def strong_components(spark, d):
    return components.strong(derived.flows(spark, d))


@query(f"""WITH RECURSIVE {FLOWS}, {DIST} SELECT a.s AS node, min(a.v) AS component FROM dist a JOIN dist b ON a.s = b.v AND a.v = b.s GROUP BY a.s""")
def strong_components_by_joins(spark, d):
    return components._strong(derived.flows(spark, d))


@query(f"""WITH RECURSIVE {FLOWS}, near AS MATERIALIZED (SELECT u, v FROM adj UNION SELECT v, u FROM adj), r AS (SELECT id AS a, id AS b FROM nodes UNION SELECT r.a, near.v FROM r JOIN near ON near.u = r.b) SELECT a AS node, min(b) AS component FROM r GROUP BY a""")
def weak_components(spark, d):
    return components.connected(derived.flows(spark, d))


def _cores_sql(most: int, rounds: int) -> str:
    """Core numbers: for each k, the nodes that survive repeated removal of those with under k
    neighbours among the survivors."""
    steps = []
    for k in range(1, most + 1):
        steps.append(f"c{k}_0 AS MATERIALIZED (SELECT {'id' if k == 1 else 'DISTINCT id'} FROM {'nodes' if k == 1 else f'c{k - 1}_{rounds}'})")
        steps += [f"c{k}_{r} AS MATERIALIZED (SELECT a.id FROM c{k}_{r - 1} a JOIN adj ON u = a.id JOIN c{k}_{r - 1} b ON b.id = v GROUP BY a.id HAVING count(*) >= {k})" for r in range(1, rounds + 1)]
    every = " UNION ALL ".join(f"SELECT id FROM c{k}_{rounds}" for k in range(1, most + 1))
    return f"WITH {HEAVY}, {', '.join(steps)} SELECT nodes.id AS node, count(x.id)::DOUBLE AS score FROM nodes LEFT JOIN ({every}) x ON x.id = nodes.id GROUP BY nodes.id"


@query(_cores_sql(10, 8))
def core_numbers(spark, d):
    return centrality.core(derived.heavy(spark, d))


@query(_cores_sql(10, 8))
def core_numbers_by_joins(spark, d):
    return centrality._cores(derived.heavy(spark, d))


# --- sets and partitions ---


@query(f"WITH {PART}, s AS (SELECT id, coalesce((block <= 10)::INT, 0) AS x FROM nodes LEFT JOIN size_of ON id = node), c AS (SELECT sum(w) AS c FROM adj JOIN s a ON a.id = u JOIN s b ON b.id = v WHERE a.x = 1 AND b.x = 0), v AS (SELECT x, sum(wd) AS v FROM s JOIN deg USING (id) GROUP BY x) SELECT round((SELECT c FROM c) / min(v), 9) AS conductance FROM v")
def set_conductance(spark, d):
    small = derived.sizes(spark, d).filter("block <= 10").select(F.col("node").alias("id"))
    return rounded(community.set_conductance(derived.copurchase(spark, d), small), 9)


@query(f"WITH {PART}, s AS (SELECT block, count(*) AS n FROM size_of GROUP BY block) SELECT round(max(n) / ceil(sum(n) / count(*)), 9) AS imbalance FROM s")
def partition_imbalance(spark, d):
    return rounded(community.imbalance(derived.sizes(spark, d)), 9)


@query(f"WITH {PART}, {BLOCKS}, s AS (SELECT block, size, CASE WHEN size < 2 THEN 1 ELSE coalesce(m, 0) / (size * (size - 1) / 2.0) END AS x FROM vol LEFT JOIN inn USING (block)) SELECT round(avg(x), 12) AS unweighted, round(sum(x * size) / sum(size), 12) AS weighted, round(min(x), 12) AS least, round(max(x), 12) AS most FROM s")
def block_density_averages(spark, d):
    blocks = derived.sizes(spark, d)
    return rounded(community.averages(community.density(derived.copurchase(spark, d), blocks), community.sizes(blocks)), 12)


@query(f"WITH {PART}, d AS (SELECT block, dense_rank() OVER (ORDER BY block) - 1 AS new FROM (SELECT DISTINCT block FROM brand_of)) SELECT node, new AS block FROM brand_of JOIN d USING (block)")
def compact_partition(spark, d):
    return community.compact(derived.brands(spark, d))


@query(f"WITH {PART} SELECT id AS node, (row_number() OVER (ORDER BY id) - 1) % 7 AS block FROM nodes")
def interleaved_partition(spark, d):
    return community.interleaved(derived.copurchase(spark, d), 7)


@query(f"WITH {PART} SELECT id AS node, floor((row_number() OVER (ORDER BY id) - 1) * 7 / (SELECT count(*) FROM nodes))::BIGINT AS block FROM nodes")
def balanced_partition(spark, d):
    return community.balanced(derived.copurchase(spark, d), 7)


# --- scores and links ---


@query(f"""WITH {PART}, {EDGE_TRIANGLES}, b AS (SELECT src, dst, w, src AS u, t FROM te UNION ALL SELECT src, dst, w, dst, t FROM te), r AS (SELECT *, rank() OVER (PARTITION BY u ORDER BY t DESC) AS r, count(*) OVER (PARTITION BY u) AS d FROM b)
SELECT src, dst, w, round(max(CASE WHEN d > 1 THEN 1 - ln(r) / ln(d) ELSE 1 END), 9) AS score FROM r GROUP BY 1, 2, 3""")
def local_filter_score(spark, d):
    return rounded(scores.local_filter(triangles.edge_triangles(derived.copurchase(spark, d))), 9)


@query(f"WITH {PART}, {EDGE_TRIANGLES} SELECT src, dst, 1 + 2.0 * t * t AS w FROM te")
def score_as_weight(spark, d):
    g = derived.copurchase(spark, d)
    return scores.as_weight(g, triangles.edge_triangles(g), squared=True, factor=2.0).edges


@query(f"WITH {PART}, {EDGE_TRIANGLES} SELECT src, dst, w, CASE WHEN w > 2 THEN w ELSE t::DOUBLE END AS score FROM te")
def blended_score(spark, d):
    g = derived.copurchase(spark, d)
    t = triangles.edge_triangles(g).withColumn("score", F.col("score").cast("double"))
    return scores.blend(t, g.edges.withColumn("score", F.col("w")), g.edges.filter("w > 2"))


@query(f"WITH {PART}, {TRIANGLES} SELECT deg.id AS node, coalesce(t, 0) AS triangles FROM deg LEFT JOIN tn USING (id)")
def node_triangles(spark, d):
    return algebra.triangle_counts(derived.copurchase(spark, d))


@query(f"WITH {PART}, {WEDGE} SELECT u, v, (p.block = q.block)::INT::DOUBLE AS score FROM cand JOIN size_of p ON p.node = u JOIN size_of q ON q.node = v")
def same_community_index(spark, d):
    g = derived.copurchase(spark, d)
    return linkprediction.same_community(linkprediction.candidates(g), derived.sizes(spark, d))


@query(f"WITH {PART}, {WEDGE} SELECT u, v FROM cand ORDER BY c DESC, u, v LIMIT 50")
def best_links(spark, d):
    g = derived.copurchase(spark, d)
    return linkprediction.by_count(linkprediction.indices(g, linkprediction.candidates(g)).select("u", "v", F.col("common_neighbors").alias("score")), 50)


@query(f"WITH {PART}, {WEDGE} SELECT u, v FROM cand WHERE c >= 2")
def links_over_threshold(spark, d):
    g = derived.copurchase(spark, d)
    return linkprediction.by_score(linkprediction.indices(g, linkprediction.candidates(g)).select("u", "v", F.col("common_neighbors").alias("score")), 2)


# --- matrices ---


@query(f"WITH {TRADE} SELECT a.src AS i, b.dst AS j, min(a.w + b.w) AS v FROM edges a JOIN edges b ON a.dst = b.src GROUP BY 1, 2")
def min_plus_square(spark, d):
    a = algebra.adjacency(derived.trade(spark, d))
    return algebra.multiply(a, a, algebra.MIN_PLUS)


@query(f"WITH {TRADE} SELECT a.src AS i, b.dst AS j, max(least(a.w, b.w)) AS v FROM edges a JOIN edges b ON a.dst = b.src GROUP BY 1, 2")
def max_min_square(spark, d):
    a = algebra.adjacency(derived.trade(spark, d))
    return algebra.multiply(a, a, algebra.MAX_MIN)


@query(f"WITH {TRADE} SELECT a.src AS i, b.dst AS j, sum(a.w * b.w) AS v FROM edges a JOIN edges b ON a.dst = b.src GROUP BY 1, 2")
def matrix_square(spark, d):
    a = algebra.adjacency(derived.trade(spark, d))
    return algebra.multiply(a, a)


@query(f"WITH {HEAVY} SELECT u AS i, v AS j, -w AS v FROM adj UNION ALL SELECT id, id, wd FROM deg WHERE d > 0")
def laplacian_matrix(spark, d):
    return algebra.laplacian(derived.heavy(spark, d))


@query(f"WITH {HEAVY} SELECT i, j, round(x.v / sqrt(a.wd * b.wd), 9) AS v FROM (SELECT u AS i, v AS j, -w AS v FROM adj UNION ALL SELECT id, id, wd FROM deg WHERE d > 0) x JOIN deg a ON a.id = i JOIN deg b ON b.id = j")
def normalized_laplacian_matrix(spark, d):
    return rounded(algebra.normalized_laplacian(derived.heavy(spark, d)), 9)


@query(f"WITH {TRADE} SELECT src AS i, sum(w * (dst + 1)) AS v FROM edges GROUP BY src")
def matrix_times_vector(spark, d):
    g = derived.trade(spark, d)
    return algebra.times(algebra.adjacency(g), g.nodes.select(F.col("id").alias("i"), (F.col("id") + 1).cast("double").alias("v")))


@query(f"WITH {TRADE} SELECT coalesce(a.src, b.dst) AS i, coalesce(a.dst, b.src) AS j, coalesce(a.w, 0) + coalesce(b.w, 0) AS v FROM edges a FULL JOIN edges b ON a.src = b.dst AND a.dst = b.src")
def matrix_plus_transpose(spark, d):
    a = algebra.adjacency(derived.trade(spark, d))
    return algebra.combined(a, algebra.transpose(a))


@query(f"WITH RECURSIVE {FLOWS}, {DIST} SELECT v AS node, d::DOUBLE AS dist FROM dist WHERE s = (SELECT min(src) FROM edges)")
def algebraic_bfs(spark, d):
    g = derived.flows(spark, d)
    return algebra.reach(g, g.edges.agg(F.min("src")).first()[0])


@query(f"""WITH RECURSIVE {TRADE}, p AS (SELECT id AS s, id AS v, 0.0::DOUBLE AS x, 0 AS k FROM nodes WHERE id = 0 UNION SELECT s, dst, min(x + w), min(k) + 1 FROM p JOIN edges ON src = v WHERE k < 8 GROUP BY s, dst)
SELECT v AS node, min(x) AS dist FROM p GROUP BY v""")
def algebraic_bellman_ford(spark, d):
    return algebra.bellman_ford(derived.trade(spark, d), 0)


# --- generators: rows by formula ---

_U = "('0x' || substr(md5({}), 1, 13))::BIGINT / 4503599627370496.0"


@query("SELECT greatest(i, (i + j) % 200) AS src, least(i, (i + j) % 200) AS dst, 1.0::DOUBLE AS w FROM range(200) a(i), range(1, 4) b(j)")
def ring_lattice(spark, d):
    return generators.ring_lattice(spark, 200, 3).edges


def _rmat_sql(scale: int, factor: int, a: float, b: float, c: float) -> str:
    u = ", ".join(f"{_U.format(f"'1:{k}:' || e")} AS u{k}" for k in range(scale))
    src = " + ".join(f"(u{k} >= {a + b!r})::BIGINT * {1 << (scale - 1 - k)}" for k in range(scale))
    dst = " + ".join(f"(u{k} >= {a!r} AND u{k} < {a + b!r} OR u{k} >= {a + b + c!r})::BIGINT * {1 << (scale - 1 - k)}" for k in range(scale))
    return f"WITH r AS (SELECT {u} FROM range({factor << scale}) t(e)), c AS (SELECT {src} AS s, {dst} AS t FROM r) SELECT greatest(s, t)::BIGINT AS src, least(s, t)::BIGINT AS dst, count(*)::DOUBLE AS w FROM c GROUP BY 1, 2"


@query(_rmat_sql(8, 8, 0.57, 0.19, 0.19))
def rmat_graph(spark, d):
    return generators.rmat(spark, 8, 8, 0.57, 0.19, 0.19, 0.05, weighted=True).edges


def _watts_sql(n: int, k: int, p: float, draws: int = 8) -> str:
    tries = [f"floor({_U.format(f"'1:to{j}:' || src || ':' || dst")} * {n})::BIGINT" for j in range(draws)]
    near = lambda t: f"least((({t}) - src + {n}) % {n}, (src - ({t}) + {n}) % {n}) <= {k}"
    moved = "coalesce(" + ", ".join(f"CASE WHEN NOT ({near(t)}) THEN {t} END" for t in tries) + ", dst)"
    return f"""WITH ring AS (SELECT greatest(i, (i + j) % {n}) AS src, least(i, (i + j) % {n}) AS dst FROM range({n}) a(i), range(1, {k + 1}) b(j)),
m AS (SELECT src AS s, CASE WHEN {_U.format("'1:move:' || src || ':' || dst")} < {p} THEN {moved} ELSE dst END AS t FROM ring) SELECT greatest(s, t) AS src, least(s, t) AS dst, min(1.0)::DOUBLE AS w FROM m GROUP BY 1, 2"""


@query(_watts_sql(300, 2, 0.2))
def watts_strogatz_graph(spark, d):
    return generators.watts_strogatz(spark, 300, 2, 0.2).edges


@query(f"""WITH p AS (SELECT i AS id, {_U.format("'1:x:' || i")} AS x, {_U.format("'1:y:' || i")} AS y FROM range(400) t(i))
SELECT a.id AS a, b.id AS b, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 9) AS dist FROM p a JOIN p b ON a.id > b.id WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.08""")
def geometric_pairs(spark, d):
    points = spark.range(400).select("id", *[generators.uniform(1, F.lit(c), "id").alias(c) for c in ("x", "y")])
    return rounded(generators.near_pairs(points, 0.08, ["x", "y"]), 9)


# --- single methods ---


@query(f"WITH {PART} SELECT id, d AS degree, wd AS weighted FROM deg")
def node_degrees(spark, d):
    return derived.copurchase(spark, d).degrees()


@query(f"WITH {TRADE} SELECT id, count(v) AS degree, coalesce(sum(w), 0) AS weighted FROM nodes LEFT JOIN rev ON u = id GROUP BY id")
def node_in_degrees(spark, d):
    return derived.trade(spark, d).degrees(incoming=True)


@query(f"WITH {TRADE} SELECT src, dst, w FROM edges WHERE src <> dst")
def without_self_loops(spark, d):
    return tools.without_loops(derived.trade(spark, d)).edges


@query(f"WITH {PART} SELECT src, dst, w FROM edges WHERE src NOT IN (SELECT node FROM size_of WHERE block <= 10) AND dst NOT IN (SELECT node FROM size_of WHERE block <= 10)")
def without_some_nodes(spark, d):
    gone = derived.sizes(spark, d).filter("block <= 10").select(F.col("node").alias("id"))
    return tools.without_nodes(derived.copurchase(spark, d), gone).edges


@query(f"WITH {PART} SELECT src, dst, w FROM edges WHERE w < 3")
def without_some_edges(spark, d):
    g = derived.copurchase(spark, d)
    return tools.without_edges(g, g.edges.filter("w >= 3")).edges


@query(f"WITH {TRADE}, i AS (SELECT u, sum(w) AS s FROM rev GROUP BY u) SELECT sum(s) AS volume FROM i WHERE u < 10")
def in_volume_of_set(spark, d):
    g = derived.trade(spark, d)
    return tools.volume(g, g.nodes.filter("id < 10"), incoming=True)


@query(f"WITH {PART} SELECT src, dst, 1.0::DOUBLE AS w FROM edges")
def to_unweighted(spark, d):
    return tools.unweighted(derived.copurchase(spark, d)).edges


@query(f"WITH {PART} SELECT src, dst, w, row_number() OVER (ORDER BY src, dst, w) - 1 AS eid FROM edges")
def edge_ids(spark, d):
    from weftgraph.graph import index_edges

    return index_edges(derived.copurchase(spark, d)).edges


# --- groups, changes, figures ---


def _insertion(spark, d):
    """The lightest quarter of the heavy trade's edges as insertions, the rest as the graph before."""
    from weftgraph.graph import numbered, replace

    g = derived.heavy(spark, d)
    at = numbered(g.edges, ["w", "src", "dst"], "at")
    late = at.filter("at < 27").select("src", "dst", "w")
    early = replace(g, edges=at.filter("at >= 27").select("src", "dst", "w")).kept()
    return g, early, late


@query(f"WITH RECURSIVE {HEAVY}, {DIST} SELECT v AS node, d::DOUBLE AS dist FROM dist WHERE s = 0")
def distances_after_insertion(spark, d):
    from weftgraph.operators import dynamics

    g, early, late = _insertion(spark, d)
    old = distances.bfs(early, g.nodes.filter("id = 0")).select("source", "node", "dist")
    return dynamics.distances_after(g, old, late).select("node", "dist")


@query(f"WITH RECURSIVE {HEAVY}, {DIST} SELECT s AS node, min(v) AS component FROM dist GROUP BY s")
def components_after_insertion(spark, d):
    from weftgraph.operators import dynamics

    _, early, late = _insertion(spark, d)
    return dynamics.components_after(components.connected(early), late)


@query(f"""WITH {HEAVY}, a AS (SELECT id FROM deg ORDER BY d DESC, id LIMIT 1), hit AS (SELECT v AS id FROM adj WHERE u = (SELECT id FROM a) UNION SELECT id FROM a),
g AS (SELECT n.id, count(x.v) + (n.id NOT IN (SELECT id FROM hit))::INT AS n FROM nodes n LEFT JOIN (SELECT u, v FROM adj WHERE v NOT IN (SELECT id FROM hit)) x ON x.u = n.id WHERE n.id <> (SELECT id FROM a) GROUP BY n.id)
SELECT id AS node FROM a UNION ALL SELECT id FROM (SELECT id FROM g ORDER BY n DESC, id LIMIT 1)""")
def group_degree(spark, d):
    from weftgraph.operators import groups

    return spark.createDataFrame([(x,) for x in groups.group_degree(derived.heavy(spark, d), 2)], "node long")


@query(f"WITH RECURSIVE {FLOWS}, {DIST} SELECT d::DOUBLE AS dist FROM dist WHERE s = (SELECT min(src) FROM edges) AND v = (SELECT max(dst) FROM edges)")
def source_target_distance(spark, d):
    from weftgraph.operators import embedding

    g = derived.flows(spark, d)
    a, b = g.edges.agg(F.min("src"), F.max("dst")).first()
    found = embedding.between_two(g, a, b)
    return spark.createDataFrame([] if found is None else [(found,)], "dist double")


@query(f"""WITH RECURSIVE {HEAVY}, c AS (SELECT [id] AS c FROM nodes UNION ALL SELECT list_append(c.c, adj.v) FROM c JOIN adj ON adj.u = c.c[1] AND adj.v > c.c[-1]
  WHERE (SELECT count(*) FROM adj x WHERE x.u = adj.v AND list_contains(c.c, x.v)) = len(c.c))
SELECT c AS clique FROM c WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE (SELECT count(*) FROM adj x WHERE x.u = n.id AND list_contains(c.c, x.v)) = len(c.c))""")
def maximal_cliques(spark, d):
    from weftgraph.operators import local

    return local.maximal_cliques(derived.heavy(spark, d))


@query(f"WITH {PART}, r AS (SELECT d, row_number() OVER (ORDER BY d) AS i FROM deg) SELECT round(2.0 * sum(d * i) / (count(*) * sum(d)) - (count(*) + 1.0) / count(*), 9) AS gini FROM r")
def degree_gini(spark, d):
    from weftgraph import functions

    return rounded(functions.gini(centrality.degree(derived.copurchase(spark, d))), 9)


@query(f"WITH {PART} SELECT id AS node, (2 * rank() OVER (ORDER BY d DESC) + count(*) OVER (PARTITION BY d) - 1) / 2.0 AS rank FROM deg")
def degree_ranks(spark, d):
    from weftgraph import functions

    return functions.ranked(centrality.degree(derived.copurchase(spark, d)))


@query(f"WITH {PART}, a AS (SELECT id, (2 * rank() OVER (ORDER BY d DESC) + count(*) OVER (PARTITION BY d) - 1) / 2.0 AS x, (2 * rank() OVER (ORDER BY wd DESC) + count(*) OVER (PARTITION BY wd) - 1) / 2.0 AS y FROM deg) SELECT round(corr(x, y), 9) AS correlation FROM a")
def degree_weight_correlation(spark, d):
    from weftgraph import functions

    deg = derived.copurchase(spark, d).degrees()
    a, b = deg.select(F.col("id").alias("node"), F.col("degree").alias("score")), deg.select(F.col("id").alias("node"), F.col("weighted").alias("score"))
    return rounded(functions.correlation(a, b), 9)


@query(f"WITH {PART}, {TRIANGLES}, c AS (SELECT deg.d, CASE WHEN d < 2 THEN 0 ELSE 2.0 * coalesce(t, 0) / (d * (d - 1)) END AS s FROM deg LEFT JOIN tn USING (id)) SELECT d AS degree, round(avg(s), 9) AS score, count(*) AS n FROM c GROUP BY d")
def clustering_per_degree(spark, d):
    from weftgraph import functions

    g = derived.copurchase(spark, d)
    return rounded(functions.per_degree(g, centrality.local_clustering(g)), 9)


@query(f"WITH {PART} SELECT id FROM deg WHERE d = 0")
def isolated_nodes(spark, d):
    return tools.isolated(derived.copurchase(spark, d))


@query(f"WITH {TRADE} SELECT src, dst, w FROM edges WHERE src <> 3")
def without_out_edges(spark, d):
    return tools.without_edges_of(derived.trade(spark, d), 3, incoming=False).edges


@query(f"""WITH {HEAVY}, p AS MATERIALIZED (SELECT a.id AS u, b.id AS v, CASE WHEN a.d > b.d THEN b.id ELSE a.id END AS s, CASE WHEN a.d > b.d THEN a.id ELSE b.id END AS t FROM deg a JOIN deg b ON a.id < b.id),
f1 AS (SELECT s.s, adj.v AS t, count(*) AS k FROM (SELECT DISTINCT s, s AS x FROM p) s JOIN adj ON adj.u = s.x GROUP BY 1, 2), f2 AS (SELECT s, adj.v AS t, count(*) AS k FROM f1 JOIN adj ON adj.u = f1.t GROUP BY 1, 2), f3 AS (SELECT s, adj.v AS t, count(*) AS k FROM f2 JOIN adj ON adj.u = f2.t GROUP BY 1, 2),
h AS (SELECT s, t, k * 0.05 AS x FROM f1 UNION ALL SELECT s, t, k * 0.05 ** 2 FROM f2 UNION ALL SELECT s, t, k * 0.05 ** 3 FROM f3)
SELECT u, v, round(coalesce(sum(x), 0), 9) AS score FROM p LEFT JOIN h ON h.s = p.s AND h.t = p.t GROUP BY 1, 2""")
def katz_index(spark, d):
    g = derived.heavy(spark, d)
    ids = g.nodes.select(F.col("id").alias("v"))
    pairs = tools.node_pairs(g, g.nodes.select(F.col("id").alias("u")).join(ids, F.col("u") < F.col("v")))  # 25 nodes
    return rounded(linkprediction.katz_index(g, pairs, 3, 0.05), 9)


@query(f"""WITH {PART}, {WEDGE}, ev AS (SELECT count(*) AS n FROM cand WHERE c >= 2) SELECT (SELECT n FROM ev) AS links, count(*) AS candidates FROM cand""")
def link_counts(spark, d):
    g = derived.copurchase(spark, d)
    found = linkprediction.indices(g, linkprediction.candidates(g))
    return found.agg(F.sum((F.col("common_neighbors") >= 2).cast("long")).alias("links"), F.count("*").alias("candidates"))
