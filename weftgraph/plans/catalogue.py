"""Registered queries of the graph operators: name -> callable, and name -> equivalent SQL.

Every query reads whole tables; some graphs keep their heavier edges only (see ``derived``). Scores that depend on the
order of a floating sum are rounded in both forms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import centrality, community, components, distances, linkprediction, scores, tools, triangles
from weftgraph.plans import derived
from weftgraph.plans.derived import BASKET, TRADE, copurchase_sql

QUERIES: dict = {}
ORACLES: dict = {}

PART = copurchase_sql(2)
#: With the pairs that were bought together once, each step computed once. Queries over pairs of nodes at
#: two steps use PART, as nearly all pairs of parts are at two steps in the whole graph.
WHOLE = copurchase_sql(1).replace(" AS (SELECT", " AS MATERIALIZED (SELECT")


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded as the SQL's engine does: scaled, rounded to a whole number, scaled back. Spark's ``round`` works on
    their shortest decimal form, which is on the other side of a tie now and then."""
    by = float(10**digits)
    return df.select(*[F.when(F.abs(c) < 2.0**52 / by, F.round(F.col(c) * by) / by).otherwise(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- sizes, degrees, subgraphs ---


@query(f"WITH {WHOLE} SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM edges) AS m")
def graph_size(spark, d):
    return tools.size(derived.copurchase(spark, d, 1))


@query(f"WITH {WHOLE} SELECT round(2.0 * (SELECT count(*) FROM edges) / ((SELECT count(*) FROM nodes) * ((SELECT count(*) FROM nodes) - 1)), 12) AS density")
def graph_density(spark, d):
    return rounded(tools.density(derived.copurchase(spark, d, 1)), 12)


@query(f"""WITH {TRADE}, o AS (SELECT u, count(*) AS d, sum(w) AS s FROM adj GROUP BY u), i AS (SELECT u, count(*) AS d, sum(w) AS s FROM rev GROUP BY u)
SELECT (SELECT max(d) FROM o) AS max_out, (SELECT max(d) FROM i) AS max_in, (SELECT max(s) FROM o) AS max_weighted_out, (SELECT max(s) FROM i) AS max_weighted_in""")
def max_degrees(spark, d):
    return tools.max_degree(derived.trade(spark, d))


@query(f"WITH {WHOLE} SELECT d AS degree, count(*) AS n FROM deg GROUP BY d")
def degree_distribution(spark, d):
    return tools.degree_distribution(derived.copurchase(spark, d, 1))


@query(f"WITH {TRADE} SELECT src, dst, w FROM edges WHERE src = dst")
def self_loops(spark, d):
    return tools.self_loops(derived.trade(spark, d)).select("src", "dst", "w")


@query(f"WITH {WHOLE} SELECT sum(wd) AS volume FROM deg JOIN size_of ON id = node WHERE block <= 10")
def volume_of_set(spark, d):
    small = derived.sizes(spark, d).filter("block <= 10").select(F.col("node").alias("id"))
    return tools.volume(derived.copurchase(spark, d, 1), small)


@query(f"WITH {WHOLE} SELECT src, dst, w FROM edges WHERE src IN (SELECT node FROM size_of WHERE block <= 25) AND dst IN (SELECT node FROM size_of WHERE block <= 25)")
def induced_subgraph(spark, d):
    small = derived.sizes(spark, d).filter("block <= 25").select(F.col("node").alias("id"))
    return tools.induced(derived.copurchase(spark, d, 1), small).edges


@query(f"WITH {WHOLE} SELECT src, dst, w FROM edges WHERE src IN (SELECT node FROM size_of WHERE block <= 5) OR dst IN (SELECT node FROM size_of WHERE block <= 5)")
def subgraph_with_neighbours(spark, d):
    small = derived.sizes(spark, d).filter("block <= 5").select(F.col("node").alias("id"))
    return tools.around(derived.copurchase(spark, d, 1), small).edges


@query(f"WITH {TRADE} SELECT greatest(src, dst) AS src, least(src, dst) AS dst, sum(w) AS w FROM edges GROUP BY 1, 2")
def to_undirected(spark, d):
    return tools.undirected(derived.trade(spark, d)).edges


@query(f"WITH {TRADE} SELECT dst AS src, src AS dst, w FROM edges")
def transpose(spark, d):
    return tools.transpose(derived.trade(spark, d)).edges


@query(f"WITH {PART}, s AS (SELECT max(id) + 1 AS k FROM nodes) SELECT src, dst, w FROM edges UNION ALL SELECT src + k, dst + k, w FROM edges, s")
def append_graph(spark, d):
    g = derived.copurchase(spark, d)
    return tools.append(g, g).edges


@query(f"""WITH {WHOLE}, x AS (SELECT greatest(src, dst) AS src, least(src, dst) AS dst, w FROM (
  SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, sum(1.0)::DOUBLE AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)), y AS (SELECT src, dst, sum(w) AS w FROM x GROUP BY 1, 2)
SELECT src, dst, w FROM edges UNION ALL SELECT src, dst, w FROM y WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = y.src AND e.dst = y.dst)""")
def merge_graphs(spark, d):
    return tools.merge(derived.copurchase(spark, d, 1), tools.undirected(derived.trade(spark, d))).edges


@query(f"WITH {BASKET}, ids AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS new FROM nodes) SELECT a.new AS src, b.new AS dst, w FROM edges JOIN ids a ON src = a.id JOIN ids b ON dst = b.id")
def compact_graph(spark, d):
    return tools.compact(derived.basket(spark, d)).edges


@query(f"WITH {WHOLE} SELECT u, list(v ORDER BY w, v) AS neighbours FROM adj GROUP BY u")
def sorted_adjacency(spark, d):
    return tools.sorted_adjacency(derived.copurchase(spark, d, 1))


# --- centralities ---


@query(f"WITH {WHOLE} SELECT id AS node, d::DOUBLE AS score FROM deg")
def degree_centrality(spark, d):
    return centrality.degree(derived.copurchase(spark, d, 1))


def _pagerank_sql(rounds: int = 10, damp: float = 0.85) -> str:
    steps = [f"r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS s FROM nodes)"]
    for k in range(1, rounds + 1):
        steps.append(f"r{k} AS (SELECT n.id, {1 - damp!r} / (SELECT count(*) FROM nodes) + {damp} * coalesce(sum(r.s * e.w / t.t), 0) AS s FROM nodes n LEFT JOIN edges e ON e.dst = n.id LEFT JOIN tot t ON t.src = e.src LEFT JOIN r{k - 1} r ON r.id = e.src GROUP BY n.id)")
    return f"WITH {TRADE}, tot AS (SELECT src, sum(w) AS t FROM edges GROUP BY src), {', '.join(steps)} SELECT id AS node, round(s / (SELECT sum(s) FROM r{rounds}), 8) AS score FROM r{rounds}"


@query(_pagerank_sql())
def pagerank_trade(spark, d):
    return rounded(centrality.pagerank(derived.trade(spark, d), iterations=10), 8)


def _power_sql(kind: str, rounds: int) -> str:
    steps = ["r0 AS (SELECT id, 1.0::DOUBLE AS s FROM nodes)"]
    for k in range(1, rounds + 1):
        if kind == "eigenvector":
            steps.append(f"q{k} AS (SELECT n.id, coalesce(sum(a.w * r.s), 0) AS s FROM nodes n LEFT JOIN rev a ON a.u = n.id LEFT JOIN r{k - 1} r ON r.id = a.v GROUP BY n.id), r{k} AS (SELECT id, s / (SELECT sqrt(sum(s * s)) FROM q{k}) AS s FROM q{k})")
        else:
            steps.append(f"r{k} AS (SELECT n.id, 0.1 + 0.00001 * coalesce(sum(a.w * (1 + r.s)), 0) AS s FROM nodes n LEFT JOIN rev a ON a.u = n.id LEFT JOIN r{k - 1} r ON r.id = a.v GROUP BY n.id)")
    return f"WITH {TRADE}, {', '.join(steps)} SELECT id AS node, round(s / (SELECT sqrt(sum(s * s)) FROM r{rounds}), 8) AS score FROM r{rounds}"


@query(_power_sql("eigenvector", 6))
def eigenvector_centrality(spark, d):
    return rounded(centrality.eigenvector(derived.trade(spark, d), iterations=6), 8)


@query(_power_sql("katz", 6))
def katz_centrality(spark, d):
    return rounded(centrality.katz(derived.trade(spark, d), alpha=0.00001, iterations=6), 8)


@query(f"""WITH {WHOLE}, f AS (SELECT id, floor(wd) AS d FROM deg)
SELECT f.id AS node, f.d * f.d + coalesce(sum(adj.w * (adj.w + 2 * g.d)), 0) AS score FROM f LEFT JOIN adj ON adj.u = f.id LEFT JOIN f g ON g.id = adj.v GROUP BY f.id, f.d""")
def laplacian_centrality(spark, d):
    return centrality.laplacian(derived.copurchase(spark, d, 1))


@query(f"WITH {WHOLE} SELECT a.id AS node, round(avg((a.d < b.d)::INT::DOUBLE), 9) AS score FROM deg a LEFT JOIN adj ON u = a.id LEFT JOIN deg b ON v = b.id GROUP BY a.id")
def sfigality(spark, d):
    return rounded(centrality.sfigality(derived.copurchase(spark, d, 1)), 9)


TRIANGLES = "tri AS (SELECT a.src AS x, a.dst AS y, b.dst AS z FROM edges a JOIN edges b ON a.dst = b.src JOIN edges c ON c.src = a.src AND c.dst = b.dst), corner AS (SELECT x AS id FROM tri UNION ALL SELECT y FROM tri UNION ALL SELECT z FROM tri), tn AS (SELECT id, count(*) AS t FROM corner GROUP BY id)"


@query(f"WITH {WHOLE}, {TRIANGLES} SELECT deg.id AS node, round(CASE WHEN d < 2 THEN 0 ELSE 2.0 * coalesce(t, 0) / (d * (d - 1)) END, 9) AS score FROM deg LEFT JOIN tn USING (id)")
def local_clustering(spark, d):
    return rounded(centrality.local_clustering(derived.copurchase(spark, d, 1)), 9)


@query(f"WITH {WHOLE}, {TRIANGLES} SELECT round((SELECT 2.0 * sum(t) FROM tn) / (SELECT sum(d * (d - 1)) FROM deg), 9) AS score")
def transitivity(spark, d):
    return rounded(triangles.transitivity(derived.copurchase(spark, d, 1)), 9)


@query(f"""WITH {WHOLE} SELECT id AS node, round(coalesce(sum(CASE WHEN p.block = q.block THEN w END), 0) / greatest(coalesce(sum(w), 0), 1e-300), 9) AS score
FROM nodes LEFT JOIN adj ON u = id LEFT JOIN size_of p ON p.node = id LEFT JOIN size_of q ON q.node = v GROUP BY id""")
def partition_coverage(spark, d):
    return rounded(centrality.partition_coverage(derived.copurchase(spark, d, 1), derived.sizes(spark, d)), 9)


# --- triangles and edge scores ---

EDGE_TRIANGLES = f"{TRIANGLES}, side AS (SELECT x AS src, y AS dst FROM tri UNION ALL SELECT x, z FROM tri UNION ALL SELECT y, z FROM tri), te AS (SELECT e.src, e.dst, e.w, count(s.src) AS t FROM edges e LEFT JOIN side s ON s.src = e.src AND s.dst = e.dst GROUP BY 1, 2, 3), td AS (SELECT te.*, a.d AS ds, b.d AS dd FROM te JOIN deg a ON a.id = src JOIN deg b ON b.id = dst)"


@query(f"WITH {WHOLE}, {EDGE_TRIANGLES} SELECT src, dst, w, t AS score FROM te")
def edge_triangles(spark, d):
    return triangles.edge_triangles(derived.copurchase(spark, d, 1))


@query(f"""WITH {PART}, k AS (SELECT a.u AS x, b.v AS y, count(*) AS k FROM adj a JOIN adj b ON a.v = b.u WHERE a.u <> b.v GROUP BY 1, 2),
q AS (SELECT a.u AS src, a.v AS dst, sum(k.k - 1) AS s FROM adj a JOIN adj b ON a.v = b.u JOIN k ON k.x = a.u AND k.y = b.v WHERE a.u <> b.v AND a.u > a.v GROUP BY 1, 2)
SELECT e.src, e.dst, e.w, coalesce(q.s, 0)::BIGINT AS score FROM edges e LEFT JOIN q USING (src, dst)""")
def edge_quadrangles(spark, d):
    return triangles.edge_quadrangles(derived.copurchase(spark, d))


@query(f"WITH {WHOLE}, {EDGE_TRIANGLES} SELECT src, dst, w, round(1 - t / (ds + dd - t), 9) AS score FROM td")
def jaccard_distance(spark, d):
    return rounded(scores.jaccard_distance(derived.copurchase(spark, d, 1)), 9)


@query(f"WITH {WHOLE}, {EDGE_TRIANGLES} SELECT src, dst, w, round((t + 1) / sqrt((ds + 1) * (dd + 1)), 9) AS score FROM td")
def scan_similarity(spark, d):
    return rounded(scores.scan_similarity(derived.copurchase(spark, d, 1)), 9)


@query(f"WITH {WHOLE}, {EDGE_TRIANGLES} SELECT src, dst, w, round(CASE WHEN t > 0 THEN t * ((SELECT count(*) FROM nodes) - 2) / ((ds - 1) * (dd - 1))::DOUBLE WHEN ds = 1 OR dd = 1 THEN 1 ELSE 0 END, 9) AS score FROM td")
def chance_corrected_triangles(spark, d):
    return rounded(scores.chance_corrected_triangles(derived.copurchase(spark, d, 1)), 9)


@query(f"""WITH {WHOLE}, s AS (SELECT u, sum(1.0 / ln(d)) AS x, 0 AS y FROM adj JOIN deg ON id = v GROUP BY u),
c AS (SELECT e.src, e.dst, sum(1 / ln(deg.d)) AS s FROM edges e JOIN adj a ON a.u = e.src JOIN adj b ON b.u = e.dst AND b.v = a.v JOIN deg ON deg.id = a.v GROUP BY 1, 2)
SELECT e.src, e.dst, e.w, round(coalesce(1 / c.s, 'inf'::DOUBLE), 9) AS score FROM edges e LEFT JOIN c USING (src, dst)""")
def adamic_adar_distance(spark, d):
    return rounded(scores.adamic_adar_distance(derived.copurchase(spark, d, 1)), 9)


@query(f"WITH {WHOLE} SELECT src, dst, w, round(w / sqrt(a.wd * b.wd), 9) AS score FROM edges JOIN deg a ON a.id = src JOIN deg b ON b.id = dst")
def geometric_mean_score(spark, d):
    g = derived.copurchase(spark, d, 1)
    return rounded(scores.geometric_mean(g.edges.withColumn("score", F.col("w"))), 9)


@query(f"WITH {WHOLE} SELECT src, dst, w, round(greatest(1 - pow(1 - w / a.wd, a.d - 1), 1 - pow(1 - w / b.wd, b.d - 1)), 9) AS score FROM edges JOIN deg a ON a.id = src JOIN deg b ON b.id = dst")
def multiscale_score(spark, d):
    g = derived.copurchase(spark, d, 1)
    return rounded(scores.multiscale(g.edges.withColumn("score", F.col("w"))), 9)


@query(f"""WITH {WHOLE}, r AS (SELECT a.u, a.v, rank() OVER (PARTITION BY a.u ORDER BY y.d DESC) AS r, x.d FROM adj a JOIN deg x ON x.id = a.u JOIN deg y ON y.id = a.v),
s AS (SELECT u, v, CASE WHEN d > 1 THEN 1 - ln(r) / ln(d) ELSE 1 END AS s FROM r)
SELECT e.src, e.dst, e.w, round(greatest(p.s, q.s), 9) AS score FROM edges e JOIN s p ON p.u = e.src AND p.v = e.dst JOIN s q ON q.u = e.dst AND q.v = e.src""")
def local_degree_score(spark, d):
    return rounded(scores.local_degree(derived.copurchase(spark, d, 1)), 9)


@query(f"""WITH {WHOLE}, {EDGE_TRIANGLES}, b AS (SELECT src AS u, dst AS v, t FROM te UNION ALL SELECT dst, src, t FROM te), r AS (SELECT u, v, rank() OVER (PARTITION BY u ORDER BY t DESC) AS r FROM b),
c AS (SELECT e.src, e.dst, count(*) AS c FROM edges e JOIN r x ON x.u = e.src JOIN r y ON y.u = e.dst AND y.v = x.v WHERE x.r <= 5 AND y.r <= 5 GROUP BY 1, 2)
SELECT e.src, e.dst, e.w, coalesce(c.c, 0)::DOUBLE AS score FROM edges e LEFT JOIN c USING (src, dst)""")
def simmelian_overlap(spark, d):
    return scores.simmelian_overlap(derived.copurchase(spark, d, 1), 5)


@query(f"WITH {WHOLE}, {EDGE_TRIANGLES}, x AS (SELECT min(t) AS lo, max(t) AS hi FROM te) SELECT src, dst, w, round(CASE WHEN hi > lo THEN (t - lo) / (hi - lo) ELSE 0 END, 9) AS score FROM te, x")
def normalized_triangles(spark, d):
    return rounded(scores.normalize(triangles.edge_triangles(derived.copurchase(spark, d, 1))), 9)


@query(f"WITH {WHOLE}, {EDGE_TRIANGLES} SELECT src, dst, w FROM te WHERE t >= 2")
def sparsify_by_triangles(spark, d):
    g = derived.copurchase(spark, d, 1)
    return scores.keep(g, triangles.edge_triangles(g), 2).edges


# --- link prediction ---

WEDGE = "pair AS (SELECT a.u, b.u AS v, count(*) AS c, sum(1 / ln(x.d)) AS aa, sum(1.0 / x.d) AS ra FROM adj a JOIN adj b ON a.v = b.v AND a.u < b.u JOIN deg x ON x.id = a.v GROUP BY 1, 2), cand AS (SELECT p.*, y.d AS du, z.d AS dv FROM pair p JOIN deg y ON y.id = p.u JOIN deg z ON z.id = p.v WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = p.v AND e.dst = p.u))"


@query(f"WITH {PART}, {WEDGE} SELECT u, v FROM cand")
def missing_links(spark, d):
    return linkprediction.missing_links(derived.copurchase(spark, d), 2)


@query(f"""WITH {PART}, {WEDGE} SELECT u, v, c::DOUBLE AS common_neighbors, round(c / (du + dv - c), 9) AS jaccard, round(aa, 6) AS adamic_adar, round(ra, 6) AS resource_allocation,
  (du * dv)::DOUBLE AS preferential_attachment, (du + dv - c)::DOUBLE AS total_neighbors, round(c / sqrt(du * dv), 9) AS neighborhood_distance, du::DOUBLE AS u_degree, dv::DOUBLE AS v_degree FROM cand""")
def neighbourhood_indices(spark, d):
    g = derived.copurchase(spark, d).kept()
    found = linkprediction.indices(g, linkprediction.candidates(g)).drop("adjusted_rand")
    digits = {"adamic_adar": 6, "resource_allocation": 6}
    return found.select(*[F.round(c, digits.get(c, 9)).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes])


@query(f"""WITH {PART}, {WEDGE}, near AS (SELECT u, v FROM adj UNION ALL SELECT DISTINCT u, u FROM adj)
SELECT c.u, c.v, count(*)::DOUBLE AS score FROM cand c JOIN adj a ON a.u = c.u JOIN near n ON n.u = a.v JOIN adj b ON b.u = c.v AND b.v = n.v GROUP BY 1, 2""")
def neighbors_measure(spark, d):
    g = derived.copurchase(spark, d).kept()
    return linkprediction.neighbors_measure(g, linkprediction.candidates(g))


# --- partitions ---

BLOCKS = "e2 AS (SELECT e.*, p.block AS a, q.block AS b FROM edges e JOIN size_of p ON p.node = src JOIN size_of q ON q.node = dst), vol AS (SELECT block, sum(wd) AS vol, count(*) AS size FROM size_of JOIN deg ON id = node GROUP BY block), cutw AS (SELECT block, sum(w) AS cut FROM (SELECT a AS block, w FROM e2 WHERE a <> b UNION ALL SELECT b, w FROM e2 WHERE a <> b) GROUP BY block), inn AS (SELECT a AS block, count(*) AS m, sum(w) AS s FROM e2 WHERE a = b GROUP BY a)"


@query(f"WITH {WHOLE}, {BLOCKS} SELECT round((SELECT sum(w) FROM e2 WHERE a = b) / (SELECT sum(w) FROM e2), 9) AS coverage")
def coverage(spark, d):
    return rounded(community.coverage(derived.copurchase(spark, d, 1), derived.sizes(spark, d)), 9)


@query(f"WITH {WHOLE}, {BLOCKS} SELECT round(coalesce((SELECT sum(w) FROM e2 WHERE a = b), 0) / (SELECT sum(w) FROM e2) - (SELECT sum(vol * vol) FROM vol) / (4 * pow((SELECT sum(w) FROM e2), 2)), 9) AS modularity")
def modularity(spark, d):
    return rounded(community.modularity(derived.copurchase(spark, d, 1), derived.sizes(spark, d)), 9)


@query(f"WITH {WHOLE}, {BLOCKS} SELECT sum(w) AS cut FROM e2 WHERE a <> b")
def edge_cut(spark, d):
    return community.edge_cut(derived.copurchase(spark, d, 1), derived.sizes(spark, d))


@query(f"WITH {WHOLE}, {BLOCKS} SELECT block, round(CASE WHEN least(vol, (SELECT sum(vol) FROM vol) - vol) = 0 THEN 0 ELSE coalesce(cut, 0) / least(vol, (SELECT sum(vol) FROM vol) - vol) END, 9) AS score FROM vol LEFT JOIN cutw USING (block)")
def block_conductance(spark, d):
    return rounded(community.conductance(derived.copurchase(spark, d, 1), derived.sizes(spark, d)), 9)


@query(f"WITH {WHOLE}, {BLOCKS} SELECT block, round(CASE WHEN least(size, (SELECT sum(size) FROM vol) - size) = 0 THEN 0 ELSE coalesce(cut, 0) / least(size, (SELECT sum(size) FROM vol) - size) END, 9) AS score FROM vol LEFT JOIN cutw USING (block)")
def block_expansion(spark, d):
    return rounded(community.expansion(derived.copurchase(spark, d, 1), derived.sizes(spark, d)), 9)


@query(f"WITH {WHOLE}, {BLOCKS} SELECT block, round(CASE WHEN size < 2 THEN 1 ELSE coalesce(m, 0) / (size * (size - 1) / 2.0) END, 12) AS score FROM vol LEFT JOIN inn USING (block)")
def block_density(spark, d):
    return rounded(community.density(derived.copurchase(spark, d, 1), derived.sizes(spark, d)), 12)


@query(f"""WITH {WHOLE}, {BLOCKS}, h AS (SELECT p.block, max(c) AS c FROM (SELECT u, count(*) AS c FROM adj JOIN size_of x ON x.node = u JOIN size_of y ON y.node = v WHERE x.block = y.block GROUP BY u) JOIN size_of p ON p.node = u GROUP BY p.block)
SELECT block, round(CASE WHEN size < 2 THEN 1 ELSE coalesce(c, 0) / (size - 1) END, 9) AS score FROM vol LEFT JOIN h USING (block)""")
def hub_dominance(spark, d):
    return rounded(community.hub_dominance(derived.copurchase(spark, d, 1), derived.sizes(spark, d)), 9)


@query(f"""WITH {WHOLE}, s AS (SELECT u, y.block, sum(floor(w)) AS s FROM adj JOIN size_of y ON y.node = v GROUP BY 1, 2),
t AS (SELECT node, count(s.u) AS k, coalesce(max(CASE WHEN s.block = p.block THEN s END), 0) AS own, coalesce(max(CASE WHEN s.block <> p.block THEN s END), 0) AS other FROM size_of p LEFT JOIN s ON s.u = node GROUP BY node)
SELECT node, CASE WHEN k = 0 OR own > other THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM t""")
def stable_nodes(spark, d):
    return community.stable_nodes(derived.copurchase(spark, d, 1), derived.sizes(spark, d))


@query(f"""WITH {WHOLE}, c AS (SELECT a.block AS x, b.block AS y, count(*) AS c FROM size_of a JOIN brand_of b USING (node) GROUP BY 1, 2), r AS (SELECT x, sum(c) AS r FROM c GROUP BY x), k AS (SELECT y, sum(c) AS k FROM c GROUP BY y), n AS (SELECT sum(c)::DOUBLE AS n FROM c),
t AS (SELECT (SELECT sum(c * (c - 1) / 2.0) FROM c) AS s, (SELECT sum(r * (r - 1) / 2.0) FROM r) AS pa, (SELECT sum(k * (k - 1) / 2.0) FROM k) AS pb, n * (n - 1) / 2 AS al,
 (SELECT sum(c / n * log2(c * n / (r * k))) FROM c JOIN r USING (x) JOIN k USING (y)) AS mi, (SELECT -sum(r / n * log2(r / n)) FROM r) + (SELECT -sum(k / n * log2(k / n)) FROM k) AS h FROM n)
SELECT round(1 - (al + 2 * s - pa - pb) / al, 9) AS rand, round(1 - s / (pa + pb - s), 9) AS jaccard, round(1 - (s - pa * pb / al) / ((pa + pb) / 2 - pa * pb / al), 9) AS adjusted_rand, round(1 - 2 * mi / h, 9) AS nmi FROM t""")
def partition_comparison(spark, d):
    return rounded(community.comparison(derived.sizes(spark, d), derived.brands(spark, d)), 9)


@query(f"""WITH {WHOLE}, x AS (SELECT (a.block = b.block) AS p, (c.block = f.block) AS q FROM edges JOIN size_of a ON a.node = src JOIN size_of b ON b.node = dst JOIN brand_of c ON c.node = src JOIN brand_of f ON f.node = dst)
SELECT round(avg((p <> q)::INT), 9) AS rand FROM x""")
def graph_structural_rand(spark, d):
    return rounded(community.graph_rand(derived.copurchase(spark, d, 1), derived.sizes(spark, d), derived.brands(spark, d)), 9)


@query(f"WITH {WHOLE}, j AS (SELECT node, a.block AS x, b.block AS y FROM size_of a JOIN brand_of b USING (node)) SELECT node, min(node) OVER (PARTITION BY x, y) AS block FROM j")
def partition_intersection(spark, d):
    return community.intersection(derived.sizes(spark, d), derived.brands(spark, d))


@query(f"""WITH {WHOLE}, c AS (SELECT a.block AS x, b.block AS y, count(*) AS c FROM size_of a JOIN brand_of b USING (node) GROUP BY 1, 2), r AS (SELECT block AS x, count(*) AS r FROM size_of GROUP BY 1), k AS (SELECT block AS y, count(*) AS k FROM brand_of GROUP BY 1)
SELECT x AS block, round(max(2.0 * c / (r + k)), 9) AS score FROM c JOIN r USING (x) JOIN k USING (y) GROUP BY x""")
def cover_f1(spark, d):
    return rounded(community.cover_f1(derived.sizes(spark, d), derived.brands(spark, d)), 9)


@query(f"WITH {WHOLE}, {BLOCKS} SELECT greatest(a, b) AS src, least(a, b) AS dst, sum(w) AS w FROM e2 GROUP BY 1, 2")
def coarsen_by_blocks(spark, d):
    return community.coarsen(derived.copurchase(spark, d, 1), derived.sizes(spark, d)).edges


@query(f"WITH {WHOLE} SELECT round(corr(a.block, b.block), 9) AS assortativity FROM edges JOIN size_of a ON a.node = src JOIN size_of b ON b.node = dst")
def assortativity(spark, d):
    return rounded(community.assortativity(derived.copurchase(spark, d, 1), derived.sizes(spark, d).withColumnRenamed("block", "value")), 9)


@query(f"""WITH {WHOLE}, e3 AS (SELECT p.block AS a, q.block AS b FROM edges JOIN brand_of p ON p.node = src JOIN brand_of q ON q.node = dst), m AS (SELECT count(*)::DOUBLE AS m FROM e3),
x AS (SELECT a AS k, count(*) AS x FROM e3 GROUP BY a), y AS (SELECT b AS k, count(*) AS y FROM e3 GROUP BY b)
SELECT round(((SELECT count(*) FROM e3 WHERE a = b) / m - (SELECT sum(x * y) FROM x JOIN y USING (k)) / (m * m)) / (1 - (SELECT sum(x * y) FROM x JOIN y USING (k)) / (m * m)), 9) AS assortativity FROM m""")
def nominal_assortativity(spark, d):
    return rounded(community.nominal_assortativity(derived.copurchase(spark, d, 1), derived.brands(spark, d)), 9)


# --- components, distances ---

def _least_sql(rounds: int = 10) -> str:
    """Each node takes the least label around it, again and again: components of up to that radius."""
    steps = ["l0 AS MATERIALIZED (SELECT id, id AS c FROM nodes)"]
    for k in range(rounds):
        steps.append(f"l{k + 1} AS MATERIALIZED (SELECT l.id, least(l.c, coalesce(min(m.c), l.c)) AS c FROM l{k} l LEFT JOIN adj ON adj.u = l.id LEFT JOIN l{k} m ON m.id = adj.v GROUP BY l.id, l.c)")
    return f"WITH {BASKET}, {', '.join(steps)}, reached AS (SELECT id AS node, c AS component FROM l{rounds})"


def _layers_sql(rounds: int = 10) -> str:
    steps = ["r0 AS MATERIALIZED (SELECT max(id) AS id, 0 AS d FROM nodes)"]
    for k in range(rounds):
        steps.append(f"r{k + 1} AS MATERIALIZED (SELECT id, min(d) AS d FROM (SELECT id, d FROM r{k} UNION ALL SELECT v, d + 1 FROM r{k} JOIN adj ON u = id) GROUP BY id)")
    return f"WITH {BASKET}, {', '.join(steps)} SELECT id AS node, d::DOUBLE AS dist FROM r{rounds}"


@query(f"{_least_sql()} SELECT node, component FROM reached")
def connected_components(spark, d):
    return components.connected(derived.basket(spark, d))


@query(f"{_least_sql()} SELECT component, count(*) AS size FROM reached GROUP BY component")
def component_sizes(spark, d):
    return components.sizes(components.connected(derived.basket(spark, d)))


@query(_layers_sql())
def bfs_distances(spark, d):
    g = derived.basket(spark, d)
    return distances.bfs(g, g.nodes.agg(F.max("id").alias("id"))).select("node", "dist")


@query(f"""WITH RECURSIVE {TRADE}, p AS (SELECT id AS s, id AS v, 0.0::DOUBLE AS x, 0 AS k FROM nodes WHERE id = 0 UNION SELECT s, dst, min(x + w), min(k) + 1 FROM p JOIN edges ON src = v WHERE k < 8 GROUP BY s, dst)
SELECT v AS node, min(x) AS dist FROM p GROUP BY v""")
def dijkstra_distances(spark, d):
    g = derived.trade(spark, d).kept()
    return distances.dijkstra(g, g.nodes.filter("id = 0")).select("node", "dist")
