"""Synthetic graphs as plans over ``spark.range``.

Every random draw is a hash of the seed and of what it is drawn for, so a graph is the same at each
run and after the loss of an executor. Pairs with a given probability are not filtered out of all
pairs: ``bernoulli`` skips from hit to hit within chunks of the pair space, so its work follows the
number of edges. Attachment models resolve each edge from hashes of earlier edges, all edges at once.
Undirected edges are canonical (``src >= dst``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.graph import Graph, canonical, graph, numbered
from weftgraph.lineage import cut

CHUNK = 100_000  # expected edges of a chunk


def uniform(seed: int, *what: Column | str) -> Column:
    """A number in [0, 1) with 52 bits: the beginning of the MD5 of seed and values."""
    text = F.concat_ws(":", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in what])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def splitmix(x: np.ndarray) -> np.ndarray:
    """64 mixed bits of each number."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# --- lattices ---


def ring_lattice(spark: SparkSession, n: int, k: int) -> Graph:
    """Each node is linked with the ``k`` next ones around a ring."""
    rows = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("j")) if k > 0 else spark.range(0).select(F.col("id").alias("src"), F.lit(0).alias("j"))
    return graph(rows.select("src", ((F.col("src") + F.col("j")) % n).alias("dst")).filter("src <> dst"), spark.range(n), duplicates="one")


def watts_strogatz(spark: SparkSession, n: int, k: int, p: float, seed: int = 1, draws: int = 8) -> Graph:
    """The ring lattice, with the far end of each edge moved to a uniform node with probability
    ``p``: the first of ``draws`` draws that is no neighbour on the ring. Two edges that meet stay
    one."""
    ring = ring_lattice(spark, n, k).edges.select("src", "dst")
    near = lambda t: F.least(F.pmod(t - F.col("src"), F.lit(n)), F.pmod(F.col("src") - t, F.lit(n))) <= k
    tries = [F.floor(uniform(seed, F.lit(f"to{j}"), "src", "dst") * n).cast("long") for j in range(draws)]
    moved = F.coalesce(*[F.when(~near(t), t) for t in tries], F.col("dst"))
    rows = ring.select("src", F.when(uniform(seed, F.lit("move"), "src", "dst") < p, moved).otherwise(F.col("dst")).alias("dst"))
    return graph(rows, spark.range(n), duplicates="one")


# --- pairs with probabilities ---


def bernoulli(spark: SparkSession, blocks: DataFrame, seed: int, directed: bool = False, loops: bool = False) -> DataFrame:
    """``(a, b, x, y)``: for rows ``(a, b, na, nb, p)``, members x of a (of ``na``) and y of b (of
    ``nb``), each pair with probability p. Where a = b the pairs of different members count once
    (x > y), or, directed, both ways, with ``loops`` also x = y."""
    same = F.col("a") == F.col("b")
    inner = F.col("na") * (F.col("na") - (0 if loops else 1)) if directed else (F.col("na") * (F.col("na") - 1) / 2)
    space = F.when(same, inner).otherwise(F.col("na") * F.col("nb")).cast("long")
    rows = blocks.withColumn("space", space).withColumn("p", F.least("p", F.lit(1.0))).filter("space > 0 AND p > 0")
    size = F.greatest(F.lit(1), F.floor(CHUNK / F.col("p"))).cast("long")
    chunked = rows.withColumn("size", size).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("space") - 1) / F.col("size")))))
    # Chunks are dealt by their number, so one large block fills the cluster.
    placed = chunked.select("a", "b", "na", "nb", "p", (F.col("chunk") * F.col("size")).alias("lo"), F.least(F.col("space"), (F.col("chunk") + 1) * F.col("size")).alias("hi"), "chunk").repartition("a", "b", "chunk")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, na, nb, p, lo, hi, chunk in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                r = np.random.default_rng([seed, a % (1 << 63), b % (1 << 63), chunk])
                at, hits = lo - 1, []
                while at < hi:
                    jumps = np.cumsum(r.geometric(p, max(16, int((hi - at) * p * 1.1)))) if p < 1 else np.arange(1, hi - at)
                    found = at + jumps
                    hits.append(found[found < hi])
                    if not len(found) or found[-1] >= hi:
                        break
                    at = int(found[-1])
                t = np.concatenate(hits) if hits else np.zeros(0, np.int64)
                if a != b:
                    x, y = t // nb, t % nb
                elif directed:
                    width = na if loops else na - 1
                    x, y = t // width, t % width
                    y = y + (~np.bool_(loops) & (y >= x))
                else:  # t = x (x - 1) / 2 + y
                    x = ((1 + np.sqrt(8.0 * t + 1)) / 2).astype(np.int64)
                    x -= x * (x - 1) // 2 > t
                    x += x * (x + 1) // 2 <= t
                    y = t - x * (x - 1) // 2
                yield pa.RecordBatch.from_pydict({"a": np.full(len(t), a), "b": np.full(len(t), b), "x": x, "y": y})

    return placed.mapInArrow(kernel, "a long, b long, x long, y long")


def erdos_renyi(spark: SparkSession, n: int, p: float, directed: bool = False, loops: bool = False, seed: int = 1) -> Graph:
    """Each pair with probability ``p``; self-loops only if directed."""
    block = spark.createDataFrame([(0, 0, n, n, float(p))], "a long, b long, na long, nb long, p double")
    rows = bernoulli(spark, block, seed, directed, directed and loops)
    return graph(rows, spark.range(n), directed, src="x", dst="y")


def block_model(spark: SparkSession, membership: DataFrame, affinity: DataFrame, seed: int = 1) -> Graph:
    """``membership``: (node, block); ``affinity``: (a, b, p), a >= b: the probability of an edge
    between nodes of those blocks."""
    place = cut(membership.select("node", "block", (F.row_number().over(Window.partitionBy("block").orderBy("node")) - 1).cast("long").alias("i")))
    return _between(spark, place, affinity, seed, membership.select(F.col("node").alias("id")))


def _between(spark: SparkSession, place: DataFrame, affinity: DataFrame, seed: int, nodes: DataFrame) -> Graph:
    size = place.groupBy("block").agg(F.count("*").alias("n"))
    a, b = size.select(F.col("block").alias("a"), F.col("n").alias("na")), size.select(F.col("block").alias("b"), F.col("n").alias("nb"))
    hit = bernoulli(spark, affinity.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "p"), seed)
    left = place.select(F.col("block").alias("a"), F.col("i").alias("x"), F.col("node").alias("src"))
    right = place.select(F.col("block").alias("b"), F.col("i").alias("y"), F.col("node").alias("dst"))
    return graph(hit.join(left, ["a", "x"]).join(right, ["b", "y"]), nodes)


def clustered(spark: SparkSession, n: int, k: int, inside: float, between: float, seed: int = 1) -> tuple[Graph, DataFrame]:
    """``n`` nodes in ``k`` random blocks, and the blocks ``(node, block)``."""
    blocks = spark.range(n).select(F.col("id").alias("node"), F.floor(uniform(seed, F.lit("block"), "id") * k).cast("long").alias("block"))
    pairs = spark.range(k).select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), "id")).alias("b"))
    return block_model(spark, blocks, pairs.withColumn("p", F.when(F.col("a") == F.col("b"), inside).otherwise(between)), seed), blocks


def chung_lu(spark: SparkSession, degrees: DataFrame, seed: int = 1) -> Graph:
    """``degrees``: (node, degree). An edge between u and v has probability min(1, du dv / sum).
    Nodes of one degree are a block, so there are few blocks whatever the nodes."""
    rows = degrees.filter("degree > 0")
    # A rank within the degree, without bringing a common degree to one task.
    ranked = numbered(rows, ["degree", "node"], "at")
    first = ranked.groupBy("degree").agg(F.min("at").alias("first"))
    place = cut(ranked.join(F.broadcast(first), "degree").select("node", F.col("degree").cast("long").alias("block"), (F.col("at") - F.col("first")).cast("long").alias("i")))
    total = rows.agg(F.sum("degree")).first()[0] or 1
    of = first.select(F.col("degree").cast("long").alias("a"))
    pairs = of.join(of.withColumnRenamed("a", "b"), F.col("a") >= F.col("b"))  # different degrees only: at most sqrt(2 m)
    return _between(spark, place, pairs.withColumn("p", F.col("a") * F.col("b") / F.lit(float(total))), seed, degrees.select(F.col("node").alias("id")))


# --- attachment ---


def _resolved(spark: SparkSession, m: int, kernel) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst = kernel(batch.column(0).to_numpy())
            yield pa.RecordBatch.from_pydict({"e": batch.column(0), "src": src, "dst": dst})

    return spark.range(m).mapInArrow(run, "e long, src long, dst long")


def attached(spark: SparkSession, n: int, k: int, seed: int = 1) -> DataFrame:
    """``(e, src, dst)``: node v brings the edges v k .. v k + k - 1; their far ends are copied from
    uniform earlier places of the list of ends, so a node is met as often as it has ends."""

    def kernel(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = 2 * e + 1  # odd places are far ends
        open_ = np.ones(len(at), bool)
        while open_.any():
            h = splitmix(at[open_].astype(np.uint64) ^ splitmix(np.full(1, seed, np.uint64))[0])
            at[open_] = (h % np.maximum(at[open_], 1).astype(np.uint64)).astype(np.int64)
            open_ = at % 2 == 1
        return e // k, at // (2 * k)

    return _resolved(spark, n * k, kernel)


def barabasi_albert(spark: SparkSession, n: int, k: int, seed: int = 1) -> Graph:
    """Preferential attachment; self-loops and repeated edges of the list are dropped."""
    return graph(attached(spark, n, k, seed).filter("src <> dst"), spark.range(n), duplicates="one")


def grown(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """``(e, src, dst)``: a triangle; each further node v brings two edges, e = 2 v - 3 and the next,
    to the ends of a uniform earlier edge."""

    def kernel(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = np.array([[1, 0], [2, 0], [2, 1]])
        node = np.where(e < 3, base[np.minimum(e, 2), 0], (e + 3) // 2)
        far = np.zeros(len(e), np.int64)
        cur, side = e.copy(), np.ones(len(e), np.int64)  # looking for end ``side`` of edge ``cur``
        todo = np.arange(len(e))
        while len(todo):
            c, s = cur[todo], side[todo]
            v = (c + 3) // 2
            done = (c < 3) | (s == 0)
            far[todo[done]] = np.where(c < 3, base[np.minimum(c, 2), s], v)[done]
            todo, v, c = todo[~done], v[~done], c[~done]
            pick = (splitmix(v.astype(np.uint64) ^ splitmix(np.full(1, seed, np.uint64))[0]) % (2 * v - 3).astype(np.uint64)).astype(np.int64)
            cur[todo], side[todo] = pick, (c + 1) % 2  # the first edge of v takes end 0, the other end 1
        return node, far

    return _resolved(spark, 2 * n - 3, kernel)


def dorogovtsev_mendes(spark: SparkSession, n: int, seed: int = 1) -> Graph:
    if n < 3:
        raise ValueError("three nodes at least")
    return graph(grown(spark, n, seed), spark.range(n))


# --- recursive matrix ---


def rmat(spark: SparkSession, scale: int, factor: int, a: float, b: float, c: float, d: float, weighted: bool = False, reduce: int = 0, seed: int = 1) -> Graph:
    """``factor * 2**scale`` draws of a cell by ``scale`` choices of a quadrant; loops stay. Repeated
    cells become weights, or one edge. ``reduce``: so many nodes, by hash, are left out."""
    if abs(a + b + c + d - 1) > 1e-9:
        raise ValueError("the probabilities of the quadrants sum to 1")
    src = dst = F.lit(0).cast("long")
    for level in range(scale):
        u = uniform(seed, F.lit(level), "id")
        src = src * 2 + (u >= a + b).cast("long")
        dst = dst * 2 + ((u >= a) & (u < a + b) | (u >= a + b + c)).cast("long")
    rows = spark.range(factor << scale).select(src.alias("src"), dst.alias("dst"))
    nodes = spark.range(1 << scale)
    if reduce:
        gone = nodes.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), "id").limit(reduce)
        nodes = nodes.join(gone, "id", "left_anti")
        rows = rows.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    return graph(rows, nodes, weighted=weighted, duplicates="sum" if weighted else "one")


# --- degree sequences ---


def powerlaw_degrees(spark: SparkSession, n: int, least: int, most: int, gamma: float = -2.0, seed: int = 1) -> DataFrame:
    """``(node, degree)``: degrees in [least, most] with probability proportional to degree**gamma;
    the sum is made even."""
    values = np.arange(least, most + 1)
    upto = np.cumsum(values.astype(float) ** gamma)
    table = spark.createDataFrame([(int(v), float(x), float(y)) for v, x, y in zip(values, np.concatenate(([0.0], upto[:-1] / upto[-1])), upto / upto[-1], strict=True)], "degree long, lo double, hi double")
    rows = spark.range(n).select(F.col("id").alias("node"), uniform(seed, F.lit("degree"), "id").alias("u"))
    found = cut(rows.join(F.broadcast(table), (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("node", "degree"))  # ``most`` rows at most
    odd = (found.agg(F.sum("degree")).first()[0] or 0) % 2
    return found.withColumn("degree", F.when(F.col("node") == 0, F.col("degree") + odd).otherwise(F.col("degree")))


def realizable(degrees: DataFrame) -> bool:
    """Erdos-Gallai on the histogram: different degrees are at most sqrt(2 m), so they fit here."""
    rows = sorted(((r["degree"], r["n"]) for r in degrees.groupBy("degree").agg(F.count("*").alias("n")).collect()), reverse=True)
    if sum(d * n for d, n in rows) % 2 or any(d < 0 for d, _ in rows):
        return False
    k = left = 0
    for i, (d, n) in enumerate(rows):
        k, left = k + n, left + d * n
        # The condition need hold at the last place of each degree only.
        if left > k * (k - 1) + sum(min(x, k) * m for x, m in rows[i + 1 :]):
            return False
    return True


def havel_hakimi(spark: SparkSession, degrees: DataFrame, most: int = 5_000_000, ignore: bool = False) -> Graph:
    """The deterministic realisation: the node of the greatest remaining degree is linked to those
    next in rank. It is sequential, so one task makes it, for at most ``most`` nodes."""
    n = degrees.count()
    if n > most:
        raise ValueError(f"{n} nodes are more than one task takes ({most}); use chung_lu or edge_switching")
    if not ignore and not realizable(degrees):
        raise ValueError("no graph has these degrees")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        buckets: dict[int, list[int]] = {}
        for node, d in sorted(rows, reverse=True):
            buckets.setdefault(d, []).append(node)
        top = max(buckets, default=0)
        src, dst = [], []
        while top > 0:
            if not buckets.get(top):
                top -= 1
                continue
            u, need, level, moved = buckets[top].pop(), top, top, []
            while need and level > 0:
                if bucket := buckets.get(level):
                    v = bucket.pop()
                    src.append(u)
                    dst.append(v)
                    moved.append((v, level - 1))
                    need -= 1
                else:
                    level -= 1
            for v, d in moved:
                buckets.setdefault(d, []).append(v)
        yield pa.RecordBatch.from_pydict({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    rows = degrees.select(F.col("node").cast("long"), F.col("degree").cast("int")).coalesce(1).mapInArrow(kernel, "src long, dst long")
    return graph(rows, degrees.select(F.col("node").alias("id")))


def stubs(degrees: DataFrame, seed: int, group: str | None = None) -> DataFrame:
    """``(src, dst)``: ends of edges, each node as many as its degree, paired along a random order
    (within ``group``). Loops and repeated edges are left to the caller."""
    keys = [group] if group else []
    ends = degrees.filter("degree > 0").select(*keys, "node", F.explode(F.sequence(F.lit(1), F.col("degree").cast("int"))).alias("j"))
    placed = numbered(ends.withColumn("r", F.xxhash64(F.lit(seed), "node", "j")), [*keys, "r", "node", "j"], "at")
    if group:
        first = placed.groupBy(group).agg(F.min("at").alias("first"))
        placed = placed.join(first, group).withColumn("at", F.col("at") - F.col("first"))
    pair = [*keys, F.floor(F.col("at") / 2).alias("pair")]
    return placed.groupBy(*pair).agg(F.max("node").alias("src"), F.min("node").alias("dst"), F.count("*").alias("n")).filter("n = 2").select("src", "dst")


def configuration(spark: SparkSession, degrees: DataFrame, seed: int = 1) -> Graph:
    """Random pairing of ends; loops are dropped and repeated edges merged."""
    return graph(stubs(degrees, seed).filter("src <> dst"), degrees.select(F.col("node").alias("id")), duplicates="one")


def lfr(spark: SparkSession, n: int, mean_least: int, most: int, gamma: float, smallest: int, largest: int, beta: float, mixing: float, seed: int = 1) -> tuple[Graph, DataFrame]:
    """Power-law degrees in [mean_least, most] and block sizes in [smallest, largest]; a node has the
    share ``1 - mixing`` of its edges in its block (as far as the block has nodes), paired at random within blocks
    and across them. The blocks come with it."""
    degrees = powerlaw_degrees(spark, n, mean_least, most, gamma, seed)
    sizes = powerlaw_degrees(spark, max(1, 2 * n // smallest), smallest, largest, beta, seed + 1)
    ends = cut(numbered(sizes, ["node"], "k").select("k", F.col("degree").alias("size")))
    upto = numbered_sum(ends, "size")
    # Nodes in a random order fill the blocks one after another.
    order = numbered(degrees.withColumn("r", F.xxhash64(F.lit(seed + 2), "node")), ["r", "node"], "at").drop("r")
    spans = upto.filter(F.col("begin") < n).select(F.col("k").alias("block"), F.explode(F.sequence("begin", F.least(F.col("begin") + F.col("size"), F.lit(n)) - 1)).alias("at"), "size")
    placed = cut(order.join(spans, "at").select("node", "degree", "block", F.least(F.round(F.col("degree") * (1 - mixing)), F.col("size") - 1).cast("long").alias("inner")))
    within = stubs(placed.select("node", "block", F.col("inner").alias("degree")), seed + 3, "block")
    across = stubs(placed.select("node", (F.col("degree") - F.col("inner")).alias("degree")), seed + 4)
    block = placed.select("node", "block")
    across = across.join(block.select(F.col("node").alias("src"), F.col("block").alias("a")), "src").join(block.select(F.col("node").alias("dst"), F.col("block").alias("b")), "dst").filter("a <> b").select("src", "dst")
    return graph(within.unionByName(across).filter("src <> dst"), spark.range(n), duplicates="one"), block


def numbered_sum(rows: DataFrame, size: str) -> DataFrame:
    """``rows`` with ``begin``: the sum of ``size`` over the rows with a lower ``k``. For tables of
    blocks, which are ranged like :func:`numbered`."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(rows.repartitionByRange(parts, "k").withColumn("_p", F.spark_partition_id()))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    shift = ranged.groupBy("_p").agg(F.sum(size).alias("s")).select("_p", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("_s"))
    along = Window.partitionBy("_p").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    return ranged.withColumn("_a", F.coalesce(F.sum(size).over(along), F.lit(0))).join(F.broadcast(shift), "_p").withColumn("begin", F.col("_a") + F.col("_s")).drop("_p", "_a", "_s")


# --- geometry ---


def hyperbolic_points(spark: SparkSession, n: int, k: float = 6, gamma: float = 3.0, seed: int = 1) -> tuple[DataFrame, float]:
    """``(id, angle, radius)`` and the disk's radius, for a mean degree of about ``k``."""
    alpha = (gamma - 1) / 2
    xi = alpha / (alpha - 0.5)
    disk = 2 * math.log(2 * n * xi * xi / (math.pi * k))
    r = F.acosh(1 + uniform(seed, F.lit("r"), "id") * (math.cosh(alpha * disk) - 1)) / alpha
    return spark.range(n).select("id", (uniform(seed, F.lit("t"), "id") * (2 * math.pi)).alias("angle"), r.alias("radius")), disk


def hyperbolic_distance(a: str = "", b: str = "2") -> Column:
    """cosh of the distance of two polar points, columns ``angle`` and ``radius`` with suffixes."""
    r, s = F.col("radius" + a), F.col("radius" + b)
    return F.cosh(r) * F.cosh(s) - F.sinh(r) * F.sinh(s) * F.cos(F.col("angle" + a) - F.col("angle" + b))


def hyperbolic_join(points: DataFrame, disk: float, step: float = 1.0) -> DataFrame:
    """``(src, dst)`` of points nearer than ``disk``. The disk is cut into rings, each ring into cells
    as wide as the greatest angle at which two of its points can be linked; a point looks into the
    cells of its own and the inner rings that its angle reaches (three at most), an equi-join."""
    lows = [0.0, *np.arange(disk / 2, disk, step).tolist()]

    def reach(r: float, s: float) -> float:
        return math.pi if r + s <= disk else math.acos(max(-1.0, min(1.0, (math.cosh(r) * math.cosh(s) - math.cosh(disk)) / (math.sinh(r) * math.sinh(s)))))

    cells = [max(1, int(2 * math.pi / (2 * reach(low, low)))) if low else 1 for low in lows]
    ring = F.lit(0)
    for i, low in enumerate(lows[1:], 1):
        ring = F.when(F.col("radius") >= low, i).otherwise(ring)
    low_, cell_ = F.array(*map(F.lit, lows)), F.array(*map(F.lit, cells))
    held = points.withColumn("ring", ring).withColumn("cell", F.floor(F.col("angle") / (2 * math.pi) * cell_[F.col("ring")]).cast("long"))
    inner = held.withColumn("other", F.explode(F.sequence(F.lit(0), "ring")))
    low = low_[F.col("other")]
    cosine = (F.cosh("radius") * F.cosh(low) - math.cosh(disk)) / (F.sinh("radius") * F.sinh(low))
    span = F.when((low <= 0) | (F.col("radius") + low <= disk), math.pi).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))
    n = cell_[F.col("other")]
    first, last = F.floor((F.col("angle") - span) / (2 * math.pi) * n), F.floor((F.col("angle") + span) / (2 * math.pi) * n)
    seen = inner.withColumn("n", n).withColumn("c", F.explode(F.sequence(first, F.least(last, first + n - 1)))).select("id", "angle", "radius", F.col("other").alias("ring"), F.pmod("c", "n").cast("long").alias("cell"))
    far = held.select(F.col("id").alias("id2"), F.col("angle").alias("angle2"), F.col("radius").alias("radius2"), "ring", "cell")
    once = (F.col("radius2") < F.col("radius")) | (F.col("radius2") == F.col("radius")) & (F.col("id2") < F.col("id"))
    return seen.join(far, ["ring", "cell"]).filter(once & (hyperbolic_distance() <= math.cosh(disk))).select(F.col("id").alias("src"), F.col("id2").alias("dst"))


def hyperbolic(spark: SparkSession, n: int, k: float = 6, gamma: float = 3.0, seed: int = 1) -> Graph:
    """A random hyperbolic graph at temperature 0."""
    points, disk = hyperbolic_points(spark, n, k, gamma, seed)
    return graph(hyperbolic_join(cut(points), disk), spark.range(n))


def near_pairs(points: DataFrame, radius: float, dims: list[str], torus: bool = False) -> DataFrame:
    """``(a, b, dist)``, a > b: points ``(id, dims...)`` in the unit cube nearer than ``radius``, by a
    grid of that width: an equi-join of cells with their neighbours, then the exact test."""
    side = max(1, int(1 / radius))
    cell = [F.least(F.floor(F.col(d) * side), F.lit(side - 1)).cast("long").alias(f"g{i}") for i, d in enumerate(dims)]
    held = points.select("id", *dims, *cell)
    around = held
    for i in range(len(dims)):
        here = F.col(f"g{i}")
        shifts = F.array_distinct(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda s: F.pmod(here + s, F.lit(side)) if torus else here + s))
        around = around.withColumn(f"g{i}", F.explode(shifts))
    other = held.select(F.col("id").alias("id2"), *[F.col(d).alias(d + "2") for d in dims], *[f"g{i}" for i in range(len(dims))])
    gap = [F.abs(F.col(d) - F.col(d + "2")) for d in dims]
    gap = [F.least(x, 1 - x) for x in gap] if torus else gap
    dist = F.sqrt(sum((x * x for x in gap[1:]), gap[0] * gap[0]))
    return around.join(other, [f"g{i}" for i in range(len(dims))]).filter("id > id2").withColumn("dist", dist).filter(F.col("dist") <= radius).select(F.col("id").alias("a"), F.col("id2").alias("b"), "dist")


def pub_web(spark: SparkSession, n: int, areas: int, radius: float, most: int, seed: int = 1) -> tuple[Graph, DataFrame]:
    """Points on the unit torus, half of them in ``areas`` dense disks; a link joins points nearer
    than ``radius`` that are among each other's ``most`` nearest; its weight is 1 over the squared
    distance. The points come with it."""
    area = F.floor(uniform(seed, F.lit("a"), "id") * areas)
    dense = uniform(seed, F.lit("d"), "id") < 0.5
    place = lambda axis: F.when(dense, F.pmod(uniform(seed, F.lit("c" + axis), area) + (uniform(seed, F.lit(axis), "id") - 0.5) * 2 * radius, F.lit(1.0))).otherwise(uniform(seed, F.lit(axis), "id"))
    points = cut(spark.range(n).select("id", place("x").alias("x"), place("y").alias("y")))
    near = near_pairs(points, radius, ["x", "y"], torus=True)
    both = near.select(F.col("a").alias("u"), F.col("b").alias("v"), "dist").unionByName(near.select(F.col("b").alias("u"), F.col("a").alias("v"), "dist"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy("dist", "v"))
    kept = both.withColumn("r", rank).filter(F.col("r") <= most)
    links = kept.select(F.greatest("u", "v").alias("src"), F.least("u", "v").alias("dst"), "dist").groupBy("src", "dst").agg(F.count("*").alias("n"), F.min("dist").alias("dist")).filter("n = 2")
    return graph(links.withColumn("w", 1 / F.greatest(F.col("dist") * F.col("dist"), F.lit(1e-12))), points.select("id"), w="w"), points


def mocnik(spark: SparkSession, dims: int, n: int, k: float, seed: int = 1) -> Graph:
    """Uniform points; i links to every j within ``k`` times the distance of its nearest neighbour
    (directed). Neighbours are looked for in a grid that widens for those points which find none."""
    names = [f"x{i}" for i in range(dims)]
    points = cut(spark.range(n).select("id", *[uniform(seed, F.lit(c), "id").alias(c) for c in names]))
    radius = 0.5 * (1 / n) ** (1 / dims)
    nearest, left = None, points.select("id")
    while True:
        near = near_pairs(points, min(radius, 2.0), names)
        both = near.select(F.col("a").alias("u"), "dist").unionByName(near.select(F.col("b").alias("u"), "dist")).groupBy("u").agg(F.min("dist").alias("d"))
        found = cut(left.join(both, F.col("id") == F.col("u")).select("id", "d"))
        nearest = found if nearest is None else nearest.unionByName(found)
        left = cut(left.join(found, "id", "left_anti"))
        if radius > 2 or not left.limit(1).count():
            break
        radius *= 2
    nearest = cut(nearest)
    far = nearest.agg(F.max("d")).first()[0] or 0.0
    both = near_pairs(points, max(far * k, 1e-9), names)
    both = both.select(F.col("a").alias("u"), F.col("b").alias("v"), "dist").unionByName(both.select(F.col("b").alias("u"), F.col("a").alias("v"), "dist"))
    rows = both.join(nearest.select(F.col("id").alias("u"), "d"), "u").filter(F.col("dist") <= F.col("d") * k)
    return graph(rows, points.select("id"), directed=True, src="u", dst="v")


# --- graphs as event streams (seq, step, type, u, v, w) ---


def path_events(spark: SparkSession, n: int) -> DataFrame:
    """A path that grows by a node in each step."""
    nodes = spark.range(n).select((F.col("id") * 2).alias("seq"), F.col("id").alias("step"), F.lit("node_add").alias("type"), F.col("id").alias("u"), F.lit(None).cast("long").alias("v"), F.lit(None).cast("double").alias("w"))
    edges = spark.range(1, n).select((F.col("id") * 2 + 1).alias("seq"), F.col("id").alias("step"), F.lit("edge_add").alias("type"), (F.col("id") - 1).alias("u"), F.col("id").alias("v"), F.lit(1.0).alias("w"))
    return nodes.unionByName(edges)


def growth_events(edges: DataFrame) -> DataFrame:
    """Of attachment lists ``(e, src, dst)`` (:func:`attached`, :func:`grown`): each node in the step
    of its number, then its edges; repeated edges and loops do not occur."""
    nodes = edges.select(F.col("src").alias("u")).unionByName(edges.select("dst").withColumnRenamed("dst", "u")).distinct()
    width = 1 << 20
    add = nodes.select((F.col("u") * width).alias("seq"), F.col("u").alias("step"), F.lit("node_add").alias("type"), "u", F.lit(None).cast("long").alias("v"), F.lit(None).cast("double").alias("w"))
    once = edges.filter("src <> dst").groupBy(*canonical()).agg(F.min("e").alias("e"))
    place = F.row_number().over(Window.partitionBy("src").orderBy("e"))  # a node's own edges
    link = once.select((F.col("src") * width + place).alias("seq"), F.col("src").alias("step"), F.lit("edge_add").alias("type"), F.col("src").alias("u"), F.col("dst").alias("v"), F.lit(1.0).alias("w"))
    return add.unionByName(link)


def forest_fire_events(spark: SparkSession, n: int, p: float, seed: int = 1, most: int = 200_000) -> DataFrame:
    """Each new node links to a random one and burns on through its neighbours, a geometric number
    of them at each. A node's links depend on all before, so one task makes it."""
    if n > most:
        raise ValueError(f"{n} nodes are more than one task takes ({most})")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            pass
        r = np.random.default_rng(seed)
        near: list[list[int]] = [[]]
        rows: list[tuple] = [(0, "node_add", 0, None)]
        for v in range(1, n):
            rows.append((v, "node_add", v, None))
            burnt, queue = set(), [int(r.integers(v))]
            while queue:
                u = queue.pop(0)
                if u in burnt:
                    continue
                burnt.add(u)
                fresh = [x for x in near[u] if x not in burnt]
                take = min(len(fresh), int(r.geometric(1 - p)) - 1) if p < 1 else len(fresh)
                queue += [fresh[i] for i in r.permutation(len(fresh))[:take]]
            near.append(sorted(burnt))
            for u in near[v]:
                near[u].append(v)
                rows.append((v, "edge_add", v, u))
        step, kind, u, w = zip(*rows, strict=True)
        yield pa.RecordBatch.from_pydict({"seq": np.arange(len(rows)), "step": pa.array(step, pa.int64()), "type": list(kind), "u": pa.array(u, pa.int64()), "v": pa.array(w, pa.int64()), "w": pa.array([1.0 if x is not None else None for x in w], pa.float64())})

    return spark.range(1).coalesce(1).mapInArrow(kernel, "seq long, step long, type string, u long, v long, w double")


def moving_events(spark: SparkSession, n: int, steps: int, k: float = 6, gamma: float = 3.0, share: float = 0.1, swing: float = 0.05, seed: int = 1) -> DataFrame:
    """A hyperbolic graph in which, in each step, a share of the points turns by ``swing`` at most:
    the edges that come and go."""
    points, disk = hyperbolic_points(spark, n, k, gamma, seed)
    points = cut(points)
    now = cut(graph(hyperbolic_join(points, disk), spark.range(n)).edges.select("src", "dst"))
    out = None
    for step in range(1, steps + 1):
        turn = F.when(uniform(seed, F.lit(f"m{step}"), "id") < share, (uniform(seed, F.lit(f"s{step}"), "id") * 2 - 1) * swing).otherwise(0.0)
        points = cut(points.withColumn("angle", F.pmod(F.col("angle") + turn, F.lit(2 * math.pi))))
        then = cut(graph(hyperbolic_join(points, disk), spark.range(n)).edges.select("src", "dst"))
        gone = now.join(then, ["src", "dst"], "left_anti").select(F.lit("edge_remove").alias("type"), "src", "dst")
        come = then.join(now, ["src", "dst"], "left_anti").select(F.lit("edge_add").alias("type"), "src", "dst")
        rows = gone.unionByName(come).select(F.lit(step).cast("long").alias("step"), "type", F.col("src").alias("u"), F.col("dst").alias("v"))
        out = rows if out is None else out.unionByName(rows)
        now = then
    return numbered(out, ["step", F.col("type").desc(), "u", "v"], "seq").select("seq", "step", "type", "u", "v", F.lit(1.0).alias("w"))
