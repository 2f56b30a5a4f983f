"""Partitions and covers: construction, quality, comparison, coarsening.

A partition is ``(node, block)``; a cover has the same columns and may list a node more than once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph, canonical, numbered
from weftgraph.lineage import cut
from weftgraph.operators import kernels


def singletons(g: Graph) -> DataFrame:
    return g.nodes.select(F.col("id").alias("node"), F.col("id").alias("block"))


def one_block(g: Graph) -> DataFrame:
    return g.nodes.select(F.col("id").alias("node"), F.lit(0).cast("long").alias("block"))


def balanced(g: Graph, k: int) -> DataFrame:
    """Runs of ids of about equal length."""
    n = g.nodes.count()
    at = numbered(g.nodes, ["id"], "at")
    return at.select(F.col("id").alias("node"), F.floor(F.col("at") * k / max(n, 1)).alias("block"))


def interleaved(g: Graph, k: int) -> DataFrame:
    at = numbered(g.nodes, ["id"], "at")
    return at.select(F.col("id").alias("node"), (F.col("at") % k).alias("block"))


def random_blocks(g: Graph, k: int, seed: int) -> DataFrame:
    return g.nodes.select(F.col("id").alias("node"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(k)).alias("block"))


def compact(blocks: DataFrame) -> DataFrame:
    """Dense block ids in the order of the old."""
    ids = numbered(blocks.select("block").distinct(), ["block"], "new")
    return blocks.join(ids, "block").select("node", F.col("new").alias("block"))


def sizes(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("block").agg(F.count("*").alias("size"))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """The common refinement; a block is named by its least node."""
    both = a.join(b.select("node", F.col("block").alias("other")), "node")
    names = both.groupBy("block", "other").agg(F.min("node").alias("name"))
    return both.join(names, ["block", "other"]).select("node", F.col("name").alias("block"))


def imbalance(blocks: DataFrame) -> DataFrame:
    s = sizes(blocks).agg(F.max("size").alias("most"), F.sum("size").alias("n"), F.count("*").alias("k"))
    return s.select((F.col("most") / F.ceil(F.col("n") / F.col("k"))).alias("imbalance"))


def _with_blocks(g: Graph, blocks: DataFrame) -> DataFrame:
    a, b = blocks.select(F.col("node").alias("src"), F.col("block").alias("a")), blocks.select(F.col("node").alias("dst"), F.col("block").alias("b"))
    return g.edges.join(a, "src").join(b, "dst")


def coverage(g: Graph, blocks: DataFrame) -> DataFrame:
    """``(coverage)``: weight within blocks over all."""
    return _with_blocks(g, blocks).agg((F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)) / F.sum("w")).alias("coverage"))


def edge_cut(g: Graph, blocks: DataFrame) -> DataFrame:
    return _with_blocks(g, blocks).agg(F.coalesce(F.sum(F.when(F.col("a") != F.col("b"), F.col("w"))), F.lit(0.0)).alias("cut"))


def volumes(g: Graph, blocks: DataFrame) -> DataFrame:
    """``(block, volume)``: weighted degrees, loops twice."""
    return blocks.join(g.degrees(twice=True), F.col("node") == F.col("id")).groupBy("block").agg(F.sum("weighted").alias("volume"))


def modularity(g: Graph, blocks: DataFrame) -> DataFrame:
    """``(modularity)``: coverage less the sum of squared volumes over 4 W²."""
    whole = g.edges.agg(F.sum("w").alias("total"))
    expected = volumes(g, blocks).agg(F.sum(F.col("volume") * F.col("volume")).alias("squares"))
    rows = coverage(g, blocks).crossJoin(whole).crossJoin(expected)  # one row each
    return rows.select((F.col("coverage") - F.col("squares") / (4 * F.col("total") * F.col("total"))).alias("modularity"))


def block_table(g: Graph, blocks: DataFrame) -> DataFrame:
    """``(block, size, inner, inner_edges, cut, volume)``: loops count once in ``inner``, twice in
    ``volume``."""
    ends = _with_blocks(g, blocks)
    inner = ends.filter("a = b").groupBy(F.col("a").alias("block")).agg(F.sum("w").alias("inner"), F.count("*").alias("inner_edges"))
    crossing = ends.filter("a <> b")
    outer = crossing.select(F.col("a").alias("block"), "w").unionByName(crossing.select(F.col("b").alias("block"), "w")).groupBy("block").agg(F.sum("w").alias("cut"))
    rows = sizes(blocks).join(inner, "block", "left").join(outer, "block", "left").join(volumes(g, blocks), "block", "left")
    return rows.na.fill(0)


def conductance(g: Graph, blocks: DataFrame) -> DataFrame:
    """``(block, score)``: cut over the lesser of the block's volume and the rest's; 0 if that is 0."""
    t = block_table(g, blocks)
    whole = t.agg(F.sum("volume").alias("whole"))
    low = F.least(F.col("volume"), F.col("whole") - F.col("volume"))
    return t.crossJoin(whole).select("block", F.when(low == 0, 0.0).otherwise(F.col("cut") / low).alias("score"))  # one row


def expansion(g: Graph, blocks: DataFrame) -> DataFrame:
    """``(block, score)``: cut over the lesser of the block's size and the rest's."""
    t = block_table(g, blocks)
    whole = t.agg(F.sum("size").alias("whole"))
    low = F.least(F.col("size"), F.col("whole") - F.col("size"))
    return t.crossJoin(whole).select("block", F.when(low == 0, 0.0).otherwise(F.col("cut") / low).alias("score"))  # one row


def density(g: Graph, blocks: DataFrame) -> DataFrame:
    """``(block, score)``: edges over possible ones, 1 for a single node."""
    n = F.col("size").cast("double")
    return block_table(g, blocks).select("block", F.when(n < 2, 1.0).otherwise(F.col("inner_edges") / (n * (n - 1) / 2)).alias("score"))


def hub_dominance(g: Graph, blocks: DataFrame) -> DataFrame:
    """``(block, score)``: greatest inner degree over size - 1, 1 for a single node."""
    a, b = blocks.select(F.col("node").alias("u"), F.col("block").alias("a")), blocks.select(F.col("node").alias("v"), F.col("block").alias("b"))
    inner = g.adjacency.join(a, "u").join(b, "v").filter("a = b").groupBy("a", "u").agg(F.count("*").alias("d")).groupBy("a").agg(F.max("d").alias("d"))
    rows = sizes(blocks).join(inner, F.col("block") == F.col("a"), "left")
    return rows.select("block", F.when(F.col("size") < 2, 1.0).otherwise(F.coalesce("d", F.lit(0)) / (F.col("size") - 1)).alias("score"))


def fragmentation(blocks: DataFrame, components: DataFrame) -> DataFrame:
    """``(block, score)``: 1 less the share of a block's largest part within one component;
    components ``(node, component)`` of the whole graph."""
    part = blocks.join(components, "node").groupBy("block", "component").agg(F.count("*").alias("c"))
    return part.groupBy("block").agg((1 - F.max("c") / F.sum("c")).alias("score"))


def stable_nodes(g: Graph, blocks: DataFrame) -> DataFrame:
    """``(node, score)``: 1 if a node's weight to its block is over that to any other block, or it
    has no neighbours; weights are cut to whole numbers."""
    a, b = blocks.select(F.col("node").alias("u"), F.col("block").alias("a")), blocks.select(F.col("node").alias("v"), F.col("block").alias("b"))
    per = g.adjacency.join(a, "u").join(b, "v").groupBy("u", "a", "b").agg(F.sum(F.floor("w")).alias("s"))
    best = per.groupBy("u").agg(F.coalesce(F.max(F.when(F.col("a") == F.col("b"), F.col("s"))), F.lit(0)).alias("own"), F.coalesce(F.max(F.when(F.col("a") != F.col("b"), F.col("s"))), F.lit(0)).alias("other"))
    rows = blocks.join(best, F.col("node") == F.col("u"), "left")
    return rows.select("node", F.when(F.col("u").isNull() | (F.col("own") > F.col("other")), 1.0).otherwise(0.0).alias("score"))


def averages(scores: DataFrame, size: DataFrame) -> DataFrame:
    """``(unweighted, weighted, least, most)`` of per-block scores; weights are block sizes."""
    rows = scores.join(size, "block")
    return rows.agg(F.avg("score").alias("unweighted"), (F.sum(F.col("score") * F.col("size")) / F.sum("size")).alias("weighted"), F.min("score").alias("least"), F.max("score").alias("most"))


def _pairs(n: Column) -> Column:
    n = n.cast("double")
    return n * (n - 1) / 2


def comparison(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row of dissimilarities over common nodes: ``rand``, ``jaccard``, ``adjusted_rand`` and
    ``nmi`` (1 less normalised mutual information, over the sum of the entropies)."""
    both = a.join(b.select("node", F.col("block").alias("other")), "node").groupBy("block", "other").agg(F.count("*").alias("c"))
    rows, cols = both.groupBy("block").agg(F.sum("c").alias("ca")), both.groupBy("other").agg(F.sum("c").alias("cb"))
    n = both.agg(F.sum("c").alias("n"))
    cells = both.join(rows, "block").join(cols, "other").crossJoin(n)  # one row
    c, ca, cb, n_ = (F.col(x).cast("double") for x in ("c", "ca", "cb", "n"))
    s = cells.agg(F.sum(_pairs(F.col("c"))).alias("both"), F.sum(c / n_ * F.log2(c * n_ / (ca * cb))).alias("mutual"))
    ra = rows.crossJoin(n).agg(F.sum(_pairs(F.col("ca"))).alias("pa"), F.sum(-ca / n_ * F.log2(ca / n_)).alias("ha"))
    rb = cols.crossJoin(n).agg(F.sum(_pairs(F.col("cb"))).alias("pb"), F.sum(-cb / n_ * F.log2(cb / n_)).alias("hb"))
    t = s.crossJoin(ra).crossJoin(rb).crossJoin(n).withColumn("all", _pairs(F.col("n")))
    agree = F.col("all") + 2 * F.col("both") - F.col("pa") - F.col("pb")
    either = F.col("pa") + F.col("pb") - F.col("both")
    expect = F.col("pa") * F.col("pb") / F.col("all")
    most = (F.col("pa") + F.col("pb")) / 2
    h = F.col("ha") + F.col("hb")
    return t.select(
        F.when(F.col("all") > 0, 1 - agree / F.col("all")).otherwise(0.0).alias("rand"),
        F.when(either > 0, 1 - F.col("both") / either).otherwise(0.0).alias("jaccard"),
        F.when(most - expect == 0, 0.0).otherwise(1 - (F.col("both") - expect) / (most - expect)).alias("adjusted_rand"),
        F.when(h == 0, 0.0).otherwise(1 - 2 * F.col("mutual") / h).alias("nmi"),
    )


def graph_rand(g: Graph, a: DataFrame, b: DataFrame) -> DataFrame:
    """``(rand)``: share of edges whose ends agree in one partition and not in the other."""
    first = _with_blocks(g, a).select("src", "dst", (F.col("a") == F.col("b")).alias("x"))
    a2, b2 = b.select(F.col("node").alias("src"), F.col("block").alias("a")), b.select(F.col("node").alias("dst"), F.col("block").alias("b"))
    return first.join(a2, "src").join(b2, "dst").agg(F.avg((F.col("x") != (F.col("a") == F.col("b"))).cast("double")).alias("rand"))


def cover_f1(cover: DataFrame, reference: DataFrame) -> DataFrame:
    """``(block, score)``: best F1 of each block against the reference's blocks."""
    size, other = sizes(cover), sizes(reference).select(F.col("block").alias("r"), F.col("size").alias("rs"))
    met = cover.join(reference.select("node", F.col("block").alias("r")), "node").groupBy("block", "r").agg(F.count("*").alias("c"))
    f1 = met.join(size, "block").join(other, "r").select("block", (2 * F.col("c") / (F.col("size") + F.col("rs"))).alias("f1")).groupBy("block").agg(F.max("f1").alias("f1"))
    return size.join(f1, "block", "left").select("block", F.coalesce("f1", F.lit(0.0)).alias("score"))


def coarsen(g: Graph, blocks: DataFrame) -> Graph:
    """Blocks become nodes, weights add up, inner edges become self-loops."""
    ends = _with_blocks(g, blocks).select(F.col("a").alias("src"), F.col("b").alias("dst"), "w")
    if not g.directed:
        ends = ends.select(*canonical(), "w")
    return Graph(blocks.select(F.col("block").alias("id")).distinct(), ends.groupBy("src", "dst").agg(F.sum("w").alias("w")), g.directed, True)


def project(fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """A coarse graph's partition on the fine nodes; fine ``(node, block)`` names coarse nodes."""
    return fine.join(coarse.select(F.col("node").alias("block"), F.col("block").alias("new")), "block").select("node", F.col("new").alias("block"))


def set_conductance(g: Graph, chosen: DataFrame) -> DataFrame:
    """``(conductance)`` of a set of nodes ``(id)`` against the rest; 1 if either side is empty."""
    two = g.nodes.join(chosen.select("id", F.lit(1).alias("in")).distinct(), "id", "left").select(F.col("id").alias("node"), F.coalesce("in", F.lit(0)).alias("block"))
    t = block_table(g, two).agg(F.max("cut").alias("cut"), F.min("volume").alias("low"), F.count("*").alias("k"))
    return t.select(F.when((F.col("k") < 2) | (F.col("low") == 0), 1.0).otherwise(F.col("cut") / F.col("low")).alias("conductance"))


def assortativity(g: Graph, value: DataFrame) -> DataFrame:
    """``(assortativity)``: Pearson correlation of a number ``(node, value)`` over edges as stored."""
    a, b = value.select(F.col("node").alias("src"), F.col("value").alias("x")), value.select(F.col("node").alias("dst"), F.col("value").alias("y"))
    return g.edges.join(a, "src").join(b, "dst").agg(F.corr("x", "y").alias("assortativity"))


def nominal_assortativity(g: Graph, blocks: DataFrame) -> DataFrame:
    """``(assortativity)`` of a label: (trace - chance) / (1 - chance) of the edge matrix."""
    ends = _with_blocks(g, blocks)
    m = ends.agg(F.count("*").cast("double").alias("m"), F.sum((F.col("a") == F.col("b")).cast("double")).alias("t"))
    x, y = ends.groupBy(F.col("a").alias("k")).agg(F.count("*").alias("x")), ends.groupBy(F.col("b").alias("k")).agg(F.count("*").alias("y"))
    chance = x.join(y, "k").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("ab"))
    rows = m.crossJoin(chance).select((F.col("t") / F.col("m")).alias("t"), (F.col("ab") / (F.col("m") * F.col("m"))).alias("ab"))  # one row each
    return rows.select(((F.col("t") - F.col("ab")) / (1 - F.col("ab"))).alias("assortativity"))


def label_propagation(g: Graph, rounds: int = 20) -> DataFrame:
    """``(node, block)``: all nodes take the label of the most weight around them at once, ties
    and a node's own label in favour of the least; nodes of even and odd hash move in turns, which
    keeps two sides from trading labels for ever."""
    g = g.kept()
    state, busy = cut(singletons(g)), True
    for k in range(rounds):
        seen = g.adjacency.filter("u <> v").join(state, F.col("v") == F.col("node")).groupBy("u", "block").agg(F.sum("w").alias("s"))
        best = seen.groupBy("u").agg(F.max_by("block", F.struct("s", (-F.col("block")).alias("t"))).alias("new"))
        turn = F.pmod(F.xxhash64("node"), F.lit(2)) == k % 2
        new = cut(state.join(best, F.col("node") == F.col("u"), "left").select("node", F.when(turn, F.coalesce("new", "block")).otherwise(F.col("block")).alias("block"), (turn & (F.coalesce("new", "block") != F.col("block"))).alias("moved")))
        state = new.select("node", "block")
        before, busy = busy, bool(new.filter("moved").limit(1).count())
        if not before and not busy:
            break
    return state


def louvain(g: Graph, gamma: float = 1.0, levels: int = 12, rounds: int = 16) -> DataFrame:
    """``(node, block)``: greedy modularity moves on ever coarser graphs. In each round every node
    finds its best neighbouring block from one aggregate; a seeded half of the nodes moves."""
    level = Graph(g.nodes, g.edges, False, True).kept()
    if kernels.small(level):
        return kernels.whole(level, kernels.louvain(gamma, levels, 4 * rounds), "node long, block long")
    return _louvain(level, gamma, levels, rounds)


def _louvain(level: Graph, gamma: float, levels: int, rounds: int) -> DataFrame:
    mapping = cut(singletons(level))
    total = level.edges.agg(F.sum("w")).first()[0] or 0.0
    if not total:
        return mapping
    for depth in range(levels):
        state = cut(singletons(level))
        deg = cut(level.degrees(twice=True).select("id", F.col("weighted").alias("k")))
        near = level.adjacency.filter("u <> v")
        moved_any = False
        still = 0
        for r in range(rounds):
            vol = state.join(deg, F.col("node") == F.col("id")).groupBy("block").agg(F.sum("k").alias("vol"))
            to = near.join(state.select(F.col("node").alias("v"), "block"), "v").groupBy("u", "block").agg(F.sum("w").alias("aff"))
            own = state.select(F.col("node").alias("u"), F.col("block").alias("own"))
            cand = to.join(own, "u").join(vol, "block").join(deg.select(F.col("id").alias("u"), "k"), "u")
            rest = F.when(F.col("block") == F.col("own"), F.col("vol") - F.col("k")).otherwise(F.col("vol"))
            gain = F.col("aff") / total - gamma * rest * F.col("k") / (2 * total * total)
            best = cand.groupBy("u", "own").agg(
                F.max_by("block", F.struct(gain.alias("g"), (-F.col("block")).alias("t"))).alias("new"), F.max(gain).alias("g"),
                F.max(F.when(F.col("block") == F.col("own"), gain)).alias("stay"), F.first("k").alias("k"),
            )
            alone = vol.select(F.col("block").alias("own"), F.col("vol").alias("ov"))
            best = best.join(alone, "own").withColumn("stay", F.coalesce("stay", -gamma * (F.col("ov") - F.col("k")) * F.col("k") / (2 * total * total)))
            turn = F.pmod(F.xxhash64(F.lit(r + 31 * depth), "u"), F.lit(2)) == 0
            move = best.filter(turn & (F.col("g") > F.col("stay") + 1e-12) & (F.col("new") != F.col("own"))).select(F.col("u").alias("node"), "new")
            new = cut(state.join(move, "node", "left").select("node", F.coalesce("new", "block").alias("block"), F.col("new").isNotNull().alias("moved")))
            count = new.filter("moved").count()
            state = new.select("node", "block")
            moved_any |= count > 0
            still = 0 if count else still + 1
            if still == 2:
                break
        if not moved_any:
            break
        mapping = cut(project(mapping, state))
        level = coarsen(level, state).kept()
    names = mapping.groupBy("block").agg(F.min("node").alias("name"))
    return mapping.join(names, "block").select("node", F.col("name").alias("block"))
