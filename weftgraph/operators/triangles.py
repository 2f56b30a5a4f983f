"""Triangles and what is counted over them.

Edges are oriented from the end of lower degree to the other (ties by id), so that a node sends out
few edges whatever its degree; pairs of a node's outgoing edges are wedges, and an edge between their
ends closes them. Degrees are told apart where they are among the greatest only, which are broadcast:
the rest have few edges anyway. Self-loops and repeated edges play no part.

Wedges never travel. Nodes have one of k colours, and there is a task for each pair of colours: it looks for the
wedges with ends of these colours, which only edges between these colours close. So the list of a node's outgoing
edges to one colour goes to k tasks, packed, whatever the number of wedges; k is the same for 6 to 500 million
edges. A task keeps the edges between its colours and streams the lists.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph, spread
from weftgraph.lineage import cut

#: Wedges looked at in one go.
WEDGES = 1 << 20
#: Nodes whose degrees are broadcast.
HUBS = 200_000


def simple_pairs(g: Graph) -> DataFrame:
    """``(src, dst)``: distinct undirected pairs, larger first."""
    return g.edges.filter("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()


def triangles(g: Graph) -> DataFrame:
    """``(a, b, c)``: each triangle once."""
    g = g.kept()
    return _dealt(g, g.edges.count()).mapInArrow(_rows, "a long, b long, c long")


def _dealt(g: Graph, m: int, degrees: DataFrame | None = None) -> DataFrame:
    """``(later, part, own, far, x, y, data)``: packed lists of outgoing edges, of one partition and a colour at each
    end, as the task of the colours x and y gets them: first those between its colours. ``degrees``: ``(id, degree)``
    to pack as well."""
    parts, k = spread(g.spark, m), _colours(m)
    pairs = g.edges.filter("src <> dst").select("src", "dst")
    rank = F.lit(0), F.lit(0)
    hubs = _hubs(pairs, max(parts // 4, min(parts, g.spark.sparkContext.defaultParallelism)))
    if hubs is not None:
        pairs = pairs.join(F.broadcast(hubs.select(F.col("u").alias("src"), F.col("d").alias("ds"))), "src", "left").join(F.broadcast(hubs.select(F.col("u").alias("dst"), F.col("d").alias("dd"))), "dst", "left")
        rank = F.coalesce("ds", F.lit(0)), F.coalesce("dd", F.lit(0))
    up = F.struct(rank[0].alias("d"), F.col("src").alias("id")) < F.struct(rank[1].alias("d"), F.col("dst").alias("id"))
    oriented = pairs.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("lo"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("hi"))
    if degrees is not None:
        oriented = oriented.repartition(parts, "hi").join(degrees.select(F.col("id").alias("hi"), F.col("degree").alias("dhi")), "hi")
    oriented = oriented.repartition(parts, "lo")
    if degrees is not None:
        oriented = oriented.join(degrees.select(F.col("id").alias("lo"), F.col("degree").alias("dlo")), "lo").select("lo", "hi", "dlo", "dhi")
    lists = oriented.mapInArrow(_packer(k), "part int, own int, far int, data binary")
    dealt = lists.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    dealt = dealt.withColumn("x", F.greatest("far", "other")).withColumn("y", F.least("far", "other")).withColumn("later", F.col("other") != F.col("own"))
    placed = dealt.repartitionById(k * (k + 1) // 2, (F.col("x") * (F.col("x") + 1) / 2 + F.col("y")).cast("int"))
    return placed.sortWithinPartitions("later", "part", "own", "far").select("later", "part", "own", "far", "x", "y", "data")


def _hubs(pairs: DataFrame, parts: int) -> DataFrame | None:
    """``(u, d)``: degrees of the nodes over a power of two that at most ``HUBS`` nodes exceed."""
    both = pairs.coalesce(parts).select(F.explode(F.array("src", "dst")).alias("u"))
    deg = cut(both.groupBy("u").agg(F.count("*").alias("d")))
    sizes = deg.groupBy(F.ceil(F.log2("d")).alias("c")).count().orderBy(F.col("c").desc()).collect()
    seen = 0
    for size in sizes:
        seen += size["count"]
        if seen > HUBS:
            return deg.filter(F.ceil(F.log2("d")) > size["c"])
    return deg if sizes else None


def _colours(m: int) -> int:
    """From 6 to 500 million edges 8, so 36 tasks; beyond, a task keeps 16 million edges."""
    return max(1, min(8, math.ceil(math.sqrt(m / 100_000))), math.ceil(math.sqrt(2 * m / 16_000_000)))


def _colour(ids: np.ndarray, k: int) -> np.ndarray:
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(k)).astype(np.int64)


def _squeeze(x: np.ndarray) -> bytes:
    """Differences in the narrowest type."""
    step = np.diff(x)
    low, high = (int(step.min()), int(step.max())) if len(step) else (0, 0)
    width = next(w for w in (1, 2, 4, 8) if -(1 << (8 * w - 1)) <= low and high < 1 << (8 * w - 1))
    return np.array([len(x), width, x[0]], np.int64).tobytes() + step.astype(f"i{width}").tobytes()


def _unsqueeze(data: bytes, at: int) -> tuple[np.ndarray, int]:
    n, width, first = np.frombuffer(data, np.int64, 3, at).tolist()
    x = np.empty(n, np.int64)
    x[0] = first
    x[1:] = np.frombuffer(data, f"i{width}", n - 1, at + 24)
    return np.cumsum(x), at + 24 + width * (n - 1)


def _open(data: bytes) -> tuple[np.ndarray, ...]:
    """The nodes of packed lists, their lengths, and the lists one after the other; then the degrees of the nodes and
    of the lists' elements, if packed."""
    found, at = [], 0
    while at < len(data):
        x, at = _unsqueeze(data, at)
        found.append(x)
    return tuple(found)


def _packer(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if not held:
            return
        lo, hi, *degrees = (np.concatenate(x) for x in zip(*held, strict=True))
        del held
        own, far = _colour(lo, k), _colour(hi, k)
        order = np.lexsort((hi, lo, own * k + far))
        lo, hi, cell = lo[order], hi[order], (own * k + far)[order]
        new = np.append(True, (np.diff(lo) != 0) | (np.diff(hi) != 0))  # repeated edges meet here
        lo, hi, cell = lo[new], hi[new], cell[new]
        degrees = [d[order][new] for d in degrees]
        edge = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
        part = TaskContext.get().partitionId()
        for s, e in zip(edge[:-1], edge[1:], strict=True):
            node, first, count = np.unique(lo[s:e], return_index=True, return_counts=True)
            data = _squeeze(node) + _squeeze(count) + _squeeze(hi[s:e])
            if degrees:
                data += _squeeze(degrees[0][s:e][first]) + _squeeze(degrees[1][s:e])
            c = int(cell[s])
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "own": pa.array([c // k], pa.int32()), "far": pa.array([c % k], pa.int32()), "data": pa.array([data], pa.binary())})

    return run


class _Closing:
    """The edges between the colours x and y: of a node of colour x and one of colour y, by their positions in ``xs``
    and ``ys``; of one colour, the larger node first. A table of bits turns most wedges away."""

    def __init__(self, cells: dict, x: int, y: int):
        self.x, self.y = x, y
        found = [self._ends(own, far, *_open(data)) for (_, own), (far, data) in cells.items()]
        i, j = (np.concatenate(e) for e in zip(*found, strict=True))
        del found
        self.xs = np.unique(np.concatenate([i, j])) if x == y else np.unique(i)
        self.ys = self.xs if x == y else np.unique(j)
        self.keys = np.sort(np.searchsorted(self.xs, i) * len(self.ys) + np.searchsorted(self.ys, j))
        del i, j
        self.shift = np.uint64(64 - max(10, int(8 * len(self.keys)).bit_length()))
        bits = np.zeros(1 << (64 - int(self.shift)), bool)
        bits[self._slot(self.keys)] = True
        self.bits = np.packbits(bits, bitorder="little")

    def _ends(self, own: int, far: int, node: np.ndarray, count: np.ndarray, hi: np.ndarray, *_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo = np.repeat(node, count)
        if self.x == self.y:
            return np.maximum(lo, hi), np.minimum(lo, hi)
        return (lo, hi) if own == self.x else (hi, lo)

    def place(self, own: int, far: int, *lists: np.ndarray) -> np.ndarray:
        i, j = self._ends(own, far, *lists)
        return np.searchsorted(self.keys, np.searchsorted(self.xs, i) * len(self.ys) + np.searchsorted(self.ys, j))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs of positions are edges, and of these the places in ``keys``."""
        keys = i * len(self.ys) + j
        slot = self._slot(keys)
        maybe = np.flatnonzero((self.bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
        at = np.searchsorted(self.keys, keys[maybe])
        real = (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == keys[maybe])
        return maybe[real], at[real]


class _Task:
    """The rows of one task; ``cells`` are the lists between its colours, by partition and own colour."""

    def __init__(self):
        self.cells: dict[tuple[int, int], tuple[int, bytes]] = {}
        self.closing: _Closing | None = None

    def closed(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """The triangles of a group of lists at a time: ``(part, own), one, i, other, j, at`` with elements i of the list
        ``one`` (far colour, nodes, lengths, elements) and j of ``other``, and the closing edges' places."""
        group, lists, x, y = None, {}, 0, 0
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for later, part, own, far, x, y, data in zip(*columns, batch.column(6), strict=True):
                if not later:
                    self.cells[part, own] = (far, data.as_py())
                    continue
                if (part, own) != group:
                    yield from self._of(group, lists, x, y)
                    group, lists = (part, own), {}
                lists[far] = data.as_py()
        yield from self._of(group, lists, x, y)
        if x == y:  # nodes of this colour have this one list here
            for group in self.cells:
                yield from self._of(group, {}, x, y)

    def _of(self, group: tuple[int, int] | None, lists: dict[int, bytes], x: int, y: int) -> Iterator[tuple]:
        if group is None or not self.cells:
            return
        if self.closing is None:
            self.closing = _Closing(self.cells, x, y)
        if group in self.cells:
            far, data = self.cells[group]
            lists[far] = data
        if x not in lists or y not in lists:
            return
        one = (x, *_open(lists[x]))
        other = one if x == y else (y, *_open(lists[y]))
        for i, j, at in _wedges(self.closing, one, other):
            yield group, one, i, other, j, at


def _wedges(closing: _Closing, one: tuple, other: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    _, node, count, x = one[:4]
    if one is other:
        i = np.arange(len(x))
        start = np.repeat(np.cumsum(count) - count, count)
        size = i - start  # pairs with those before
    else:
        _, met, length = other[:3]
        both, at, to = np.intersect1d(node, met, assume_unique=True, return_indices=True)
        size_of, start_of = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
        size_of[at], start_of[at] = length[to], (np.cumsum(length) - length)[to]
        size, start = np.repeat(size_of, count), np.repeat(start_of, count)
    px, py = np.searchsorted(closing.xs, x), np.searchsorted(closing.ys, other[3])
    known = (px < len(closing.xs)) & (closing.xs[np.minimum(px, len(closing.xs) - 1)] == x)
    good = (py < len(closing.ys)) & (closing.ys[np.minimum(py, len(closing.ys) - 1)] == other[3])
    i = np.flatnonzero(known & (size > 0))
    done = np.cumsum(size[i])
    at = 0
    while at < len(i):
        end = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + WEDGES, "right")))
        rows = i[at:end]
        n = size[rows]
        left = np.repeat(rows, n)
        right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n - start[rows], n)
        at = end
        if not good.all():
            fine = good[right]
            left, right = left[fine], right[fine]
        real, place = closing.find(px[left], py[right])
        if len(real):
            yield left[real], right[real], place


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, one, i, other, j, _ in _Task().closed(batches):
        lo = np.repeat(one[1], one[2])[i]
        x, y = one[3][i], other[3][j]
        yield pa.RecordBatch.from_pydict({"a": lo, "b": np.maximum(x, y), "c": np.minimum(x, y)})


def node_triangles(g: Graph) -> DataFrame:
    """``(node, triangles)`` of the nodes in one at least."""
    return triangles(g).select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))


def edge_triangles(g: Graph) -> DataFrame:
    """``(src, dst, w, score)``: triangles over each edge, also of no triangle. The tasks send back a number for each
    element of the lists they got."""
    g = g.kept()
    m = g.edges.count()
    numbers = _dealt(g, m).mapInArrow(_counts, "part int, own int, far int, later boolean, data binary")
    gathered = numbers.repartition(spread(g.spark, m), "part", "own", "far").sortWithinPartitions("part", "own", "far", "later")
    found = gathered.mapInArrow(_summed, "src long, dst long, score long")
    return g.edges.repartition(spread(g.spark, m), "src", "dst").join(found, ["src", "dst"], "left").select("src", "dst", "w", F.coalesce("score", F.lit(0)).alias("score"))


def common_degrees(g: Graph, degrees: DataFrame, weigh: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``(src, dst, total)`` of the pairs ``src > dst`` that are edges and have common neighbours: the sum of their
    degrees' weights, each between 2^-7 and 2^20. Sums are of whole numbers, so that they are exact but for one last
    rounding and the same at each run. ``degrees``: ``(id, degree)``."""
    g = g.kept()
    m = g.edges.count()
    numbers = _dealt(g, m, degrees).mapInArrow(_thirds, "part int, own int, far int, later boolean, data binary")
    gathered = numbers.repartition(spread(g.spark, m), "part", "own", "far").sortWithinPartitions("part", "own", "far", "later")
    return gathered.mapInArrow(_weighed(weigh), "src long, dst long, total double")


def _thirds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``_counts``, and after each numbers the degrees of the third nodes, element by element."""
    task = _Task()
    now, mine, closing = None, {}, ([np.empty(0, np.int64)], [np.empty(0, np.int64)])

    def row(part: int, own: int, far: int, later: bool, data: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "own": pa.array([own], pa.int32()), "far": pa.array([far], pa.int32()), "later": [later], "data": pa.array([data], pa.binary())})

    def packed(count: np.ndarray, degree: np.ndarray) -> bytes:
        return _squeeze(count) + _squeeze(degree)

    def rows() -> Iterator[pa.RecordBatch]:
        for (part, own, far), (n, at, degree) in mine.items():
            at, degree = np.concatenate(at), np.concatenate(degree)
            yield row(part, own, far, True, packed(np.bincount(at, minlength=n), degree[np.argsort(at, kind="stable")]))

    for group, one, i, other, j, at in task.closed(batches):
        if one is not now:
            yield from rows()
            now, mine = one, {(*group, x[0]): (len(x[3]), [], []) for x in (one, other)}
        for a, b, x, y in ((i, j, one, other), (j, i, other, one)):
            mine[*group, x[0]][1].append(a)
            mine[*group, x[0]][2].append(y[5][b])
        closing[0].append(at)
        closing[1].append(np.repeat(one[4], one[2])[i])
    yield from rows()
    at, degree = np.concatenate(closing[0]), np.concatenate(closing[1])
    order = np.argsort(at, kind="stable")
    at, degree = at[order], degree[order]
    del closing, order
    for (part, own), (far, data) in task.cells.items():
        yield row(part, own, far, False, data)
        if len(at):
            place = task.closing.place(own, far, *_open(data))
            start = np.searchsorted(at, place)
            n = np.searchsorted(at, place, "right") - start
            if n.any():
                yield row(part, own, far, True, packed(n, degree[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - start, n)]))


def _weighed(weigh: Callable[[np.ndarray], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, data, high, low = None, b"", np.empty(0, np.int64), np.empty(0, np.int64)

        def rows() -> Iterator[pa.RecordBatch]:
            some = high + low > 0
            if some.any():
                node, count, hi = _open(data)[:3]
                lo = np.repeat(node, count)
                total = high * 2.0**-30 + low * 2.0**-60
                yield pa.RecordBatch.from_pydict({"src": np.maximum(lo, hi)[some], "dst": np.minimum(lo, hi)[some], "total": total[some]})

        for batch in batches:
            for part, own, far, later, one in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
                if not later:
                    yield from rows()
                    cell, data = (part, own, far), one.as_py()
                    high, low = (np.zeros(len(_open(data)[2]), np.int64) for _ in range(2))
                else:
                    assert (part, own, far) == cell
                    count, degree = _open(one.as_py())
                    weight = weigh(degree.astype(float)) * 2.0**30
                    whole = np.floor(weight)
                    at = np.repeat(np.arange(len(count)), count)
                    np.add.at(high, at, whole.astype(np.int64))
                    np.add.at(low, at, ((weight - whole) * 2.0**30).astype(np.int64))
        yield from rows()

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists between the task's colours, and triangles for each element of these and of the lists that came later."""
    task = _Task()
    now, mine, closing = None, {}, None

    def row(part: int, own: int, far: int, later: bool, data: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "own": pa.array([own], pa.int32()), "far": pa.array([far], pa.int32()), "later": [later], "data": pa.array([data], pa.binary())})

    def narrow(n: np.ndarray) -> bytes:
        width = next(w for w in (1, 2, 4, 8) if int(n.max()) < 1 << (8 * w))
        return bytes([width]) + n.astype(f"u{width}").tobytes()

    for group, one, i, other, j, at in task.closed(batches):
        if closing is None:
            closing = np.zeros(len(task.closing.keys), np.int64)
        if one is not now:
            for (part, own, far), n in mine.items():
                yield row(part, own, far, True, narrow(n))
            now, mine = one, {(*group, x[0]): np.zeros(len(x[3]), np.int64) for x in (one, other)}
        np.add.at(mine[*group, one[0]], i, 1)
        np.add.at(mine[*group, other[0]], j, 1)
        np.add.at(closing, at, 1)
    for (part, own, far), n in mine.items():
        yield row(part, own, far, True, narrow(n))
    for (part, own), (far, data) in task.cells.items():
        yield row(part, own, far, False, data)
        if closing is not None:
            yield row(part, own, far, True, narrow(closing[task.closing.place(own, far, *_open(data))]))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cell, data, total = None, b"", np.empty(0, np.int64)

    def rows() -> Iterator[pa.RecordBatch]:
        if cell is not None and total.any():
            lo, count, hi = _open(data)
            lo, some = np.repeat(lo, count), total > 0
            yield pa.RecordBatch.from_pydict({"src": np.maximum(lo, hi)[some], "dst": np.minimum(lo, hi)[some], "score": total[some]})

    for batch in batches:
        for part, own, far, later, one in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
            if not later:
                yield from rows()
                cell, data = (part, own, far), one.as_py()
                total = np.zeros(len(_open(data)[2]), np.int64)
            else:
                assert (part, own, far) == cell
                n = one.as_py()
                total += np.frombuffer(n, f"u{n[0]}", offset=1).astype(np.int64)
    yield from rows()


def edge_quadrangles(g: Graph) -> DataFrame:
    """``(src, dst, w, score)``: cycles of four over each edge."""
    pairs = simple_pairs(g)
    both = pairs.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(pairs.select(F.col("dst").alias("u"), F.col("src").alias("v")))
    mid = both.select(F.col("u").alias("x"), F.col("v").alias("m"))
    wedge = mid.join(both.select(F.col("u").alias("m"), F.col("v").alias("y")), "m").filter("x <> y")
    count = wedge.groupBy("x", "y").agg(F.count("*").alias("k")).filter("k > 1")
    # Of the k - 1 other ways from x to y, each closes a cycle over the edge (x, m).
    each = wedge.join(count, ["x", "y"]).groupBy("x", "m").agg(F.sum(F.col("k") - 1).alias("score"))
    found = each.select(F.col("x").alias("src"), F.col("m").alias("dst"), "score").filter("src > dst")
    return g.edges.join(found, ["src", "dst"], "left").select("src", "dst", "w", F.coalesce("score", F.lit(0)).alias("score"))


def transitivity(g: Graph) -> DataFrame:
    """``(score)``: closed over all ordered pairs of neighbours."""
    t = node_triangles(g).agg(F.coalesce(F.sum("triangles"), F.lit(0)).alias("t"))
    d = g.degrees(loops=False).agg(F.sum(F.col("degree") * (F.col("degree") - 1)).alias("p"))
    return t.crossJoin(d).select(F.when(F.col("p") > 0, 2 * F.col("t") / F.col("p")).otherwise(0.0).alias("score"))  # one row each
