"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints (64 bits over word shingles) that differ in at most ``distance`` bits are linked, and
linked fingerprints form groups. The plan:

1. one fingerprint for each document; copies collapse into one row for each distinct fingerprint;
2. *exact partitioning*: the bits are cut into ``blocks`` pieces. Two fingerprints within
   ``distance`` bits agree on at least ``blocks - distance`` whole pieces, so a row is sent out
   once for each choice of that many pieces, keyed by the mask and the bits under it. A pair
   within reach meets under at least one key, and no pair is ever made outside a key;
3. in a key's group, fingerprints are sorted by Gray rank, runs of neighbours are folded into
   nodes that hold the bits all of them share, and the tree is joined with itself from the top:
   a pair of nodes goes on only while the differences in their shared bits do not exceed the
   limit, so whole groups are pruned at once. Links leave as a spanning forest (linear);
4. a group over ``limit`` rows (dense clusters of near copies) is not joined as it is: its rows
   are sent out anew under longer masks, until the groups are small. That is exact too, and ends,
   as the last masks leave but ``distance`` bits free;
5. components of the forest by alternating star steps, all distributed.

Null texts count as empty; texts without words have fingerprint zero and are linked like any
other. Repeated rows keep their rows and share a component. An empty table gives an empty result.
Other columns of the input are ignored, so their names cannot clash.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import arrow_map, cut, table, tags, utf8
from weftgraph.operators.stars import star_components

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
FAN = 8


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """SimHash of a text's lower-cased (A-Z) word shingles by XXH64; 0 without words."""
    norm = b" ".join(text.lower().split())
    if not norm:
        return 0
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    digest = xxhash.xxh64_intdigest
    if len(gaps) + 1 <= width:
        h = np.array([digest(norm, seed)], np.uint64)
    else:
        start = [0, *(gaps + 1).tolist()]
        end = [*gaps.tolist(), len(norm)]
        h = np.array([digest(norm[s:e], seed) for s, e in zip(start, end[width - 1 :], strict=False)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # a very long text is unpacked piecewise
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, t1, t2, fp)``, the fingerprint as a signed long and 128 bits of the text; one row
    for each input row."""

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            found = [fingerprint(t.as_py(), width, seed) for t in batch.column(3)]
            yield {"doc_id": batch.column(0), "t1": batch.column(1), "t2": batch.column(2), "fp": np.array(found, np.uint64).view(np.int64)}

    return arrow_map(docs.select(F.col(key).cast("long").alias("doc_id"), *tags(text), utf8(text).alias("text")), kernel, "doc_id long, t1 long, t2 long, fp long")


def block_masks(free: int, blocks: int, distance: int) -> list[int]:
    """Masks over the set bits of ``free``, cut into ``blocks`` pieces, one for each choice of
    ``blocks - distance`` pieces."""
    bits = [b for b in range(64) if free >> b & 1]
    blocks = min(blocks, len(bits))
    edges = [len(bits) * i // blocks for i in range(blocks + 1)] if blocks else [0]
    pieces = [sum(1 << b for b in bits[x:y]) for x, y in itertools.pairwise(edges)]
    return [sum(c) for c in itertools.combinations(pieces, max(0, blocks - distance))]


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def gray_join(run: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions ``(i, j)`` of all pairs in a run that differ in at most ``distance`` bits, found
    by joining the hierarchical index of each run with itself, all runs at once. ``run`` is
    sorted and ``fp`` is sorted by Gray rank within each run."""
    levels = []  # from the leaves up: pattern, mask, run, first child
    pattern, mask, owner, first = fp, np.full(len(fp), ONES), run, None
    while True:
        levels.append((pattern, mask, owner, first))
        begins = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        size = np.diff(np.concatenate((begins, [len(owner)])))
        if size.max() == 1:
            break
        place = np.arange(len(owner)) - np.repeat(begins, size)
        first = np.flatnonzero(place % FAN == 0)
        count = np.diff(np.concatenate((first, [len(owner)])))
        head = pattern[first]
        differ = np.bitwise_or.reduceat(pattern ^ np.repeat(head, count), first)
        shared = np.bitwise_and.reduceat(mask, first) & ~differ
        pattern, mask, owner = head & shared, shared, owner[first]
    a = b = np.arange(len(levels[-1][0]))
    for depth in range(len(levels) - 1, 0, -1):
        starts = levels[depth][3]
        below = levels[depth - 1]
        ends = np.concatenate((starts[1:], [len(below[0])]))
        na, nb = ends[a] - starts[a], ends[b] - starts[b]
        each = na * nb
        pair = np.repeat(np.arange(len(a)), each)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(each) - each, each)
        ca, cb = starts[a][pair] + k // nb[pair], starts[b][pair] + k % nb[pair]
        keep = ca <= cb
        ca, cb = ca[keep], cb[keep]
        apart = np.bitwise_count((below[0][ca] ^ below[0][cb]) & below[1][ca] & below[1][cb])
        keep = apart <= distance
        a, b = ca[keep], cb[keep]
    apart = a != b
    return a[apart], b[apart]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least position linked with each of ``n`` positions, directly or not."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _meet(keyed: DataFrame, distance: int, limit: int, work: int = 1 << 22) -> DataFrame:
    """``(mask, a, b)``: a link between fingerprints a and b, or, for a group over ``limit`` rows,
    a row with a null b for each of its fingerprints."""

    def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, tuple[int, int] | None]]:
        """Whole groups, as many at a time as ``work`` allows; of a large one, pieces. With each,
        the mask and bits of the group that was cut last, whose rows all count as too many."""
        mask, fp, torn = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                mask = np.concatenate((mask, batch.column(0).to_numpy()))
                fp = np.concatenate((fp, batch.column(1).to_numpy()))
            if not len(mask):
                continue
            group = mask & fp
            begins = np.flatnonzero(np.concatenate(([True], (mask[1:] != mask[:-1]) | (group[1:] != group[:-1]))))
            whole = begins[-1] if batch is not None else len(mask)
            if whole > work // 64 or batch is None or whole == 0 and len(mask) > work:
                if not whole:
                    whole, torn = len(mask), (int(mask[0]), int(group[0]))
                yield mask[:whole], fp[:whole], torn
                mask, fp = mask[whole:], fp[whole:]

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for mask, fp, torn in runs(batches):
            group = mask & fp
            begins = np.flatnonzero(np.concatenate(([True], (mask[1:] != mask[:-1]) | (group[1:] != group[:-1]))))
            size = np.diff(np.concatenate((begins, [len(mask)])))
            large = size > limit
            if torn is not None:
                large |= (mask[begins] == torn[0]) & (group[begins] == torn[1])
            over = np.repeat(large, size)
            if over.any():
                yield {"mask": mask[over], "a": fp[over], "b": pa.nulls(int(over.sum()), pa.int64())}
            some = np.repeat((size > 1) & ~large, size)
            run = np.repeat(np.arange(len(size)), size)[some]
            m, x = mask[some], fp[some].view(np.uint64)
            order = np.lexsort((gray_rank(x), run))
            run, x, m = run[order], x[order], m[order]
            # No more than ``work`` pairs at once, were no pair pruned.
            cost = np.bincount(run, minlength=len(size)).astype(np.int64) ** 2
            part = np.cumsum(cost)[run] // work if len(run) else run
            for k in np.unique(part):
                at = np.flatnonzero(part == k)
                r, f = run[at], x[at]
                root = forest(len(f), *gray_join(r, f, distance))
                child = np.flatnonzero(root != np.arange(len(f)))
                if len(child):
                    yield {"mask": m[at][child], "a": f[child].view(np.int64), "b": f[root[child]].view(np.int64)}

    placed = keyed.repartition("mask", "part").sortWithinPartitions("mask", "part").select("mask", "fp")
    return arrow_map(placed, kernel, "mask long, a long, b long")


def links(distinct: DataFrame, distance: int = 3, blocks: int = 5, limit: int = 2048, work: int = 1 << 22) -> DataFrame:
    """``(a, b)``: a spanning forest, key by key, of the pairs of distinct fingerprints ``fp``
    that differ in at most ``distance`` bits. ``blocks`` must exceed ``distance``."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    fan = F.array(*[F.lit(signed(m)).cast("long") for m in block_masks((1 << 64) - 1, blocks, distance)])
    rows = distinct.select("fp", F.explode(fan).alias("mask"))
    found = None
    while True:
        met = cut(_meet(rows.withColumn("part", F.col("mask").bitwiseAND(F.col("fp"))), distance, limit, work))
        new = met.filter("b IS NOT NULL").select("a", "b")
        found = new if found is None else found.unionByName(new)
        over = met.filter("b IS NULL").select("mask", F.col("a").alias("fp"))
        if not over.limit(1).count():
            return found
        rows = arrow_map(over, _longer(distance), "mask long, fp long").distinct()


def _longer(distance: int):
    """For rows of a group that was too large: the same fingerprints under longer masks."""

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        longer: dict[int, np.ndarray] = {}
        for batch in batches:
            mask, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for m in np.unique(mask).tolist():
                if m not in longer:
                    free = ~m & ((1 << 64) - 1)
                    blocks = 8 if free.bit_count() > 24 else free.bit_count()
                    longer[m] = np.array([(m | x) & ((1 << 64) - 1) for x in block_masks(free, blocks, distance)], np.uint64).view(np.int64)
                some = fp[mask == m]
                for at in range(0, len(some), 256):
                    part = some[at : at + 256]
                    yield {"mask": np.tile(longer[m], len(part)), "fp": np.repeat(part, len(longer[m]))}

    return kernel


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, distance: int = 3) -> DataFrame:
    """``(doc_id, t1, t2, fp, root, component_id)``: every row with the least doc_id reachable over
    links; ``root`` names its group, also where no row of it has a doc_id."""
    marked = cut(fingerprints(docs, key, text, width))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts = star_components(links(distinct.select("fp"), distance), "a", "b")
    linked = cut(distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp")))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(linked.join(least, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "t1", "t2", "fp", "root", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates one row stays, that with the least doc_id
    (rows without one come last), then with the least hash of the text. Rows are told apart by
    doc_id and 128 bits of the text, so a row of other words under a repeated doc_id is judged by
    itself; of rows that repeat both one stays. All texts without words are one group."""
    found = near_duplicates(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")).alias("first")
    stay = found.groupBy("root").agg(first).select(F.struct("first.doc_id", "first.t1", "first.t2").alias("key"))
    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), *tags("text")).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = lambda c: rows["key"][c].eqNullSafe(stay["key"][c])
    kept = rows.join(stay.hint("shuffle_hash"), same("doc_id") & same("t1") & same("t2"), "left_semi")
    return kept.dropDuplicates(["key"]).select("row.*")
