"""Language-model scores from a log-frequency Bloom filter.

Counts of words, word pairs and word triples are quantised on a log scale: a count c has level
1 + floor(log_base(c / least)). The filter holds, for each n-gram, the keys (n-gram, 1) ..
(n-gram, level), and a count is read back by probing (n-gram, 1), (n-gram, 2), ... until one is
missing. A false positive can only raise a level. The filter is cut into segments by the high bits
of the n-gram's hash: each reducer counts and sets the bits of its own segments, and no partial
filters are merged. The number of segments follows the number of shuffle partitions, so that a
segment's n-grams stay as few however many there are in all.

Size: each segment has ``bits_per_key`` bits for each key it holds, so the filter grows with the
distinct n-grams and none is left out. All words are kept, and all pairs and triples seen at least
twice (``LEAST``, at every size): one seen once tells only of the text it stands in, which would
score its own words as known. If the texts are so few that the segments cannot exceed
``most_broadcast`` bytes, these are collected and broadcast. Beyond, the n-grams of packed texts
travel once, to the task of their segments, which counts them, sets the bits, reads the levels of
all n-grams it got and sends these back (``ask``), with the same result.

Probability of a word w after g h, each order interpolated with the one below:
``p1 = (c(w) + 1/2) / (N + (V + 1) / 2)``, ``p2 = k * c(h w) / (f * c(h)) + (1 - k) * p1``, and p3
likewise from c(g h w) and c(g h). f is the share of training tokens, among those whose history has
the level of c(h), whose n-gram is kept; k the share that would still be kept with the token itself
left out. Both come from all training rows, in one pass over the levels of the first. As f is
a mean over histories, probabilities sum to 1 on average over the histories of a level.

The base score needs exact counts: words among the ``head`` most frequent (a bounded table) are
looked up where the text is; the others travel as (hash, row) in packed form and are joined with the counts.
In ``ask`` the counts of words come back along with the levels.

Words are lower-cased (A-Z) and identified by 64-bit hashes. Null texts are empty: one token, the
end. A null doc_id counts as an empty text in the split. Rows that repeat a doc_id are scored each
and all count in training. Very long texts are handled whole, one at a time. Without training rows
all counts are zero. Empty tables give empty results; other columns do not matter.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import arrow_map, chunks, cut, pack, remainder, slices, table, unpack, utf8
from weftgraph.llm.vectext import U64, Words, mix

END, BEGIN = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)
LEVELS = 80
LEAST = np.array([1.0, 2.0, 2.0])
LOW = U64(0xFFFFFFFF)
UNIT = 16 << 20  # bytes of text that travel as one


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with the end after each text, the hash before each token (BEGIN at a text's
    start), and the number of tokens of each text."""
    words = Words(texts, lower=True)
    n = words.count + 1
    out = np.full(int(n.sum()), END, U64)
    inner = np.ones(len(out), bool)
    last = np.cumsum(n) - 1
    inner[last] = False
    out[inner] = words.hash
    before = np.roll(out, 1)
    before[last - n + 1] = BEGIN
    return out, before, n


def pair(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return mix(before * U64(0xD6E8FEB86659FD93) + after)


def triple(before: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Of the word two before each token, and the token's pair. The first of a text has none; its
    hash (of what precedes in the batch) is neither counted nor read."""
    return mix(np.roll(before, 1) * U64(0xA0761D6478BD642F) + pairs + U64(1))


@dataclass
class LogBloom:
    """A log-frequency Bloom filter: segment k is the bytes ``starts[k]:starts[k + 1]``. An n-gram
    is told by its segment and the 32 bits of its hash below."""

    bits: np.ndarray  # uint8
    starts: np.ndarray
    base: float = 1.5
    probes: int = 4

    @staticmethod
    def split(h: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
        """Segment (of a power of two) and the 32 bits below."""
        s = segments.bit_length() - 1
        return (h >> U64(63 - s) >> U64(1)).astype(np.int64) if s else np.zeros(len(h), np.int64), (h >> U64(32 - s)) & LOW

    def level(self, count: np.ndarray, least: float) -> np.ndarray:
        return 1 + np.floor(np.log(np.maximum(count / least, 1)) / np.log(self.base) + 1e-9).astype(np.int64)

    def count(self, level: np.ndarray, least: float) -> np.ndarray:
        """The middle of a level on the log scale; exact for the first."""
        return np.where(level <= 0, 0.0, least * np.where(level == 1, 1.0, self.base ** (level - 0.5)))

    def read(self, part: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Levels by repeated membership probes; 0 for what is not there."""
        levels = np.zeros(len(low), np.int64)
        begin = self.starts[part]
        size = ((self.starts[part + 1] - begin) * 8).astype(U64)
        alive = np.arange(len(low))
        for level in range(1, LEVELS):
            lo, step = keys(low[alive], level)
            for k in range(self.probes):
                at = begin[alive] * 8 + place(lo, step, k, size[alive])
                hit = np.flatnonzero((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
                alive, lo, step = alive[hit], lo[hit], step[hit]
            if not len(alive):
                break
            levels[alive] = level
        return levels

    def segment(self, found: list[tuple[np.ndarray, np.ndarray, float]], bits_per_key: int) -> bytes:
        """Bytes of one segment; ``found``: 32 bits, count and least count of its n-grams."""
        low = np.concatenate([x for x, _, _ in found])
        level = np.concatenate([self.level(n, least) for _, n, least in found])
        size = max(64, -(-int(level.sum()) * bits_per_key // 64) * 64)
        out = np.zeros(size, bool)
        for k in range(1, int(level.max(initial=0)) + 1):
            low, level = low[level >= k], level[level >= k]
            lo, step = keys(low, k)
            for i in range(self.probes):
                out[place(lo, step, i, np.full(len(low), size, U64))] = True
        return np.packbits(out, bitorder="little").tobytes()

    @classmethod
    def joined(cls, segments: int, found: Iterable[tuple[int, bytes]]) -> LogBloom:
        """The filter of some segments; those without n-grams are empty."""
        parts = [bytes(8)] * segments
        for k, data in found:
            parts[k] = data
        return cls(np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]))


def keys(low: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    key = mix(low * U64(0x9E3779B97F4A7C15) + U64(level * 0xD1B54A32D192ED03 % (1 << 64)))
    return key & LOW, key >> U64(32) | U64(1)


def place(lo: np.ndarray, step: np.ndarray, k: int, size: np.ndarray) -> np.ndarray:
    return (((lo + U64(k) * step) & LOW) * size >> U64(32)).astype(np.int64)


def word_counts(rows: DataFrame) -> DataFrame:
    """``(h, c)`` over training rows ``(text)``."""

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        held, counts, size = [], [], 0

        def flush() -> dict:
            h, at = np.unique(np.concatenate(held), return_inverse=True)
            return {"h": h.view(np.int64), "c": np.bincount(at, np.concatenate(counts)).astype(np.int64)}

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in chunks(texts):
                h, n = np.unique(tokens(texts[a:b])[0], return_counts=True)
                held.append(h)
                counts.append(n)
                size += len(h)
                if size > 2_000_000:
                    yield flush()
                    held, counts, size = [], [], 0
        if held:
            yield flush()

    return arrow_map(rows.select("text"), kernel, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def later(n: np.ndarray) -> np.ndarray:
    """Which tokens are not the first of their text."""
    inner = np.ones(int(n.sum()), bool)
    inner[np.cumsum(n) - n] = False
    return inner


def orders(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """Hash of the word, the pair and the triple that end at each token, and tokens by text."""
    after, before, n = tokens(texts)
    pairs = pair(before, after)
    return [after, pairs, triple(before, pairs)], n


def segments_of(rows: DataFrame, segments: int, bits_per_key: int) -> DataFrame:
    """``(part, bits)``: the segments.

    Each task packs its distinct n-grams by segment: 32 bits of hash each, and the counts over 1."""
    s = segments.bit_length() - 1

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        held: list[list[np.ndarray]] = [[], [], []]
        size = 0

        def flush() -> Iterator[dict]:
            for order, arrays in enumerate(held):
                h, n = np.unique(np.concatenate(arrays) >> U64(32 - s), return_counts=True)
                begin = np.searchsorted(h >> U64(32), np.arange(segments + 1, dtype=U64)).tolist()
                low = (h & LOW).astype("<u4")
                out: list[tuple] = []
                for k in range(segments):
                    x, y = begin[k], begin[k + 1]
                    if x == y:
                        continue
                    more = np.flatnonzero(n[x:y] > 1)
                    out.append((k, low[x:y].tobytes(), more.astype("<i4").tobytes() + n[x:y][more].astype("<i4").tobytes()))
                    if len(out) == 256:
                        yield rows_(order, out)
                        out = []
                if out:
                    yield rows_(order, out)
                arrays.clear()

        def rows_(order: int, out: list[tuple]) -> dict:
            k, low, extra = zip(*out, strict=True)
            return {"part": list(k), "order": [order] * len(k), "low": list(low), "extra": list(extra)}

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in chunks(texts):
                hashes, n = orders(texts[a:b])
                for arrays, h in zip(held, (hashes[0], hashes[1], hashes[2][later(n)]), strict=True):
                    arrays.append(h)
                size += len(hashes[0])
                if size > 2_000_000:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        shape = LogBloom(np.zeros(0, np.uint8), np.zeros(1, np.int64))
        rows_ = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for part, group in itertools.groupby(rows_, key=lambda r: r[0]):
            found = []
            for order, blobs in itertools.groupby(group, key=lambda r: r[1]):
                low, n = [], []
                for _, _, x, extra in blobs:
                    low.append(np.frombuffer(x, "<u4"))
                    times = np.ones(len(low[-1]), np.int64)
                    e = np.frombuffer(extra, "<i4").reshape(2, -1)
                    times[e[0]] = e[1]
                    n.append(times)
                h, at = np.unique(np.concatenate(low), return_inverse=True)
                n_ = np.bincount(at, np.concatenate(n)).astype(np.int64)
                some = n_ >= LEAST[order]
                found.append((h[some].astype(U64), n_[some], LEAST[order]))
            yield {"part": [part], "bits": [shape.segment(found, bits_per_key)]}

    sent = arrow_map(rows.select("text"), send, "part int, order int, low binary, extra binary")
    return arrow_map(sent.repartition("part").sortWithinPartitions("part", "order"), count, "part int, bits binary")


@dataclass
class Model:
    """What besides the filter the probabilities need. ``seen``: by order (pairs, triples) and level
    of the history, training tokens in all, of a kept n-gram, of one kept without the token."""

    texts: int
    total: int
    distinct: int
    base: float
    seen: np.ndarray

    def log10(self, levels: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of each token; ``levels`` of the word, pair and triple that end there, texts one after
        another with ``n`` tokens each."""
        shape = LogBloom(np.zeros(0, np.uint8), np.zeros(1, np.int64), self.base)
        past = histories(levels, n)
        p = (shape.count(levels[0], LEAST[0]) + 0.5) / (self.total + 0.5 * (self.distinct + 1))
        for order in (1, 2):
            h = past[order - 1]
            over = shape.count(h, LEAST[order - 1])
            if order == 1:
                over[np.cumsum(n) - n] = self.texts
            all_, kept, still = self.seen[order - 1]
            k, f = (still / np.maximum(all_, 1))[h], (kept / np.maximum(all_, 1))[h]
            share = np.minimum(1.0, shape.count(levels[order], LEAST[order]) / np.maximum(over * f, 1e-9))
            p = k * share + (1 - k) * p
        return np.log10(np.minimum(p, 1.0))


def histories(levels: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Levels of the word before each token, and of the pair before it; the last level stands for
    the beginning of a text."""
    past = np.roll(levels[:2], 1, 1)
    first = np.cumsum(n) - n
    past[0, first], past[1, first] = LEVELS - 1, 0
    return past


def packed(levels: np.ndarray, n: np.ndarray) -> list[bytes]:
    squeeze = zstandard.ZstdCompressor(level=1).compress
    ends = np.cumsum(n)
    small = levels.astype(np.uint8, copy=False)
    return [squeeze(small[:, x:y].tobytes()) for x, y in zip((ends - n).tolist(), ends.tolist(), strict=True)]


def unpacked(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows, levels and numbers of tokens, a few million tokens (or one text) at a time."""
    loose = zstandard.ZstdDecompressor().decompress
    blobs = column.to_pylist()
    for a, b in chunks(blobs, 1 << 18):
        each = [np.frombuffer(loose(x), np.uint8).reshape(3, -1) for x in blobs[a:b]]
        yield a, b, np.concatenate(each, 1).astype(np.int64), np.array([x.shape[1] for x in each])


def seen_levels(levels: DataFrame) -> np.ndarray:
    """``Model.seen`` over training rows ``(levels)``; ``still``: counts of 3 and more, whose level
    is 2 at least."""

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        sums = np.zeros((2, 3, LEVELS), np.int64)
        for batch in batches:
            for _, _, level, n in unpacked(batch.column(0)):
                past = histories(level, n)
                for order in (1, 2):
                    for k in range(3):
                        sums[order - 1, k] += np.bincount(past[order - 1][level[order] >= k], minlength=LEVELS)
        at = np.flatnonzero(sums.ravel())
        yield {"at": at, "n": sums.ravel()[at]}

    out = np.zeros(2 * 3 * LEVELS)
    for at, n in arrow_map(levels, kernel, "at int, n long").groupBy("at").agg(F.sum("n")).collect():  # 480 rows at most
        out[at] = n
    return out.reshape(2, 3, LEVELS)


def score(docs: DataFrame, held: Column, key: str = "doc_id", text: str = "text", bits_per_key: int = 12, head: int = 1 << 17, most_broadcast: int = 1 << 27) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), utf8(text).alias("text"), held.alias("held_out"))
    training = rows.filter(~F.col("held_out"))
    segments = 1 << (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()
    size, texts = training.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count("*")).first()
    # A token is a byte and a gap at least, or an end. For each, words have one key at most, pairs and triples 2/3 (of three that are equal).
    if 7 * ((size + texts) // 2 + texts) * bits_per_key // 24 + 8 * segments > most_broadcast:
        return asked(rows, segments, bits_per_key)
    counts = cut(word_counts(training))
    # Words by count, on a scale of eight steps for each doubling: a few hundred rows.
    scale = counts.groupBy(F.floor(F.log2("c") * 8).alias("step")).agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.min("c").alias("least")).toPandas().sort_values("step", ascending=False)
    total, distinct = int(scale["c"].sum()), int(scale["n"].sum())
    fits = scale[scale["n"].cumsum() <= head]
    least = int(fits["least"].iloc[-1]) if len(fits) else 1 << 62
    often = counts.filter(F.col("c") >= least).toPandas().sort_values("h")
    table_ = spark.sparkContext.broadcast((often["h"].to_numpy(np.int64), often["c"].to_numpy(np.int64)))
    ends = counts.filter(F.col("h") == int(END.view(np.int64))).first()

    built = cut(segments_of(training, segments, bits_per_key))
    bloom = spark.sparkContext.broadcast(LogBloom.joined(segments, built.select("part", "bits").toLocalIterator()))

    def result(ids, helds, hashes: list[np.ndarray], n: np.ndarray, levels: np.ndarray) -> dict:
        h_, c_ = table_.value
        first, signed = np.cumsum(n) - n, hashes[0].view(np.int64)
        at = np.minimum(np.searchsorted(h_, signed), max(0, len(h_) - 1))
        hit = h_[at] == signed if len(h_) else np.zeros(len(signed), bool)
        logs = np.where(hit, np.log10((c_[at] if len(h_) else 0) + 0.5), 0.0)
        rare = np.flatnonzero(~hit)
        begin = np.searchsorted(rare, np.append(first, len(signed)))
        return {
            "doc_id": ids, "held_out": helds, "n_tokens": n, "known": np.add.reduceat(hit.astype(np.int64), first), "logs": np.add.reduceat(logs, first),
            "levels": packed(levels, n), "rare": pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(signed[rare])),
        }

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        shape = bloom.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                hashes, n = orders(texts[a:b])
                words, at = np.unique(hashes[0], return_inverse=True)
                levels = np.stack([shape.read(*shape.split(words, segments))[at], *(shape.read(*shape.split(h, segments)) for h in hashes[1:])])
                levels[2][~later(n)] = 0
                yield result(batch.column(0)[a:b], batch.column(2)[a:b], hashes, n, levels)

    schema = "doc_id long, held_out boolean, n_tokens long, known long, logs double, levels binary, rare array<long>"
    scored = cut(arrow_map(rows, kernel, schema).withColumn("row", F.monotonically_increasing_id()))
    seen = seen_levels(scored.filter(~F.col("held_out")).select("levels"))
    return finish(scored, counts, Model(ends["c"] if ends else 0, total, distinct, 1.5, seen))


def asked(rows: DataFrame, segments: int, bits_per_key: int) -> DataFrame:
    """:func:`score` by :func:`ask`."""
    scored = cut(ask(rows, segments, bits_per_key).withColumn("row", F.lit(0).cast("long")))
    training = scored.filter(~F.col("held_out"))
    texts, total = training.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    distinct = scored.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    return finish(scored, None, Model(texts, total, distinct, 1.5, seen_levels(training.select("levels"))))


def planes(x: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` low bytes of each number: all lowest, all second, ..., as they compress best."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)


def unplaned(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


WIDTH = (8, 5, 5)  # bytes of an n-gram's hash within its group of segments; words are told by all bits


def ask(rows: DataFrame, segments: int, bits_per_key: int) -> DataFrame:
    """Texts are packed into units; of each, the distinct n-grams and their counts (zero in units of
    held-out texts) go to the tasks of their segments as differences, four segments to a task. Such a
    task counts, builds the segments, reads the levels from them and sends these and the counts of
    words back to the units. ``words`` adds up to the distinct words of training: a group tells its
    own to one unit, and a unit to its first text."""
    groups = segments // 4  # segments: a power of two, 4 at least
    s, g = segments.bit_length() - 1, segments.bit_length() - 3
    cover = U64((1 << 34) - 1)  # of a hash in its group: segment and 32 bits

    def unit(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        number = TaskContext.get().partitionId() << 32
        held: dict[bool, tuple[list, list]] = {False: ([], []), True: ([], [])}
        sizes = {False: 0, True: 0}

        def flush(flag: bool) -> dict:
            ids, texts = held[flag]
            blob = pack(np.array([len(t) for t in texts], "<i8").tobytes(), b"".join(texts), level=6)
            held[flag], sizes[flag] = ([], []), 0
            return {"unit": [number], "held": [flag], "ids": [ids], "texts": [blob]}

        for batch in slices(batches):
            for key, text, flag in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sizes[flag] and sizes[flag] + len(text) > UNIT:
                    yield flush(flag)
                    number += 1
                held[flag][0].append(key)
                held[flag][1].append(text)
                sizes[flag] += len(text) + 1
        for flag in held:
            if sizes[flag]:
                yield flush(flag)
                number += 1

    def grams(blob: bytes) -> tuple[list[np.ndarray], np.ndarray]:
        """Words, pairs and triples of a unit, the latter two by segment and 32 bits, and tokens by text."""
        sizes, data = unpack(blob, 2)
        ends = np.cumsum(np.frombuffer(sizes, "<i8")).tolist()
        texts = [data[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)]
        each = [orders(texts[a:b]) for a, b in chunks(texts)]
        hashes, n = [np.concatenate([h[k] for h, _ in each]) for k in range(3)], np.concatenate([n for _, n in each])
        del each
        return [hashes[0], hashes[1] >> U64(32 - s), hashes[2][later(n)] >> U64(32 - s)], n

    def question(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for number, flag, blob in zip(*batch.columns, strict=True):
                shown: list[tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]] = []
                hashes = grams(blob.as_py())[0]
                for order in range(3):
                    h, n = np.unique(hashes.pop(0), return_counts=True)
                    group = (h >> U64(63 - g) >> U64(1)) if order == 0 else h >> U64(34)
                    begin = np.searchsorted(group, np.arange(groups + 1, dtype=U64))
                    step = np.diff(h, prepend=U64(0))
                    first = begin[:-1][begin[:-1] < begin[1:]]
                    step[first] = h[first] if order == 0 else h[first] & cover
                    n = np.zeros(len(n), np.int32) if flag.as_py() else n.astype(np.int32)
                    shown.append((planes(step, WIDTH[order]), np.minimum(n, 255).astype(np.uint8), n, begin.tolist()))
                out = []
                for k in range(groups):
                    spans = [(x[3][k], x[3][k + 1]) for x in shown]
                    if any(x < y for x, y in spans):
                        parts = [(p[:, x:y].tobytes(), few[x:y], n[x:y]) for (p, few, n, _), (x, y) in zip(shown, spans, strict=True)]
                        many = np.concatenate([n[few == 255] for _, few, n in parts]).astype("<i8")
                        out.append((k, pack(*(p for p, _, _ in parts), *(few.tobytes() for _, few, _ in parts), many.tobytes())))
                    if len(out) == 256 or k == groups - 1 and out:
                        yield {"unit": [number.as_py()] * len(out), "group": [x for x, _ in out], "data": [x for _, x in out]}
                        out = []

    def count(h: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, at = np.unique(np.concatenate(h), return_inverse=True)
        return h, np.bincount(at, np.concatenate(n), len(h)).astype(np.int64), at

    def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        shape = LogBloom(np.zeros(0, np.uint8), np.zeros(1, np.int64))
        rows_ = (r for batch in slices(batches, 64) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for group, some in itertools.groupby(rows_, key=lambda r: r[0]):
            units, hashes, times = [], ([], [], []), ([], [], [])
            for _, number, blob in some:
                units.append(number)
                data = unpack(blob, 7)
                many = np.frombuffer(data[6], "<i8")
                for order in range(3):
                    hashes[order].append(np.cumsum(unplaned(data[order], WIDTH[order]), dtype=U64))
                    n = np.frombuffer(data[3 + order], np.uint8).astype(np.int64)
                    over = np.flatnonzero(n == 255)
                    n[over], many = many[: len(over)], many[len(over) :]
                    times[order].append(n)
            sizes = [[len(x) for x in h] for h in hashes]
            words, exact, at = count(hashes[0], times[0])
            counts = exact[at]
            # Words whose first bits are equal are one to the filter.
            first = words >> U64(32 - s) & cover
            fresh = np.diff(first, prepend=~U64(0)) != 0
            found = [(first[fresh], np.add.reduceat(exact, np.flatnonzero(fresh)) if len(exact) else exact, (np.cumsum(fresh) - 1)[at])]
            for order in (1, 2):
                found.append(count(hashes[order], times[order]))
                hashes[order].clear()
            segment = []
            for k in range(4):
                each = []
                for (h, n, _), least in zip(found, LEAST, strict=True):
                    x, y = np.searchsorted(h, np.array([k << 32, k + 1 << 32], U64)).tolist()
                    kept = n[x:y] >= least
                    each.append((h[x:y][kept] & LOW, n[x:y][kept], least))
                segment.append((k, shape.segment(each, bits_per_key)))
            bloom = LogBloom.joined(4, segment)
            levels = []
            for h, _, at in found:
                part = (h >> U64(32)).astype(np.int64)
                read = [bloom.read(part[x : x + (1 << 17)], h[x : x + (1 << 17)] & LOW) for x in range(0, len(h), 1 << 17)]
                levels.append(np.concatenate([*read, np.zeros(0, np.int64)]).astype(np.uint8)[at])
            ends = [np.cumsum([0, *x]).tolist() for x in sizes]
            for i, number in enumerate(units):
                back = [level[e[i] : e[i + 1]].tobytes() for level, e in zip(levels, ends, strict=True)]
                data = pack(*back, planes(counts[ends[0][i] : ends[0][i + 1]], 8).tobytes())
                yield {"unit": [number], "group": [group], "data": [data], "words": [0 if i else np.count_nonzero(exact)]}

    def finished(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        rows_ = (r for batch in slices(batches, 64) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for _, some in itertools.groupby(rows_, key=lambda r: r[0]):
            _, _, flag, ids, blob, *_ = next(some)
            some = list(some)
            hashes, n = grams(blob)
            back = [unpack(r[5], 4) for r in some]
            counts = np.concatenate([unplaned(x[3], 8) for x in back]).astype(np.int64)
            levels = np.zeros((3, int(n.sum())), np.uint8)
            for order in range(3):
                at = np.unique(hashes.pop(0), return_inverse=True)[1]
                level = np.frombuffer(b"".join([x[order] for x in back]), np.uint8)
                if order == 0:
                    c = counts[at]
                levels[order][later(n) if order == 2 else slice(None)] = level[at]
            first = np.cumsum(n) - n
            yield {
                "doc_id": ids, "held_out": [flag] * len(ids), "n_tokens": n, "known": np.add.reduceat((c > 0).astype(np.int64), first),
                "logs": np.add.reduceat(np.log10(c + 0.5), first), "levels": packed(levels, n), "words": [sum(r[6] for r in some), *[0] * (len(ids) - 1)],
            }

    units = cut(arrow_map(rows.select("doc_id", "text", "held_out"), unit, "unit long, held boolean, ids array<long>, texts binary"))
    sent = arrow_map(units.select("unit", "held", "texts"), question, "unit long, group int, data binary")
    dealt = sent.repartitionById(groups, "group").select("group", "unit", "data").sortWithinPartitions("group", "unit")
    answers = arrow_map(dealt, answer, "unit long, group int, data binary, words long")
    void = units.select("unit", F.lit(-1).alias("group"), "held", "ids", "texts", F.lit(None).cast("binary").alias("data"), F.lit(0).cast("long").alias("words"))
    both = void.unionByName(answers, allowMissingColumns=True)
    schema = "doc_id long, held_out boolean, n_tokens long, known long, logs double, levels binary, words long"
    return arrow_map(both.repartition("unit").sortWithinPartitions("unit", "group"), finished, schema)


def finish(scored: DataFrame, counts: DataFrame | None, model: Model) -> DataFrame:
    """The scores from the levels, and the exact counts of the rare words: each is joined with its
    count and summed up by row. Without ``counts`` no word is left to join."""

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for a, b, level, n in unpacked(batch.column(5)):
                yield {k: batch.column(i)[a:b] for i, k in enumerate(("row", "doc_id", "held_out", "known", "logs"))} | {"n_tokens": n, "score": np.add.reduceat(model.log10(level, n), np.cumsum(n) - n)}

    out = arrow_map(scored.select("row", "doc_id", "held_out", "known", "logs", "levels"), kernel, "row long, doc_id long, held_out boolean, known long, logs double, n_tokens long, score double")
    floor = model.total + 0.5 * (model.distinct + 1)
    base = F.col("logs") - F.col("n_tokens") * F.lit(float(np.log10(floor)))
    known = F.col("known")
    if counts is not None:
        rare = scored.select("row", F.explode("rare").alias("h"))
        met = rare.join(counts, "h", "left").groupBy("row").agg(F.count("c").alias("more"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))).alias("rest"))
        out = out.join(met, "row", "left")
        base, known = base + F.coalesce("rest", F.lit(0.0)), known + F.coalesce("more", F.lit(0))
    return out.select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op2_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), remainder("doc_id", 5) == 1)
