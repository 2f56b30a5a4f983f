"""Benchmark decontamination by template canonicalisation.

Words are lower-cased and stripped of punctuation; numbers, names and units become typed
placeholders, whose values are kept aside as slots. Windows of template words are hash-joined
between documents and benchmark items. Matches on one diagonal (same shift between item and
document) must fill slots consistently: each slot value of the item maps to one value of the
document and back. That finds items whose numbers and names were exchanged, and rejects texts that
share a frame only. A document is contaminated by an item if consistent diagonals cover at least
``coverage`` of the item's windows.

Each window is also compared by its words themselves, lower-cased, which finds copies whose
capitals were lost or added, so that their names are not seen as names; such a match maps each
slot value of the item to itself. A window with fewer than ``literal`` plain words says too little as
a template and is compared in this way only. The coverage of an item is the greater of the shares of
its windows matched as templates, among those that have the plain words, and of all its windows
matched either way. Items under ``width`` words use one window over the whole item; an item without
words matches nothing. Null texts are empty; very long ones are handled whole, one at a time.
Documents are told apart by (doc_id, 64-bit hash of the text), so null and repeated ids do not mix; a
row for each such document and item is returned. Ties do not arise: all items that contaminate a
document are reported. Empty tables give an empty result; other columns, whatever their names, do not
matter and pass through ``drop_leaks`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import arrow_map, chunks, cut, slices, table, utf8
from weftgraph.llm.vectext import Words, rolling, spans, stripped

# Words that stand for numbers, for units, and that often begin a sentence.
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million"
UNITS = (
    "mm cm m km meter meters metre metres inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms "
    "pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours "
    "day days week weeks month months year years cent cents dollar dollars euro euros percent degree degrees"
)
STARTERS = "a an the if in on at of to for and or but when while how what which who why where is are was were there this that these those it he she they we i you"

def _hashes(words: str) -> np.ndarray:
    return np.unique(Words([words.encode()]).hash)


EXACT = np.uint64(0x5851F42D4C957F2D)
SLOT = {"num": np.uint64(1), "name": np.uint64(2), "unit": np.uint64(3)}


class Template:
    """Template words of some texts: ``hash`` (a placeholder's is its type), ``value`` (hash of
    the word), ``slot`` (whether it is a placeholder), and ``first`` and ``count`` by text."""

    def __init__(self, texts: list[bytes]):
        words = Words(texts, hashed=False)
        data = np.frombuffer(words.text, np.uint8)
        n = len(data)
        start, end = stripped(data, words.start, words.end)
        owner = words.owner()
        full = end > start
        start, end, owner = start[full], end[full], owner[full]
        self.count = np.bincount(owner, minlength=len(texts)).astype(np.int64)
        self.first = np.cumsum(self.count) - self.count
        tail = np.append(data, np.zeros(2, np.uint8))
        a, b, c = tail[start], tail[start + 1], tail[start + 2]
        latin = (tail[:n] == 0xC3) & (tail[1 : n + 1] >= 0x80) & (tail[1 : n + 1] <= 0x9E) & (tail[1 : n + 1] != 0x97)
        upper = (data >= 65) & (data <= 90)
        low = data + upper.astype(np.uint8) * 32
        low[1:][latin[:-1]] += 32
        self.value = spans(low, start, end)
        capital = (a >= 65) & (a <= 90)
        wide = (a == 0xC3) & (b >= 0x80) & (b <= 0x9E)
        follow = np.where(wide, c, b)
        shout = (follow >= 65) & (follow <= 90)
        name = (capital | wide) & ~shout & (end - start > 1) & ~np.isin(self.value, _hashes(STARTERS))
        number = (a >= 48) & (a <= 57) | np.isin(self.value, _hashes(NUMBERS))
        unit = np.isin(self.value, _hashes(UNITS))
        self.slot = number | name | unit
        self.hash = np.where(number, SLOT["num"], np.where(unit, SLOT["unit"], np.where(name, SLOT["name"], self.value)))

    def windows(self, width: int, literal: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word and hash of each window within one text, and whether the hash is of the words
        themselves: of all windows that one, and of those with enough plain words the template's."""
        words = rolling(self.value, width) ^ EXACT
        last = np.repeat(self.first + self.count - width, self.count)[: len(words)]
        slots = np.concatenate(([0], np.cumsum(self.slot)))
        plain = width - (slots[width:] - slots[:-width]) if len(words) else np.zeros(0, np.int64)
        inner = np.arange(len(words)) <= last
        at, frame = np.flatnonzero(inner), np.flatnonzero(inner & (plain >= min(literal, width)))
        h = np.concatenate((words[at], rolling(self.hash, width)[frame]))
        return np.concatenate((at, frame)), h, np.arange(len(h)) < len(at)

    def slots(self, at: np.ndarray, width: int, exact: np.ndarray) -> pa.Array:
        """Values of the placeholders of each window, in order; none if ``exact``."""
        at = at[:, None] + np.arange(width)
        filled = self.slot[at] & ~exact[:, None] if at.size else np.zeros(at.shape, bool)
        values = self.value[at][filled].view(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(filled.sum(1)))), pa.int32()), pa.array(values, pa.int64()))


def _item_windows(items: DataFrame, key: str, text: str, width: int, literal: int) -> DataFrame:
    """``(h, width, item_id, place, exact, n, framed, slots)``; n: windows of the item, framed:
    those compared as templates."""

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for item, text_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = Template([text_])
                w = min(width, int(t.count[0]))
                if w == 0:
                    continue
                at, h, exact = t.windows(w, literal)
                n = len(at)
                yield {"h": h.view(np.int64), "width": [w] * n, "item_id": [item] * n, "place": at, "exact": exact, "n": [int(exact.sum())] * n, "framed": [n - int(exact.sum())] * n, "item_slots": t.slots(at, w, exact & False)}

    rows = items.select(F.col(key).cast("long").alias("item_id"), utf8(text).alias("text"))
    return arrow_map(rows, kernel, "h long, width int, item_id long, place int, exact boolean, n int, framed int, item_slots array<long>")


def _text_windows(docs: DataFrame, key: str, text: str, widths: list[int], literal: int, wanted) -> DataFrame:
    """``(h, doc_id, tag, at, slots)`` of the windows whose hash is in the broadcast ``wanted``,
    or of all windows if that is None."""

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        if wanted is not None:
            known = wanted.value
            quick = np.zeros(1 << 20, bool)
            quick[known >> np.uint64(44)] = True
        for batch in slices(batches):
            ids, tags, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            for a, b in chunks(texts, 1 << 18):
                t = Template(texts[a:b])
                owner = np.repeat(np.arange(a, b), t.count)
                for w in widths:
                    at, h, exact = t.windows(w, literal)
                    if wanted is not None:
                        some = np.flatnonzero(quick[h >> np.uint64(44)])
                        some = some[np.isin(h[some], known)]
                        at, h, exact = at[some], h[some], exact[some]
                    for x in range(0, len(at), 100_000):
                        p = at[x : x + 100_000]
                        o = pa.array(owner[p])
                        yield {"h": h[x : x + 100_000].view(np.int64), "doc_id": ids.take(o), "tag": tags.take(o), "at": p - t.first[owner[p] - a], "text_slots": t.slots(p, w, exact[x : x + 100_000])}

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), utf8(text).alias("text"))
    return arrow_map(rows, kernel, "h long, doc_id long, tag long, at int, text_slots array<long>")


def leaks(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    width: int = 8,
    literal: int = 4,
    coverage: float = 0.5,
    most_broadcast: int = 1 << 20,
) -> DataFrame:
    """``(doc_id, tag, item_id, windows, coverage, reparameterised)``.

    The hashes of the items' windows are broadcast to sift the documents' windows if there are at
    most ``most_broadcast`` of them (8 MB); beyond, all windows go to the hash join. The result is
    the same.
    """
    spark = docs.sparkSession
    known = cut(_item_windows(items, item_key, item_text, width, literal))
    widths = sorted(r[0] for r in known.select("width").distinct().collect())  # at most ``width`` rows
    distinct = known.select("h").distinct().limit(most_broadcast + 1)
    wanted = None
    if distinct.count() <= most_broadcast:
        wanted = spark.sparkContext.broadcast(np.sort(distinct.toPandas()["h"].to_numpy(np.int64).view(np.uint64)))
    hits = _text_windows(docs, key, text, widths, literal, wanted).join(known, "h")
    # Words matched as they are stand for themselves.
    pairs = F.arrays_zip(F.col("item_slots").alias("i"), F.when(F.col("exact"), F.col("item_slots")).otherwise(F.col("text_slots")).alias("t"))
    diagonal = hits.groupBy("doc_id", "tag", "item_id", (F.col("at") - F.col("place")).alias("shift"), "width").agg(
        F.collect_set("place").alias("places"),
        F.collect_set(F.when(~F.col("exact"), F.col("place"))).alias("frames"),
        F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"),
        F.max("n").alias("n"),
        F.max("framed").alias("framed"),
    )
    left, right = F.transform("pairs", lambda p: p["i"]), F.transform("pairs", lambda p: p["t"])
    distinct_ = F.size("pairs")
    consistent = (F.size(F.array_distinct(left)) == distinct_) & (F.size(F.array_distinct(right)) == distinct_)
    found = (
        diagonal.filter(consistent)
        .withColumn("changed", F.exists("pairs", lambda p: p["i"] != p["t"]))
        .groupBy("doc_id", "tag", "item_id")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("windows"),
            F.size(F.array_distinct(F.flatten(F.collect_list("frames")))).alias("frames"),
            F.max("n").alias("n"),
            F.max("framed").alias("framed"),
            F.coalesce(F.min(F.when(F.size("frames") > 0, F.col("changed"))), F.lit(False)).alias("reparameterised"),
        )
    )
    share = F.greatest(F.col("windows") / F.col("n"), F.when(F.col("framed") > 0, F.col("frames") / F.col("framed")))
    return found.withColumn("coverage", share).filter(share >= coverage).select("doc_id", "tag", "item_id", "windows", "coverage", "reparameterised")


def op8_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "windows", "coverage", "reparameterised", F.lit(True).alias("contaminated"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents contaminated by a benchmark item go."""
    found = leaks(docs, table(spark, sf_dir, "benchmark")).select(F.struct("doc_id", "tag").alias("key")).distinct()
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"))
    rows = docs.select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = lambda c: rows["key"][c].eqNullSafe(found["key"][c])
    return rows.join(found, same("doc_id") & same("tag"), "left_anti").select("row.*")
