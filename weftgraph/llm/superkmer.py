"""Exact substring deduplication by super-k-mer partitioning.

A window is ``width`` consecutive words. The minimiser of a window is the least hash of its
``mer``-word pieces; consecutive windows with the same minimiser form a super-k-mer, which travels
as one packed string (its words) to the bucket of that minimiser, so a window costs about three
words of traffic instead of thirteen, and equal windows always meet in one bucket. There windows
are sorted and compared byte for byte, and the least doc_id of each is found. Pieces of short words
are minimisers only where a window has no others, so that common word pairs do not draw all their
windows into one bucket; the number of buckets follows the number of shuffle partitions.

Equal super-k-mers of a task are merged before they travel. Where a task has more than ``inline``
places for one of them, only the least doc_id goes to the bucket; the places wait in rows of their
own, spread evenly, and are joined with the bucket's answer. What a bucket receives for one
passage therefore grows with the number of tasks, not with the number of copies.

Results: words covered by a window that also starts in a document with a smaller doc_id go.
A null text has no words; a row with a null doc_id neither loses words nor makes others lose any.
Rows that repeat a doc_id are one document, though their texts are judged row by row (rows with
the same doc_id are told apart by a 64-bit hash of the text). Texts under ``width`` words keep
all; very long ones are handled whole, one at a time. Bytes that are no UTF-8 are kept as they are
in the windows and replaced in the text of ``dedup_text``. An empty table gives an empty result; other
columns, whatever their names, pass through ``dedup_text`` unchanged.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import arrow_map, chunks, cut, pack, release, slices, table, unpack, utf8
from weftgraph.llm.vectext import Words, mix, rolling, sliding_min

LIGHT, PLACES, ANSWER = 0, 1, 2
SHORT = 4  # bytes
LONGEST = 256  # windows in one packed string; a longer run is cut, which changes no result


def super_kmers(words: Words, width: int, mer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows and minimiser of each super-k-mer."""
    value = rolling(words.hash, mer)
    # Pieces of short words come last, as they are the common ones: no bucket is hot for "of the".
    long_ = np.concatenate(([0], np.cumsum(words.end - words.start > SHORT)))
    common = long_[mer:] == long_[:-mer] if len(value) else np.zeros(0, bool)
    least = sliding_min((value >> np.uint64(1)) | (common.astype(np.uint64) << np.uint64(63)), width - mer + 1)
    n = len(words) - width + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    last = np.repeat(words.first + words.count - width, words.count)[:n]
    at = np.flatnonzero(np.arange(n) <= last)
    if not len(at):
        return at, at, np.zeros(0, np.uint64)
    value = least[at]
    fresh = np.concatenate(([True], (np.diff(at) != 1) | (value[1:] != value[:-1])))
    begin = np.flatnonzero(fresh)
    place = np.arange(len(at)) - np.repeat(begin, np.diff(np.concatenate((begin, [len(at)]))))
    begin = np.flatnonzero(place % LONGEST == 0)
    return at[begin], np.diff(np.concatenate((begin, [len(at)]))), value[begin]


PLACE = np.dtype([("doc", "<i8"), ("tag", "<i8"), ("word", "<i4")])
RANGE = np.dtype([("doc", "<i8"), ("tag", "<i8"), ("start", "<i4"), ("end", "<i4")])


def _columns(a: np.ndarray) -> bytes:
    """Field after field, which compresses better than row after row."""
    return b"".join(np.ascontiguousarray(a[f]).tobytes() for f in a.dtype.names)


def _rows(data: bytes, dtype: np.dtype) -> np.ndarray:
    n = len(data) // dtype.itemsize
    out, at = np.zeros(n, dtype), 0
    for f in dtype.names:
        kind = dtype.fields[f][0]
        out[f] = np.frombuffer(data, kind, n, at)
        at += n * kind.itemsize
    return out


def _send(width: int, mer: int, buckets: int, inline: int, most: int):
    """Map side: ``(bucket, kind, digest, blob)``."""

    def flush(held: dict[bytes, int], seen: list[tuple]) -> Iterator[dict]:
        if not seen:
            return
        texts = list(held)
        index, bucket = np.concatenate([x[0] for x in seen]), np.concatenate([x[2] for x in seen])
        places = np.concatenate([x[1] for x in seen])
        order = np.argsort(index, kind="stable")
        places, begin = places[order], np.searchsorted(index[order], np.arange(len(texts) + 1))
        of, size = bucket[order][begin[:-1]], np.diff(begin)
        least = np.minimum.reduceat(places["doc"], begin[:-1])
        out = []
        by = np.argsort(of, kind="stable")
        cuts = np.flatnonzero(np.concatenate(([True], np.diff(of[by]) != 0, [True])))
        here = np.where(size > inline, 0, size)
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            rows = by[x:y]
            n = here[rows]
            at = np.repeat(begin[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
            packed = pack(b"\n".join([texts[i] for i in rows.tolist()]), least[rows].astype("<i8").tobytes(), n.astype("<i4").tobytes(), _columns(places[at]))
            out.append((int(of[rows[0]]), LIGHT, None, packed))
            if len(out) == 64:
                yield rows_(out)
                out = []
        for i in np.flatnonzero(size > inline).tolist():
            digest = hashlib.blake2b(texts[i], digest_size=16).digest()
            # Any bucket will do: these only pass through.
            for at in range(begin[i], begin[i + 1], 4096):
                some = places[at : min(at + 4096, begin[i + 1])]
                out.append(((int.from_bytes(digest[:4], "little") + int(some["doc"][0])) % buckets, PLACES, digest, pack(_columns(some))))
            if len(out) >= 64:
                yield rows_(out)
                out = []
        if out:
            yield rows_(out)

    def rows_(out: list[tuple]) -> dict:
        b, k, d, x = zip(*out, strict=True)
        return {"bucket": list(b), "kind": list(k), "digest": list(d), "blob": list(x)}

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        held: dict[bytes, int] = {}
        seen: list[tuple] = []
        size = 0
        for batch in slices(batches):
            ids, tags, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for a, b in chunks(texts):
                words = Words(texts[a:b])
                first, windows, value = super_kmers(words, width, mer)
                if not len(first):
                    continue
                owner = words.owner()[first]
                place = np.zeros(len(first), PLACE)
                place["doc"], place["tag"], place["word"] = ids[a + owner], tags[a + owner], first - words.first[owner]
                text, number, before = words.text, held.setdefault, len(held)
                spans_ = zip(words.start[first].tolist(), words.end[first + windows + width - 2].tolist(), strict=True)
                index = np.array([number(text[s:e], len(held)) for s, e in spans_])
                seen.append((index, place, (mix(value) % np.uint64(buckets)).astype(np.int32)))
                size += 30 * len(first) + (len(held) - before) * (150 + len(text) * 3 // len(first))
                if size > most:
                    yield from flush(held, seen)
                    held, seen, size = {}, [], 0
        yield from flush(held, seen)

    return kernel


def _runs(least: np.ndarray, doc: int, width: int) -> list[tuple[int, int]]:
    """Word ranges, from the first window's start, covered by windows with a least below doc."""
    hit = np.flatnonzero(least < doc)
    if not len(hit):
        return []
    gap = np.flatnonzero(np.diff(hit) > width)
    return list(zip(hit[np.concatenate(([0], gap + 1))].tolist(), (hit[np.concatenate((gap, [len(hit) - 1]))] + width).tolist(), strict=True))


def least_docs(words: Words, own: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the windows of packed strings: the string of each, the least doc_id over all equal
    windows, and whether more than one string holds it. ``own``: least doc_id of each string.
    Windows are sorted by hash and compared byte for byte with their neighbours."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    at = np.flatnonzero(np.arange(n) <= np.repeat(words.first + words.count - width, words.count)[:n])
    string = words.owner()[at]
    h = rolling(words.hash, width)[at]
    order = np.argsort(h, kind="stable")
    h = h[order]
    twin = h[1:] == h[:-1]
    within = np.concatenate((twin, [False])) | np.concatenate(([False], twin))
    least, shared = own[string], np.zeros(len(at), bool)
    some = order[within]
    if len(some):
        begin = np.flatnonzero(np.concatenate(([True], h[within][1:] != h[within][:-1])))
        text = words.text
        keys = [text[s:e] for s, e in zip(words.start[at[some]].tolist(), words.end[at[some] + width - 1].tolist(), strict=True)]
        group = np.repeat(np.arange(len(begin)), np.diff(np.concatenate((begin, [len(some)]))))
        odd = [i for i in range(1, len(keys)) if group[i] == group[i - 1] and keys[i] != keys[i - 1]]
        if odd:  # two texts under one hash: order by the bytes themselves
            _, group = np.unique(np.array(keys, object), return_inverse=True)
        low = np.full(group.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, group, least[some])
        least[some], shared[some] = low[group], True
    return string, least, shared


def _count(width: int, inline: int):
    """Bucket side: ``(kind, digest, blob)`` with packed ranges, waiting places and answers."""

    def bucket(blobs: list[bytes]) -> Iterator[tuple[int, bytes | None, bytes]]:
        texts, own, sizes, places = [], [], [], []
        for blob in blobs:
            t, o, s, p = unpack(blob, 4)
            texts.append(t)
            own.append(np.frombuffer(o, "<i8"))
            sizes.append(np.frombuffer(s, "<i4"))
            places.append(_rows(p, PLACE))
        own, sizes, places = np.concatenate(own), np.concatenate(sizes), np.concatenate(places)
        words = Words.normal(b"\n".join(texts))
        texts = words.text.split(b"\n")
        string, least, shared = least_docs(words, own, width)
        begin = np.searchsorted(string, np.arange(len(texts) + 1))
        ends = np.cumsum(sizes)
        some = sizes != 1
        some[string[shared]] = True
        found: list[tuple] = []
        for i in np.flatnonzero(some).tolist():
            own_least = least[begin[i] : begin[i + 1]]
            if sizes[i] == 0:
                yield ANSWER, hashlib.blake2b(texts[i], digest_size=16).digest(), pack(own_least.astype("<i8").tobytes())
                continue
            low, high, n = own_least.min(), own_least.max(), len(own_least) + width - 1
            for doc, tag, word in places[ends[i] - sizes[i] : ends[i]].tolist():
                if high < doc:
                    found.append((doc, tag, word, word + n))
                elif low < doc:
                    found += [(doc, tag, word + s, word + e) for s, e in _runs(own_least, doc, width)]
        if found:
            yield LIGHT, None, pack(_columns(np.array(found, RANGE)))

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        def out(rows: Iterable[tuple]) -> Iterator[dict]:
            rows = list(rows)
            for at in range(0, len(rows), 512):
                k, d, x = zip(*rows[at : at + 512], strict=True)
                yield {"kind": list(k), "digest": list(d), "blob": list(x)}

        rows = (row for batch in slices(batches, 64) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for _, group in itertools.groupby(rows, key=lambda r: r[0]):
            light, passing = [], []
            for _, kind, digest, blob in group:
                if kind == LIGHT:
                    light.append(blob)
                else:
                    passing.append((PLACES, digest, blob))
            yield from out(passing)
            if light:
                yield from out(dict.fromkeys(bucket(light)))

    return kernel


def _ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for blob in batch.column(0):
            r = _rows(unpack(blob.as_py(), 1)[0], RANGE)
            yield {"id": r["doc"], "tag": r["tag"], "start": r["start"], "end": r["end"]}


def _answered(width: int):
    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            found = []
            for places, answer in zip(batch.column(0), batch.column(1), strict=True):
                least = np.frombuffer(unpack(answer.as_py(), 1)[0], "<i8")
                for doc, tag, word in _rows(unpack(places.as_py(), 1)[0], PLACE).tolist():
                    found += [(doc, tag, word + s, word + e) for s, e in _runs(least, doc, width)]
            r = np.array(found, RANGE)
            yield {"id": r["doc"], "tag": r["tag"], "start": r["start"], "end": r["end"]}

    return kernel


RANGES = "id long, tag long, start int, end int"


def repeated_ranges(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 13, mer: int = 2, inline: int = 16) -> DataFrame:
    """``(id, tag, start, end)``: word ranges of a document, which may overlap, covered by windows
    that also start in a document with a smaller id. ``tag``: see :func:`tagged`."""
    counted = _counted(docs, key, text, width, mer, inline)
    light = arrow_map(counted.filter(f"kind = {LIGHT}").select("blob"), _ranges, RANGES)
    # Buckets of several strings may answer for one digest only if the strings are equal: one row.
    answers = counted.filter(f"kind = {ANSWER}").select("digest", F.col("blob").alias("answer")).dropDuplicates(["digest"])
    heavy = counted.filter(f"kind = {PLACES}").select("digest", "blob").join(answers, "digest")
    return light.unionByName(arrow_map(heavy.select("blob", "answer"), _answered(width), RANGES))


def _counted(docs: DataFrame, key: str, text: str, width: int, mer: int, inline: int) -> DataFrame:
    """What the buckets answer. They are dealt out evenly, eight to a task."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = 8 * parts
    rows = tagged(docs, key, text).filter("id IS NOT NULL").select("id", "tag", utf8(text).alias("text"))
    sent = arrow_map(rows, _send(width, mer, buckets, inline, 16 << 20), "bucket int, kind int, digest binary, blob binary")
    placed = sent.repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket")
    return cut(arrow_map(placed, _count(width, inline), "kind int, digest binary, blob binary"))


def tagged(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("id"), text, F.xxhash64(text).alias("tag"))


def kept_words(text: bytes, ranges) -> tuple[list[bytes], int]:
    """The words outside the ranges, and the number of all words."""
    words = text.split()
    if ranges is None or not len(ranges):
        return words, len(words)
    stay = np.ones(len(words), bool)
    for r in ranges:
        stay[r["start"] : r["end"]] = False
    return [w for w, s in zip(words, stay.tolist(), strict=True) if s], len(words)


def squeezed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(id, tag, text)``: UTF-8 texts, each by :func:`pack`."""

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for batch in slices(batches):
            yield {"id": batch.column(0), "tag": batch.column(1), "text": [pack(t) for t in batch.column(2).to_pylist()]}

    return arrow_map(tagged(docs, key, text).select("id", "tag", utf8(text)), kernel, "id long, tag long, text binary")


def with_ranges(docs: DataFrame, found: DataFrame, key: str, text: str, tag: str | None = None) -> DataFrame:
    """``(row, ranges)``: the rows as structs, with what :func:`repeated_ranges` found (or null).
    ``tag``: the column that holds it, where the text no longer is what was tagged."""
    by = found.groupBy(F.struct("id", "tag").alias("of")).agg(F.collect_list(F.struct("start", "end")).alias("ranges")).hint("shuffle_hash")
    left = docs.select(F.struct(F.col(key).cast("long").alias("id"), (F.col(tag) if tag else F.xxhash64(text)).alias("tag")).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = (left["key"]["id"] == by["of"]["id"]) & (left["key"]["tag"] == by["of"]["tag"])
    return left.join(by, same, "left").select("row", "ranges")


def op10_superkmer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            n, gone, sha = [], [], []
            for text, ranges in zip(batch.column(1), batch.column(2), strict=True):
                stay, words = kept_words(unpack(text.as_py(), 1)[0], ranges.as_py())
                n.append(words)
                gone.append(words - len(stay))
                sha.append(hashlib.sha256(b" ".join(stay)).hexdigest())
            yield {"doc_id": batch.column(0), "n_words": n, "n_removed": gone, "kept_sha256": sha}

    # Texts travel to their ranges in compressed form.
    joined = with_ranges(squeezed(docs, "doc_id", "text"), repeated_ranges(docs), "id", "text", "tag")
    return arrow_map(joined.select("row.id", "row.text", "ranges"), kernel, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated passages leave the text; ``n_chars`` follows. A text that loses
    nothing stays as it is, else its kept words are joined by one space."""
    joined = with_ranges(docs, repeated_ranges(docs), "doc_id", "text")

    @F.pandas_udf("string")
    def rest(text, ranges):
        out = text.combine(ranges, lambda t, r: None if t is None else b" ".join(kept_words(t.encode(), r)[0]).decode("utf-8", "replace"))
        release()
        return out

    touched = F.col("ranges").isNotNull()
    changed = joined.withColumn("kept", rest(F.when(touched, F.col("row.text")), "ranges"))  # the other texts do not go through Python
    new = {"text": F.when(touched, F.col("kept")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(touched, F.length("kept").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("row.n_chars"))
    return changed.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


ORACLE = r"""
WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS k
  FROM words, unnest(generate_series(1, len(w) - 12)) AS g(i)
), least AS (SELECT k, min(doc_id) AS m FROM windows GROUP BY k
), hits AS (
  SELECT DISTINCT doc_id, i + j AS p
  FROM windows JOIN least USING (k), unnest(generate_series(0, 12)) AS g(j) WHERE m < doc_id
), gone AS (SELECT doc_id, list(p) AS ps FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN w
    ELSE list_transform(list_filter(list_zip(w, generate_series(1, len(w))), lambda x: NOT list_contains(ps, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM words LEFT JOIN gone USING (doc_id)
"""
