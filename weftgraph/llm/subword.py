"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its features, which are words, word pairs
and character n-grams (over code points, within the white-space-padded text), hashed to ``buckets`` rows; a
softmax over the average gives the class. Vectors and softmax weights are trained together by
stochastic gradient descent in numpy on the driver.

Training uses a bounded sample: the ``sample`` labelled doc_ids with the least hash, each with one
row (the text with the least hash, were the doc_id repeated) and whole, those left out that would
bring the features beyond ``most`` (see :func:`within`). Executors turn them into (bucket, weight)
rows, at most ``buckets`` for a document, and only the rows within the bound go to the driver. The
model is a table of ``buckets`` x ``dim`` floats whatever the input's size. As the softmax of two
classes depends on the difference of their scores only, and that is linear in the average, the
table is folded into one float for each bucket (256 KB) before it is broadcast for scoring.

Labels: rows with a null doc_id or label do not count; a doc_id labelled more than once has the
label of the majority, none on a tie. Null texts are empty; an empty text has the class prior's
score. Very long texts are handled whole, one at a time. Without any usable label all scores
are 0.5; with one class only, the score tends to that class. An empty table gives an empty result;
other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import arrow_map, chunks, cut, release, remainder, table, utf8
from weftgraph.llm.vectext import U64, mix, spans

BUCKETS = 1 << 16
GRAMS = (2, 4)


def features(texts: list[bytes], buckets: int = BUCKETS, grams: tuple[int, ...] = GRAMS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every feature and index of its text, texts in order."""
    joined = ("\n".join([" " + t.decode("utf-8", "replace").replace("\n", " ") + " " for t in texts])).encode("utf-32-le")
    data = np.frombuffer(joined, np.uint32)
    owner = np.cumsum(data == 10)
    gap = (data == 32) | (data >= 9) & (data <= 13)
    edge = np.flatnonzero(gap)
    start, end = edge[:-1] + 1, edge[1:]
    full = end > start
    start, end = start[full], end[full]
    words = spans(data, start, end)
    found, of = [words], [owner[start]]
    # A pair of words is hashed by the difference of its hashes, so that all repeated words meet.
    pair = np.flatnonzero(of[0][1:] == of[0][:-1])
    found.append(mix(words[pair + 1] - words[pair] + U64(1)))
    of.append(of[0][pair])
    wide = data.astype(U64)
    for n in grams:
        m = len(data) - n + 1
        if m <= 0:
            continue
        h = np.zeros(m, U64)
        for k in range(n):
            h *= U64(0x9E3779B97F4A7C15)
            h += wide[k : k + m]
        # Not across texts, and not of white space alone.
        fine = owner[:m] == owner[n - 1 :]
        fine &= ~(gap[:m] & gap[n - 1 :]) if n == 2 else ~gap[1 : m + 1]
        at = np.flatnonzero(fine)
        found.append(mix(h[at] + U64(n)))
        of.append(owner[at])
    h, of_ = np.concatenate(found), np.concatenate(of)
    order = np.argsort(of_, kind="stable")
    return (h[order] >> U64(64 - buckets.bit_length() + 1)).astype(np.int64), of_[order]


def labelled(labels: DataFrame, column: str, held: Column, sample: int) -> DataFrame:
    """``(doc_id, label)``: at most ``sample`` training rows, the same ones for the same table."""
    by = labels.filter(~held & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col(column).cast("double")).alias("y"))
    fine = by.filter("y IS NOT NULL AND y <> 0.5").select("doc_id", (F.col("y") > 0.5).cast("int").alias("label"))
    return fine.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def sampled(docs: DataFrame, chosen: DataFrame, key: str, text: str) -> DataFrame:
    """``(doc_id, label, text)``: one row for each chosen doc_id that has any. ``chosen`` is a
    bounded sample, fit to broadcast; of repeated rows each task sends one at most."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), utf8(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def within(seen: DataFrame, most: int) -> DataFrame:
    """Rows ``(doc_id, n, ...)`` of a bounded sample, in the order of a hash of doc_id, as long as
    their sizes n stay under ``most`` in all; what does not fit is passed over for what comes after it."""
    rows = seen.select("doc_id", "n", F.xxhash64("doc_id").alias("h")).collect()
    total, fine = 0, []
    for r in sorted(rows, key=lambda r: (r["h"], r["doc_id"])):
        if total + r["n"] <= most:
            total += r["n"]
            fine.append((r["doc_id"],))
    if len(fine) == len(rows):
        return seen
    return seen.join(F.broadcast(seen.sparkSession.createDataFrame(fine, "doc_id long")), "doc_id", "left_semi")


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], buckets: int = BUCKETS, dim: int = 8, epochs: int = 8, rate: float = 4.0, seed: int = 7) -> np.ndarray:
    """Score difference of the two classes for each bucket, and a bias at the end.

    ``rows``: buckets, how often each occurs, and label of each document."""
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    if rows:
        share = np.clip(np.mean([y for _, _, y in rows]), 0.5 / len(rows), 1 - 0.5 / len(rows))
        bias[:] = np.log([1 - share, share])
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            at, count, y = rows[i]
            if not len(at):
                continue
            at, weight = at.astype(np.int64), (count / count.sum(dtype=np.int64)).astype(np.float32)
            lr = rate * (1 - done / steps)
            done += 1
            v = vectors[at]
            mean = weight @ v
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= lr * 0.1 * np.outer(mean, p)
            bias -= lr * 0.02 * p
            vectors[at] = v - (lr * len(at) ** 0.5) * weight[:, None] * back
    difference = out[:, 1] - out[:, 0]
    return np.append(vectors @ difference, bias[1] - bias[0]).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, column: str, held: Column, sample: int = 6000, most: int = 8_000_000, key: str = "doc_id", text: str = "text", **how) -> np.ndarray:
    """Folded weights from labelled documents outside ``held`` (a condition on doc_id)."""
    joined = sampled(docs, cut(labelled(labels, column, held, sample)), key, text)

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            at, count = [], []
            for t in texts:
                h, _ = features([t])
                b, n = np.unique(h, return_counts=True)
                at.append(b.astype("<u2").tobytes())  # BUCKETS of them
                count.append(np.minimum(n, 65535).astype("<u2").tobytes())
            yield {"doc_id": batch.column(0), "label": batch.column(1), "n": [len(x) // 2 for x in at], "at": at, "count": count}

    seen = cut(arrow_map(joined, kernel, "doc_id long, label int, n long, at binary, count binary"))
    got = within(seen, most).select("doc_id", "label", "at", "count").toArrow().sort_by("doc_id")
    rows = [(np.frombuffer(a.as_buffer(), "<u2"), np.frombuffer(n.as_buffer(), "<u2"), y.as_py()) for y, a, n in zip(got["label"], got["at"], got["count"], strict=True)]
    return train(rows, **how)


def score(docs: DataFrame, weights: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, score)``: the softmax's probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        table_ = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            z = np.zeros(len(texts))
            for a, b in chunks(texts, 1 << 19):
                at, owner = features(texts[a:b], len(table_) - 1)
                n = np.bincount(owner, minlength=b - a)
                z[a:b] = np.bincount(owner, table_[at], b - a) / np.maximum(n, 1)
            yield {"doc_id": batch.column(0), "score": 1 / (1 + np.exp(-(z + table_[-1])))}

    return arrow_map(docs.select(F.col(key).cast("long").alias("doc_id"), utf8(text).alias("text")), kernel, "doc_id long, score double")


def op1_subword(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = fit(docs, labels, "quality", remainder("doc_id", 3) == 1)
    found = score(docs, weights)
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose text scores under 0.5 go. Texts are scored in place, so
    null and repeated doc_ids do not matter."""
    weights = fit(docs, table(spark, sf_dir, "labels"), "quality", remainder("doc_id", 3) == 1)
    shared = spark.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def scored(text):
        import pandas as pd

        table_, z = shared.value, np.zeros(len(text))
        for at_ in range(0, len(text), 1000):
            texts = [(t or "").encode() for t in text[at_ : at_ + 1000]]
            for a, b in chunks(texts, 1 << 17):
                at, owner = features(texts[a:b], len(table_) - 1)
                z[at_ + a : at_ + b] = np.bincount(owner, table_[at], b - a) / np.maximum(np.bincount(owner, minlength=b - a), 1)
        release()
        return pd.Series(1 / (1 + np.exp(-(z + table_[-1]))))

    return docs.filter(scored("text") >= 0.5)
