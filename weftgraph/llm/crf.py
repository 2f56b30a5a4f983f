"""Toxicity by a linear-chain conditional random field.

Tokens (lower-cased, stripped of punctuation) have two tags, clean and toxic. The score of a tag
sequence adds weights for the hashed word and for its first five and seven bytes, a bias, and
weights of the tag transitions. Forward-backward gives each token's marginal probability of being
toxic; a document's score is a logistic function of its greatest marginal, of its expected number
of toxic tokens and of its length; tokens with a marginal of 1/2 or more are reported as offsets into the text.

All chains of a batch are one long sequence, whose forward and backward messages are ratios that
a 2 x 2 matrix carries from token to token; a document's first token forgets what came before.
The sequence is cut into rows, matrices are multiplied along all rows at once, rows are chained,
and messages filled in: exact, and vectorised whatever the lengths.

Training tokens: labels are of documents, so a token is labelled toxic if its document is and the
word, or one of its beginnings, is tied to toxic documents beyond chance (log-likelihood ratio
over the logarithm of the number of words seen; what clean documents hold as well is not). The sample is bounded:
the ``sample`` labelled doc_ids with the least hash, each with one row (the text with the least
hash, were the doc_id repeated) and whole, those left out that would bring the tokens beyond
``most`` in total. Weights are trained by numpy (Adagrad) on the driver.

Null texts are empty; an empty text has the score of a text without toxic tokens. Of labels for
one doc_id the majority counts, none on a tie; null labels and null doc_ids do not. Without
labelled rows of both kinds no token is toxic and scores are the share of toxic rows (0.5 with
none at all). Very long texts are handled whole, one at a time. Repeated rows are scored each; empty tables give empty results; other columns do
not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import arrow_map, chunks, cut, remainder, table, utf8
from weftgraph.llm.subword import labelled, sampled, within
from weftgraph.llm.vectext import U64, Words, spans, stripped

BITS = 18
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


KINDS = (1 << 20, 5, 7)  # bytes of a word that a feature takes


def observations(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and of its beginnings (a row for each of KINDS), and the number of words
    of each text."""
    words = Words(texts, lower=True, hashed=False)
    data = np.frombuffer(words.text, np.uint8)
    start, end = stripped(data, words.start, words.end)
    return np.stack([spans(data, start, np.minimum(end, start + k)) for k in KINDS]), words.count


@dataclass
class Field:
    """Weights: of hashed words and beginnings, and (bias, start, clean-toxic, toxic-clean,
    toxic-toxic); clean-clean is 0. ``fold``: intercept and slopes of the document score."""

    weights: np.ndarray  # a row for each of KINDS
    rest: np.ndarray
    fold: np.ndarray

    def marginals(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Probability of the toxic tag for each token. ``at``: bucket numbers, a row for each of
        KINDS."""
        e, first = self.emissions(at, count)
        r, b = messages(e, first, self.rest)
        odds = r * b
        return odds / (1 + odds)

    def emissions(self, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.full(at.shape[1], self.rest[0])
        for w, row in zip(self.weights, at, strict=True):
            z += w[row]
        first = np.zeros(len(z), bool)
        first[(np.cumsum(count) - count)[count > 0]] = True
        return np.exp(np.clip(z, -30, 30)), first


def buckets(h: np.ndarray) -> np.ndarray:
    return (h >> U64(64 - BITS)).astype(np.int64)


def _chain(m: list[np.ndarray], n: int, row: int) -> np.ndarray:
    """Messages r[t] = (a r + b) / (c r + d) along a sequence of matrices [[a, b], [c, d]], given
    as four arrays padded to whole rows; r before the first is 1."""
    a, b, c, d = (x.reshape(-1, row) for x in m)
    p, q, s, t = np.ones(len(a)), np.zeros(len(a)), np.zeros(len(a)), np.ones(len(a))
    for k in range(row):
        ak, bk, ck, dk = a[:, k], b[:, k], c[:, k], d[:, k]
        p, q, s, t = ak * p + bk * s, ak * q + bk * t, ck * p + dk * s, ck * q + dk * t
        if k % 4 == 3:
            scale = 1 / (p + q + s + t)
            p, q, s, t = p * scale, q * scale, s * scale, t * scale
    enter = np.ones(len(a))
    r = 1.0
    for i, (pi, qi, si, ti) in enumerate(zip(p.tolist(), q.tolist(), s.tolist(), t.tolist(), strict=True)):
        enter[i] = r
        r = (pi * r + qi) / (si * r + ti)
    out = np.empty(a.shape)
    r = enter
    for k in range(row):
        r = (a[:, k] * r + b[:, k]) / (c[:, k] * r + d[:, k])
        out[:, k] = r
    return out.ravel()[:n]


def messages(e: np.ndarray, first: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages of each token, as ratios toxic / clean."""
    n = len(e)
    if not n:
        return e, e
    row = 1 << max(3, int(np.log2(n)) // 2 - 1)
    start, t01, t10, t11 = np.exp(rest[1:])
    pad = -n % row

    def padded(x: np.ndarray, fill: float) -> np.ndarray:
        return np.concatenate((x, np.full(pad, fill)))

    r = _chain([padded(np.where(first, 0, t11 * e), 1), padded(np.where(first, start * e, t01 * e), 0), padded(np.where(first, 0, t10), 0), padded(np.ones(n), 1)], n, row)
    # From the last token back: what token t + 1 tells token t; nothing across a document's start.
    f, g = np.append(first[1:], True)[::-1], np.append(e[1:], 1.0)[::-1]
    b = _chain([padded(np.where(f, 0, t11 * g), 1), padded(np.where(f, 1, t10), 0), padded(np.where(f, 0, t01 * g), 0), padded(np.ones(n), 1)], n, row)[::-1]
    return r, b


def tied(word: np.ndarray, owner: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """The hashes that are tied to toxic documents beyond chance."""
    h, at = np.unique(word, return_inverse=True)
    once = np.unique(at.astype(np.int64) * len(toxic) + owner)
    which, doc = once // len(toxic), once % len(toxic)
    one = np.bincount(which, toxic[doc], len(h))
    all_ = np.bincount(which, minlength=len(h)).astype(float)
    base = toxic.mean()

    def part(k: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
        return k * np.log(np.maximum(k, 1e-9) / np.maximum(n * p, 1e-9))

    ratio = part(one, all_, base) + part(all_ - one, all_, 1 - base)
    # Odds of a toxic document given the word: over even, and over twice the odds of any document.
    over = one * (1 - base) > (all_ - one) * max(1 - base, 2 * base)
    return h[(ratio > np.log(max(2, len(h))) + 2) & over]


def train(docs: list[tuple[np.ndarray, int]], rounds: int = 30, rate: float = 0.7, ridge: float = 1e-3) -> Field:
    """``docs``: hashes (a row for each of KINDS) and label."""
    field = Field(np.zeros((len(KINDS), 1 << BITS)), np.array([-4.0, 0.0, 0.0, 0.0, 0.0]), np.zeros(4))
    toxic = np.array([y for _, y in docs], float)
    share = np.clip(toxic.mean(), 0.5 / len(docs), 1 - 0.5 / len(docs)) if docs else 0.5
    field.fold[0] = np.log(share / (1 - share))
    if not 0 < toxic.sum() < len(docs):
        return field
    count = np.array([h.shape[1] for h, _ in docs])
    h = np.concatenate([h for h, _ in docs], 1)
    owner = np.repeat(np.arange(len(docs)), count)
    tag = np.zeros(h.shape[1], bool)
    for row in h:
        tag |= np.isin(row, tied(row, owner, toxic))
    tag &= toxic[owner] > 0
    at = buckets(h).astype(np.int32)
    inner = np.ones(len(tag), bool)
    inner[(np.cumsum(count) - count)[count > 0]] = False
    t = np.flatnonzero(inner)
    now, then = tag[t], tag[t - 1]
    seen = np.array([tag.sum(), tag[~inner].sum(), (~then & now).sum(), (then & ~now).sum(), (then & now).sum()], float)
    used = [np.unique(row, return_inverse=True) for row in at]
    hits = [np.bincount(k, tag, len(u)) for u, k in used]
    # Rare features without a toxic token say nothing that the bias doesn't; they keep weight 0.
    often = [(hit > 0) | (np.bincount(k, minlength=len(u)) >= 5) for (u, k), hit in zip(used, hits, strict=True)]
    field.rest[0] = np.log((tag.sum() + 1) / (len(tag) + 1)) - 2
    squares = [np.full(len(u), 1e-8) for u, _ in used]
    square = np.full(5, 1e-8)
    for _ in range(rounds):
        e, first = field.emissions(at, count)
        r, b = messages(e, first, field.rest)
        p = r * b / (1 + r * b)
        for (u, k), squared, w, hit, some in zip(used, squares, field.weights, hits, often, strict=True):
            g = (hit - np.bincount(k, p, len(u))) * some - ridge * w[u]
            squared += g * g
            w[u] += rate * g / np.sqrt(squared)
        _, t01, t10, t11 = np.exp(field.rest[1:])
        rt, eb = r[t - 1], e[t] * b[t]
        x01, x10, x11 = t01 * eb, rt * t10, rt * t11 * eb
        z = 1 + x01 + x10 + x11
        g = seen - np.array([p.sum(), p[~inner].sum(), (x01 / z).sum(), (x10 / z).sum(), (x11 / z).sum()]) - ridge * field.rest
        square += g * g
        field.rest += 0.3 * rate * g / np.sqrt(square)
    field.fold = logistic(document_features(field.marginals(at, count), count), toxic)
    return field


def document_features(p: np.ndarray, count: np.ndarray) -> np.ndarray:
    """1, the logit of the greatest marginal, and the logarithms of the expected number of toxic
    tokens and of the number of tokens."""
    full = count > 0
    top, total = np.zeros(len(count)), np.zeros(len(count))
    if full.any():
        begin = (np.cumsum(count) - count)[full]
        top[full], total[full] = np.maximum.reduceat(p, begin), np.add.reduceat(p, begin)
    top = np.clip(top, 1e-5, 1 - 1e-5)
    return np.stack((np.ones(len(count)), np.log(top / (1 - top)), np.log(total + 1e-3), np.log1p(count)), 1)


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 40, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def fit(docs: DataFrame, labels: DataFrame, column: str, held: Column, sample: int = 3000, most: int = 1_500_000, key: str = "doc_id", text: str = "text") -> Field:
    joined = sampled(docs, cut(labelled(labels, column, held, sample)), key, text)

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in chunks(texts):
                h, n = observations(texts[a:b])
                ends = np.cumsum(n)
                hashes = [h[:, x:y].tobytes() for x, y in zip(ends - n, ends, strict=True)]
                yield {"doc_id": batch.column(0)[a:b], "label": batch.column(1)[a:b], "n": n, "hashes": hashes}

    seen = cut(arrow_map(joined, kernel, "doc_id long, label int, n long, hashes binary"))
    got = within(seen, most).select("doc_id", "label", "hashes").toArrow().sort_by("doc_id")
    return train([(np.frombuffer(h.as_buffer(), U64).reshape(len(KINDS), -1), y.as_py()) for h, y in zip(got["hashes"], got["label"], strict=True)])


def offsets(text: bytes, which: list[int]) -> list[tuple[int, int]]:
    """Character offsets of the words with the given numbers. A character begins at each byte that
    continues none."""
    data = np.frombuffer(text, np.uint8)
    before = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    spans_ = [(m.start(), m.end()) for m in WORD.finditer(text)]
    return [(int(before[spans_[i][0]]), int(before[spans_[i][1]])) for i in which]


def tag(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, score, offsets)``: offsets of toxic tokens as (start, end) in characters."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        f = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                h, n = observations(texts[a:b])
                p = f.marginals(buckets(h), n)
                z = document_features(p, n) @ f.fold
                found: list[list] = [[] for _ in range(a, b)]
                toxic = np.flatnonzero(p >= 0.5)
                owner = np.repeat(np.arange(b - a), n)[toxic]
                place = toxic - (np.cumsum(n) - n)[owner]
                for i in np.unique(owner).tolist():
                    found[i] = [{"start": x, "end": y} for x, y in offsets(texts[a + i], place[owner == i].tolist())]
                yield {"doc_id": batch.column(0)[a:b], "score": 1 / (1 + np.exp(-z)), "offsets": found}

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), utf8(text).alias("text"))
    return arrow_map(rows, kernel, "doc_id long, score double, offsets array<struct<start:int,end:int>>")


def op7_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = remainder("doc_id", 5) == 0
    found = tag(docs, fit(docs, table(spark, sf_dir, "labels"), "toxic", held))
    return found.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offsets")
