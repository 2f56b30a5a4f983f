"""Results of the learned operators and of decontamination against plain Python."""

import itertools
import math
import re
import string

import numpy as np

from weftgraph.llm import crf, subword, template


def test_quality_scores_are_the_mean_of_the_features(spark, docs, rows):
    r = np.random.default_rng(0)
    weights = r.normal(size=subword.BUCKETS + 1).astype(np.float32)
    want = []
    for _, t, *_ in rows:
        at = subword.features([(t or "").encode()])[0]
        z = float(weights[at].sum(dtype=np.float64)) / max(1, len(at)) + float(weights[-1])
        want.append((t or "", round(1 / (1 + math.exp(-z)), 5)))
    got = subword.score(docs.select("doc_id", "text"), weights).collect()
    assert sorted(round(x["score"], 5) for x in got) == sorted(s for _, s in want)


def test_features_are_words_pairs_and_grams():
    text = "ab c ab"
    words, pairs = 3, 2
    padded = f" {text} "
    two = [padded[i : i + 2] for i in range(len(padded) - 1) if padded[i : i + 2].strip()]
    four = [padded[i : i + 4] for i in range(len(padded) - 3) if padded[i + 1] != " "]
    at, owner = subword.features([text.encode(), b"ab"])
    assert (owner == 0).sum() == words + pairs + len(two) + len(four)
    assert set(at[owner == 1]) <= set(at[owner == 0])


def test_toxicity_scores_against_enumeration(spark):
    r = np.random.default_rng(3)
    field = crf.Field(r.normal(size=(len(crf.KINDS), 1 << crf.BITS)), r.normal(size=5), r.normal(size=4))
    texts = ["Stone river, grumble!", "", "one", "a b c d e f"]
    start, t01, t10, t11 = field.rest[1:]
    want = []
    for t in texts:
        h, n = crf.observations([t.encode()])
        z = field.rest[0] + sum(w[row] for w, row in zip(field.weights, crf.buckets(h), strict=True)) if n[0] else np.zeros(0)
        total, on = 0.0, np.zeros(int(n[0]))
        for tags in itertools.product((0, 1), repeat=int(n[0])):
            s = sum(z[i] for i, y in enumerate(tags) if y) + (start if tags and tags[0] else 0)
            s += sum({(0, 1): t01, (1, 0): t10, (1, 1): t11}.get(p, 0.0) for p in itertools.pairwise(tags))
            total += math.exp(s)
            on += np.array(tags, float) * math.exp(s)
        x = crf.document_features(on / total, n)[0] @ field.fold
        want.append(1 / (1 + math.exp(-x)))
    got = crf.tag(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), field).orderBy("doc_id").collect()
    assert np.allclose([x["score"] for x in got], want)


def plain(text):
    """(type or word, word, whether a slot) of each word, by regular expressions."""
    out = []
    for raw in (text or "").split():
        w = raw.strip(string.punctuation)
        if not w:
            continue
        low = w.lower()
        number = w[0].isdigit() or low in template.NUMBERS.split()
        unit = low in template.UNITS.split()
        name = bool(re.match(r"[A-ZÀ-ÖØ-Þ]", w)) and len(w) > 1 and not re.match(r"[A-Z]", w[1]) and low not in template.STARTERS.split()
        kind = "num" if number else "unit" if unit else "name" if name else None
        out.append((f"<{kind}>" if kind else low, low, kind is not None))
    return out


def brute_leaks(docs, items, width=8, literal=4, coverage=0.5):
    found = set()
    for (d, text), (i, item) in itertools.product(docs, items):
        a, b = plain(text), plain(item)
        w = min(width, len(b))
        if not w:
            continue
        hits = {}
        framed = 0
        for p in range(len(b) - w + 1):
            y = b[p : p + w]
            frame = sum(not s for *_, s in y) >= min(literal, w)
            framed += frame
            for q in range(len(a) - w + 1):
                x = a[q : q + w]
                exact, alike = [v for _, v, _ in x] == [v for _, v, _ in y], frame and [t for t, *_ in x] == [t for t, *_ in y]
                if exact or alike:
                    places, frames, pairs = hits.setdefault(q - p, (set(), set(), set()))
                    places.add(p)
                    if alike:
                        frames.add(p)
                        pairs.update((v, u) for (_, u, s), (_, v, z) in zip(x, y, strict=True) if z and s)
                    if exact:
                        pairs.update((v, v) for _, v, z in y if z)
        every, framed_hits = set(), set()
        for places, frames, pairs in hits.values():
            if len({x for x, _ in pairs}) == len(pairs) == len({y for _, y in pairs}):
                every |= places
                framed_hits |= frames
        n = len(b) - w + 1
        if max(len(every) / n, len(framed_hits) / framed if framed else 0) >= coverage:
            found.add((d, i))
    return found


def test_leaks_against_brute_force(spark):
    item = "Anna buys 3 apples and gives Ben 4 pears so how many fruits does Anna hold after Ben returns 4 of the green ones"
    items = [(1, item), (2, "A train leaves at nine and goes 40 km each hour toward Paris before the rain begins there"), (3, "17 times 23"), (4, None), (5, "...")]
    texts = [item, item.upper(), item.lower(), item.replace("Anna", "Maria").replace("4", "9"), item.replace("Anna", "Maria", 1), " ".join(item.split()[:12]), " ".join(item.split()[:11]) + " and so on it goes", "x " * 30 + items[1][1],
             items[1][1].replace("40", "70").replace("Paris", "Rome"), "what is 17 times 23 then", "what is 18 times 23 then", None, "", "stones " * 40]
    docs = list(enumerate(texts))
    got = template.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute_leaks(docs, items)
