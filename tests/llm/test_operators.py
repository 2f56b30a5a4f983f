"""The training-data operators against brute force on a small, odd table."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from weftgraph.llm import crf, media, mixing, ngram, simhash, sitetree, subword, superkmer, template, viterbi
from weftgraph.llm.vectext import Words, rolling, sliding_min


def split(text):
    return (text or "").encode().split()


# --- helpers ---


def test_words_are_split_and_hashed_alike():
    w = Words([b"a bb  a", b"", b"bb\tc\n"])
    assert w.count.tolist() == [3, 0, 2] and len(set(w.hash.tolist())) == 3
    assert w.hash[0] == w.hash[2] and w.hash[1] == w.hash[3]
    n = Words.normal(b"a bb a\nbb c")
    assert n.count.tolist() == [3, 2] and (n.hash == w.hash).all()


def test_sliding_min_and_rolling():
    r = np.random.default_rng(1)
    x = r.integers(0, 1 << 60, 50).astype(np.uint64)
    for width in (1, 2, 5, 12, 50, 51):
        assert sliding_min(x, width).tolist() == [x[i : i + width].min() for i in range(len(x) - width + 1)]
    assert rolling(np.tile(x[:5], 2), 3)[0] == rolling(np.tile(x[:5], 2), 3)[5]


# --- 1 quality ---


def test_quality_learns_from_training_labels_only(spark, tmp_path):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(300):
        good = r.random() < 0.7
        words = [r.choice(["stone", "river", "garden", "window"]) for _ in range(40)]
        rows.append((i, " ".join(words if good else [w.upper() + "!!" for w in words])))
        held = zlib.crc32(str(i).encode()) % 3 == 1
        labels.append((i, int(good != held)))  # held-out labels are wrong, so must not be learned
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in subword.op1_subword(spark, str(tmp_path)).collect()}
    assert len(got) == 300
    for i, (_, text) in enumerate(rows):
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert got[i]["predicted"] == int("!!" not in text) == int(got[i]["score"] >= 0.5)


def test_quality_takes_odd_rows(spark, folder, docs, nothing):
    got = subword.op1_subword(spark, folder).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert subword.score(nothing, np.zeros(subword.BUCKETS + 1, np.float32)).count() == 0
    assert subword.train([])[-1] == 0


# --- 2 language model ---


def test_base_scores_are_exact_and_small_head_changes_nothing(spark, docs, rows):
    held = ngram.remainder("doc_id", 5) == 1
    key = lambda i: "" if i is None else str(i)
    tokens = [[*(w for w in (t or "").encode().lower().split()), None] for _, t, *_ in rows]
    train = [t for t, r in zip(tokens, rows, strict=True) if zlib.crc32(key(r[0]).encode()) % 5 != 1]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((r[0] is None, r[0] or 0, len(t), sum(c[w] > 0 for w in t), round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for t, r in zip(tokens, rows, strict=True))
    scores = []
    for head, most in ((1 << 17, 1 << 27), (0, 1 << 27), (7, 0)):
        got = ngram.score(docs, held, head=head, most_broadcast=most).collect()
        assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
        scores.append(sorted(round(r["score"], 6) for r in got))
    assert scores[0] == scores[1] == scores[2]


def test_log_bloom_reads_levels_back():
    r = np.random.default_rng(2)
    low = np.unique(r.integers(0, 1 << 32, 2000)).astype(np.uint64)
    count, part = r.integers(1, 1000, len(low)), r.integers(0, 4, len(low))
    b = ngram.LogBloom(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    b = ngram.LogBloom.joined(8, [(k, b.segment([(low[part == k], count[part == k], 1.0)], 12)) for k in range(4)])
    got = b.read(part, low)
    assert (got >= b.level(count, 1.0)).all() and (got == b.level(count, 1.0)).mean() > 0.98
    assert (b.read(part, low ^ np.uint64(1)) > 0).mean() < 0.05 and not b.read(part + 4, low).any()


def test_language_model_scores_against_brute_force(spark, docs, rows):
    """Exact counts in place of the filter: scores differ by the quantisation at most."""
    key = lambda i: "" if i is None else str(i)
    tokens = [[*(w for w in (t or "").encode().lower().split()), None] for _, t, *_ in rows]
    train = [t for t, r in zip(tokens, rows, strict=True) if zlib.crc32(key(r[0]).encode()) % 5 != 1]
    c = Counter(tuple(t[i : i + k]) for t in train for k in (1, 2, 3) for i in range(len(t) - k + 1))
    c.update(("", *t[:k]) for t in train for k in range(min(3, len(t) + 1)))  # with the beginning
    n, v = sum(c[g] for g in c if len(g) == 1 and g != ("",)), sum(len(g) == 1 and g != ("",) for g in c)

    def level(gram):
        least = 1 if len(gram) == 1 else 2
        return 0 if c[gram] < least else 1 + math.floor(math.log(c[gram] / least) / math.log(1.5) + 1e-9)

    def value(gram):
        k = level(gram)
        return 0.0 if not k else (1 if len(gram) == 1 else 2) * (1.0 if k == 1 else 1.5 ** (k - 0.5))

    def steps(t):
        """Of each token: its n-grams of two and three with the levels of what precedes."""
        for i in range(len(t)):
            two = (t[i - 1], t[i]) if i else ("", t[i])
            three = None if not i else (t[i - 2], *two) if i > 1 else ("", *two)
            yield (t[i],), two, ("begin" if not i else level(two[:1])), three, (level(three[:2]) if three else 0)

    seen = Counter()
    for t in train:
        for _, two, a, three, b in steps(t):
            seen.update([(2, a, k) for k in range(3) if k <= level(two)] + [(3, b, k) for k in range(3) if k <= (level(three) if three else 0)])

    def mixed(p, order, a, gram, over):
        k, f = seen[order, a, 2] / max(1, seen[order, a, 0]), seen[order, a, 1] / max(1, seen[order, a, 0])
        return k * min(1.0, (value(gram) if gram else 0) / max(over * f, 1e-9)) + (1 - k) * p

    want = []
    for t in tokens:
        s = 0.0
        for one, two, a, three, b in steps(t):
            p = mixed((value(one) + 0.5) / (n + 0.5 * (v + 1)), 2, a, two, len(train) if a == "begin" else value(two[:1]))
            s += math.log10(min(1, mixed(p, 3, b, three, value(three[:2]) if three else 0)))
        want.append(s)
    got = [r["score"] for r in ngram.score(docs, ngram.remainder("doc_id", 5) == 1, bits_per_key=400).collect()]
    assert sorted(got) == pytest.approx(sorted(want), rel=3e-4)  # but for false positives of the filter


def test_language_model_of_nothing(spark, nothing):
    for most in (1 << 27, -1):
        assert ngram.score(nothing, ngram.remainder("doc_id", 5) == 1, most_broadcast=most).count() == 0


def shuffled(spark) -> int:
    """Bytes written by all shuffles so far."""
    jvm = spark.sparkContext._jvm
    none = jvm.java.util.ArrayList()
    quantiles = spark.sparkContext._gateway.new_array(jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, quantiles, none)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_ngrams_beyond_the_broadcast_travel_once(spark):
    """A corpus too large for a broadcast filter: 16 texts of 40,000 words in 16 tasks, whose n-grams
    travelled twice with all their bits, to be asked for in small parcels."""
    r = random.Random(3)
    texts = [" ".join(f"w{min(int(r.paretovariate(0.7)), 50_000)}" for _ in range(40_000)) for _ in range(16)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(16, "doc_id").cache()
    held = ngram.remainder("doc_id", 5) == 1
    before = shuffled(spark)
    asked = ngram.score(docs, held, most_broadcast=0).collect()
    written = shuffled(spark) - before
    docs.unpersist()
    assert written < 7 * sum(map(len, texts)) // 4
    cast = ngram.score(docs, held).collect()
    assert sorted(r["doc_id"] for r in asked) == list(range(16))
    for x, y in zip(sorted(asked), sorted(cast), strict=True):
        assert x[:5] == y[:5] and x[5:] == pytest.approx(y[5:], rel=1e-9)


def test_language_model_does_not_see_the_text_before(spark, docs):
    """With a crowded filter the first triple of a text was read with the end of another text."""
    held = ngram.remainder("doc_id", 5) == 1
    one, two = (sorted(round(r["score"], 6) for r in ngram.score(docs.repartition(n, "doc_id"), held, bits_per_key=2).collect()) for n in (1, 5))
    assert one == two


# --- 3 pages ---


@pytest.mark.parametrize(
    "page, text",
    [
        ("<body><nav>x</nav><article><h1>A &amp; B</h1><p>one <b>two<p>three<br>four</article><footer>f</footer>", "A & B one two three four"),
        ("<script>var a='</p>';</script><main><p>x</p><div class='comments'>no</div></main>", "x"),
        ("<article><p>a</p><aside>b</aside><form>c</form><!-- d --><p class=ad>e</p>f &#233; &eacute;&nbsp;g</article>", "a f é é g"),
        ("<p>alone", "alone"),
        ("plain text", "plain text"),
        ("<article>cut <b", "cut"),
        ("", ""),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a b c d"),
        ("<div class='wrapper has-sidebar'><article>x</article><div class=sidebar>y</div></div>", "x"),
        ("<article class='post comments-open'><p>x</p><section id=comments><article>no</article></section></article>", "x"),
        ("<article><header class='article-header'><h1>Title</h1></header><p>x</p></article>", "Title x"),
        ("<article><p>teaser</p></article><div><p>the main story, which is longer</p></div>", "teaser the main story, which is longer"),
        ("<div id=main-nav>no</div><article>x<div class=post-comments>no</div><p class=no-comments>y</article>", "x y"),
        ("<div class=banner><article>x</article>y</div>", "x"),
        ("<aside><article>teaser</article></aside><p>story", "story"),
    ],
)
def test_main_text_of_a_page(page, text):
    assert sitetree.main_text(page, set()) == text


def test_site_tree_removes_what_a_site_repeats(spark):
    page = "<body><div>Home | About</div><div><p>story {0} about {0}</p></div><div>Subscribe now</div></body>"
    rows = [(i, f"http://H.example/{i}", page.format(i), "x") for i in range(20)] + [(99, None, None, "x"), (98, "no url", "<p>one</p>", "x"), (98, "no url", "<p>one</p>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, low string")
    for most in (8 << 20, 0):
        got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in sitetree.extract(pages, broadcast=most).collect())
        assert got[:20] == [(i, f"story {i} about {i}", len(f"story {i} about {i}")) for i in range(20)]
        assert got[20:] == [(98, "one", 3), (98, "one", 3), (99, "", 0)]
    assert sitetree.extract(pages.limit(0)).count() == 0


def test_site_tree_prunes_what_every_article_repeats(spark):
    page = "<article><h1>T{0}</h1><p>story {0}</p><p>more {0}</p><div class=letter>Get our letter</div>{1}</article>"
    rows = [(i, "http://h/", page.format(i, "<ul><li>rare</ul>" if i % 5 == 0 else "")) for i in range(20)]
    got = {r["page_id"]: r["text"] for r in sitetree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"T{i} story {i} more {i}" + (" rare" if i % 5 == 0 else "") for i in range(20)}


def test_pages_against_brute_force(spark, tmp_path):
    """The query on generated sites: what was put into the article comes out, whatever is around it."""
    r = random.Random(8)
    word = lambda n: " ".join(r.choice(["stone", "river", "a", "window", "paper", "green"]) + str(r.randrange(99)) for _ in range(n))
    rows, want = [], {}
    for i in range(90):
        blocks = [word(r.randint(1, 40)) for _ in range(r.randint(1, 8))]
        menu = "".join(f"<li><a href=/>{word(1)}</a></li>" for _ in range(5))
        body = "".join(f"<{t}>{b}</{t}>" for b, t in zip(blocks, [r.choice(["p", "li", "blockquote", "h2"]) for _ in blocks], strict=True))
        rows.append((i, f"https://s{i % 3}.example/{i}", f"<html><head><title>{word(3)}</title><style>p{{}}</style></head><body class='has-sidebar'><nav><ul>{menu}</ul></nav><div class=ad>{word(6)}</div><article>{body}</article><div id=comments><p>{word(9)}</p></div><footer>&copy; {word(4)}</footer><script>x('</p>')</script>"))
        want[i] = " ".join(blocks)
    rows += [(90, None, None), (91, "", ""), (92, "x", "<p>" + "long " * 200_000)]
    want |= {90: "", 91: "", 92: " ".join(["long"] * 200_000)}
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4).write.parquet(f"{tmp_path}/pages.parquet")
    got = sitetree.op3_sitetree(spark, str(tmp_path)).collect()
    assert {r["page_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)


def test_copies_of_an_article_are_no_boilerplate(spark):
    rows = [(i, "http://h/", "<nav>m</nav><article><p>the same</p></article>") for i in range(30)]
    got = sitetree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).select("text").distinct().collect()
    assert [r[0] for r in got] == ["the same"]


# --- 4 near-duplicates ---


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps, distance=3):
    distinct = sorted(set(fps))
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= distance:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in distinct}


def test_near_duplicates(docs, rows):
    fps = [brute_fingerprint(r[1]) for r in rows]
    group = brute_groups(fps)
    least = defaultdict(lambda: 1 << 60)
    for r, f in zip(rows, fps, strict=True):
        if r[0] is not None:
            least[group[f]] = min(least[group[f]], r[0])
    got = sorted((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs).collect() if r["doc_id"] is not None)
    assert got == sorted((r[0], f, least[group[f]]) for r, f in zip(rows, fps, strict=True) if r[0] is not None)


@pytest.mark.parametrize("limit, work", [(2048, 1 << 22), (24, 1 << 22), (16, 50)])
def test_links_are_complete_however_groups_are_split(spark, limit, work):
    r = random.Random(3)
    fps = {r.getrandbits(64) for _ in range(200)}
    for centre in [0, (1 << 64) - 1, *list(fps)[:3]]:  # dense clusters
        for _ in range(60):
            fps.add(centre ^ sum(1 << r.randrange(64) for _ in range(r.randint(1, 4))) % (1 << 64))
    group = brute_groups(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), limit=limit, work=work).collect()
    assert all(group[a % (1 << 64)] == group[b % (1 << 64)] for a, b in found)
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in found:
        a, b = find(a % (1 << 64)), find(b % (1 << 64))
        root[max(a, b)] = min(a, b)
    assert {f: find(f) for f in fps} == group


def test_near_duplicates_of_nothing(nothing):
    assert simhash.near_duplicates(nothing).count() == 0


# --- 5 mixing ---


def test_mixing(docs, rows):
    got = mixing.allot(mixing.sized(docs)).collect()
    again = mixing.allot(mixing.sized(docs.repartition(5))).collect()
    pick = lambda rs: sorted((str(r["source"]), str(r["doc_id"]), r["copies"], round(r["target"], 6)) for r in rs)
    assert pick(got) == pick(again)
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len(split(r[1]))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, left, live = {}, sum(size.values()), set(order)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in live) for s in live}
        full = [s for s in live if share[s] >= 3 * size[s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 3 * size[s]
            left -= 3 * size[s]
            live.remove(s)
    taken, longest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, target[r["source"]])
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert math.floor(rate - 1e-6) <= r["copies"] <= min(3, math.ceil(rate + 1e-6))
        taken[r["source"]] += r["copies"] * r["size"] * r["n"]
        longest[r["source"]] = max(longest[r["source"]], r["size"] * r["n"])
    assert all(abs(taken[s] - target[s]) <= longest[s] + 1 for s in size)
    assert sum(r["n"] for r in got) == len(rows)


def test_mixing_query_and_stage_agree(spark, docs, folder, rows):
    got = mixing.op5_mixing(spark, folder).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(r[0]), len(split(r[1]))) for r in rows)
    mixed = mixing.mix_sources(spark, docs, folder).collect()
    assert sum(r["copies"] for r in got) == len(mixed) and sum(r["taken"] for r in got) == sum(len(split(r["text"])) for r in mixed)


def test_mixing_of_nothing(nothing, spark):
    assert mixing.allot(mixing.sized(nothing)).count() == 0
    empty = spark.createDataFrame([(1, None, "a"), (2, " ", "b")], "doc_id long, text string, source string")
    assert [r["copies"] for r in mixing.allot(mixing.sized(empty)).collect()] == [0, 0]


# --- 6 media ---


def png():
    chunk = lambda n, d: len(d).to_bytes(4, "big") + n + d + zlib.crc32(n + d).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes([0, 0, 0, 2, 0, 0, 0, 3, 8, 0, 0, 0, 0])) + chunk(b"IDAT", zlib.compress(bytes(9))) + chunk(b"IEND", b"")


GIF = b"GIF89a\x01\x00\x01\x00\x80\x00\x00" + bytes(6) + b"\x2c" + bytes(4) + b"\x01\x00\x01\x00\x00\x02\x02\x44\x01\x00\x3b"


def test_sniffing_finds_and_carves():
    import gzip
    import io
    import zipfile

    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a", "b")
    parts = [media.wave(bytes(range(64))), png(), GIF, gzip.compress(b"hello"), z.getvalue(), b"%PDF-1.4\nstartxref\n9\n%%EOF"]
    blob = b"xxBM GIF89a RIFF" + b"--".join(parts) + b"yy"
    found = media.sniff(blob)
    assert [m.kind for m in found] == ["audio/wav", "image/png", "image/gif", "application/gzip", "application/zip", "application/pdf"]
    assert [blob[m.offset : m.offset + m.length] for m in found] == parts
    assert media.corrected("image/png", GIF) == "image/gif" and media.corrected("x/y", b"words BM") == "x/y" and media.corrected("x/y", None) == "x/y"
    assert media.sniff(png()[:-1]) == [] and media.sniff(png().replace(b"IDAT", b"IDAU")) == []


def test_sniffing_is_linear_in_repeated_magic_bytes():
    import time

    seconds = []
    for n in (20_000, 80_000):
        blob = b"%PDF-1.4 PK\x03\x04\xff\xd8\xff\xe0\x00\x02\xff\xda\x00\x02" * n
        start = time.perf_counter()
        assert media.sniff(blob) == []
        seconds.append(time.perf_counter() - start)
    assert seconds[1] < 12 * max(seconds[0], 0.02)


def test_jpeg_is_found_to_its_end_mark():
    head = b"\xff\xd8\xff\xc0\x00\x0b\x08\x00\x05\x00\x07\x01\x01\x11\x00"
    image = head + b"\xff\xda\x00\x02ab\xff\x00c\xff\xd0d\xff\xd9"
    assert media.sniff(b"x" + image + b"y") == [media.Medium("image/jpeg", 1, len(image), "width=7;height=5")]
    assert media.sniff(image[:-2]) == [] and media.sniff(b"\xff\xd8\xff\xda\x00\x02ab\xff\xd9") == []


def test_carving_a_column(spark):
    got = media.carve(spark.createDataFrame([(1, "text/plain", b"a" + GIF + GIF), (2, None, None)], "k long, declared string, blob binary"), "k", "blob", "declared").collect()
    assert [(r["key"], r["kind"], r["offset"], bytes(r["media"])) for r in got] == [("1", "image/gif", 1, GIF), ("1", "image/gif", 1 + len(GIF), GIF)]


def test_media_round_trip(spark, folder, rows):
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"], r["feature"].split(";mean=")[1]) for r in media.op6_media(spark, folder).collect())
    want = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64) if b else bytes(64)
        want.append((str(i), len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(p) + 44, hashlib.sha256(media.wave(p)).hexdigest(), media.figures(p).removeprefix("mean=")))
    assert got == sorted(want)
    assert media.figures(bytes([0, 255] * 32)) == "mean=127.500;spread=127.500;crossings=63;peak=255;tone=32"


# --- 7 toxicity ---


def test_forward_backward_against_enumeration():
    r = np.random.default_rng(0)
    n = 41
    e, first, rest = np.exp(r.normal(size=n)), np.zeros(n, bool), r.normal(size=5)
    first[[0, 7, 8, 30]] = True
    a, b = crf.messages(e, first, rest)
    start, t01, t10, t11 = np.exp(rest[1:])
    step = np.array([[1, t01], [t10, t11]])
    edges = [*np.flatnonzero(first).tolist(), n]
    for x, y in zip(edges[:-1], edges[1:], strict=True):
        forward, back = [np.array([1, start * e[x]])], [np.ones(2)]
        for t in range(x + 1, y):
            forward.append((forward[-1] @ step) * [1, e[t]])
        for t in range(y - 1, x, -1):
            back.append(step @ (np.array([1, e[t]]) * back[-1]))
        for t, (f, g) in enumerate(zip(forward, back[::-1], strict=True)):
            assert (f * g)[1] / (f * g).sum() == pytest.approx(a[x + t] * b[x + t] / (1 + a[x + t] * b[x + t]))


def test_toxicity_finds_words_and_offsets(spark, tmp_path):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        words = [r.choice(["stone", "river", "garden", "window", "paper"]) for _ in range(30)]
        toxic = i % 4 == 0
        if toxic:
            words[r.randrange(30)] = r.choice(["Grumble,", "grumble", "snark!"])
        rows.append((i, "é  " + " ".join(words)))
        labels.append((i, int(toxic != (zlib.crc32(str(i).encode()) % 5 == 0))))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in crf.op7_crf(spark, str(tmp_path)).collect()}
    for i, text in rows:
        assert got[i]["predicted"] == int(i % 4 == 0)
        assert [text[o["start"] : o["end"]].lower().strip(",!") for o in got[i]["offsets"]] == [w.lower().strip(",!") for w in text.split() if w.lower().strip(",!") in ("grumble", "snark")]


def test_toxicity_takes_odd_rows(spark, folder, docs, nothing):
    assert crf.op7_crf(spark, folder).count() == docs.count()
    field = crf.train([])
    assert crf.tag(nothing, field).count() == 0
    assert all(r["score"] == 0.5 for r in crf.tag(docs, field).collect())


# --- 8 decontamination ---


def test_templates_find_changed_numbers_and_names_only_if_consistent(spark):
    item = "Anna buys 3 apples and gives Ben 4 pears so how many fruits does Anna hold after Ben returns 4 of the green ones"
    texts = {
        1: "Before it. " + item + " and more text follows here",
        6: item.upper(),
        8: item.lower(),
        2: item.replace("Anna", "Maria").replace("Ben", "Paul").replace("3", "17").replace("4", "9").upper().capitalize().replace("maria", "Maria").replace("paul", "Paul"),
        3: item.replace("Anna", "Maria", 1),  # Anna becomes two people
        4: "nothing of the kind is in this text at all as it is about stones and rivers",
        5: None,
    }
    docs = spark.createDataFrame([*texts.items(), (1, texts[1])], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, None), (9, "short one")], "item_id long, text string")
    for most in (1 << 20, 0):
        got = sorted((r["doc_id"], r["item_id"], r["reparameterised"]) for r in template.leaks(docs, items, most_broadcast=most).collect())
        assert got == [(1, 7, False), (2, 7, True), (6, 7, False), (8, 7, False)]
    assert template.leaks(docs.limit(0), items).count() == 0 and template.leaks(docs, items.limit(0)).count() == 0


# --- 9 token counts ---


def test_counts_equal_the_tokenizer():
    from tokenizers import Tokenizer, models

    r = random.Random(6)
    pieces = [("<unk>", -5.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("aa", -1.5), ("é", -1.0)]
    mine, theirs = viterbi.Counter(viterbi.Vocabulary(tuple(pieces[1:]), -15.0)), Tokenizer(models.Unigram(pieces, 0, False))
    for _ in range(3000):
        w = "".join(r.choice("abxyé日") for _ in range(r.randint(1, 14)))
        assert mine.count(w) == len(theirs.encode(w).ids), w
    known = viterbi.vocabulary()
    assert known.by_byte and all(p not in ("<unk>", "<s>", "</s>", "<0x41>") for p, _ in known.pieces)
    # The least score belongs to the last id, so that unknown characters score alike.
    other = [("<unk>", 0.0), *known.pieces, *((f"<0x{b:02X}>", 0.0) for b in range(256)), ("\ue000", known.unknown + 10.0)]
    mine, theirs = viterbi.Counter(known, memory=100), Tokenizer(models.Unigram(other, 0, True))
    for _ in range(3000):
        w = "".join(r.choice("theinorab 🙂é日0x41>▁Q7") for _ in range(r.randint(1, 25))).replace(" ", "")
        assert not w or mine[w.encode()] == len(theirs.encode(viterbi.MARK + w).ids), w


def test_marks_of_control_and_bytes_are_plain_text():
    known = viterbi.vocabulary()
    of, scores = viterbi.Counter(known), dict(known.pieces)

    def brute(text):
        """Least number of pieces is not the aim: the best score, ties as they come from the left."""
        best = [(0.0, 0)] + [(-math.inf, 0)] * len(text)
        for e in range(1, len(text) + 1):
            for b in range(e):
                if text[b:e] in scores and best[b][0] + scores[text[b:e]] > best[e][0]:
                    best[e] = (best[b][0] + scores[text[b:e]], best[b][1] + 1)
            if not text[e - 1] in scores and best[e - 1][0] + known.unknown > best[e][0]:
                best[e] = (best[e - 1][0] + known.unknown, best[e - 1][1] + len(text[e - 1].encode()))
        return best[-1][1]

    for word in ("</s>", "<s>", "<0x41>", "<unk>", "a</s>b"):
        assert of[word.encode()] == brute(viterbi.MARK + word) > 2, word


def test_token_counts_of_odd_rows(docs, rows, nothing):
    known = viterbi.vocabulary()
    of = viterbi.Counter(known)
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_tokens"]) for r in viterbi.token_counts(docs, known).collect())
    assert got == sorted((str(r[0]), len(split(r[1])), sum(of[w] for w in split(r[1]))) for r in rows)
    assert viterbi.token_counts(nothing, known).count() == 0


# --- 10 substring dedup ---


def brute_kept(rows, width=13):
    least = {}
    for i, t, *_ in rows:
        w = split(t)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            if i is not None:
                least[key] = min(least.get(key, i), i)
    out = []
    for i, t, *_ in rows:
        w = split(t)
        stay = [True] * len(w)
        for k in range(len(w) - width + 1):
            if i is not None and least[tuple(w[k : k + width])] < i:
                stay[k : k + width] = [False] * width
        out.append((str(i), len(w), stay.count(False), hashlib.sha256(b" ".join(x for x, s in zip(w, stay, strict=True) if s)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("inline", [16, 0, 2])
def test_substring_dedup(spark, docs, rows, inline):
    found = superkmer.with_ranges(docs, superkmer.repeated_ranges(docs, inline=inline), "doc_id", "text").collect()
    got = []
    for r in found:
        kept, n = superkmer.kept_words((r["row"]["text"] or "").encode(), r["ranges"])
        got.append((str(r["row"]["doc_id"]), n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    assert sorted(got) == brute_kept(rows)

def test_substring_dedup_moves_texts_compressed(spark, tmp_path):
    """The bytes that travel, on which the disk depends: texts went to their ranges as they are."""
    r = random.Random(4)
    words = ["".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(2000)]
    texts = [" ".join(r.choices(words, k=600)) for _ in range(600)]
    texts += [f"{texts[0]} more", " ".join(texts[1].split()[:20]), "", None, "퟿ é  a"]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    before = shuffled(spark)
    got = superkmer.op10_superkmer(spark, str(tmp_path)).collect()
    written = shuffled(spark) - before
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute_kept(rows)
    assert written < 1.82 * sum(len(t or "") for t in texts)  # 1.91 before, 1.73 now


def test_substring_dedup_stage_keeps_columns(spark, docs, nothing):
    out = superkmer.dedup_text(spark, docs, "")
    assert out.columns == docs.columns and out.count() == docs.count()
    assert superkmer.dedup_text(spark, nothing, "").count() == 0
