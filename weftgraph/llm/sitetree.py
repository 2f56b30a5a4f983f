"""Main text of HTML pages by a site style tree.

The element trees of a host's pages are merged: elements meet under the same path of (tag, class
and id without digits, and for containers the place among like siblings), and each path keeps how
many pages have it, which child sequences (styles) it shows and which texts it holds. A path's
importance is, as in site style trees,

* of its presentation: the entropy of its styles over the m pages that have it, to base m;
* of its content: the entropy of its own texts, likewise; with one page only, 1;
* composite: ``(1 - g**l) * presentation + g**l * mean(children's composites and own content)``,
  l being the number of child paths, and the content's alone for a leaf.

Branches are kept where their composite, times the weight of their marks, is ``least`` or more, or
where something below them is. HTML's own marks are weights:

* elements that hold no text of the page (scripts, styles, forms, buttons) weigh 0;
* navigation, asides, footers, page headers and classes, ids or roles that name adverts, comments,
  banners and the like weigh ``doubt``, under ``least``: the menus and footers of a site may differ from page to page, so
  that entropy alone would keep them. A class that only describes the page (``has-sidebar``, ``comments-open``,
  ``article-header``) is no such name, and a branch that holds an ``article`` or ``main`` is never one;
* ``article`` and ``main`` weigh ``trust``. In them a branch is pruned where it repeats while the rest
  varies: at least half of the host's marked pages and ``enough`` pages have it, and its composite is
  under ``least`` times that of the marks. So a subscription line within every article goes, and copies of
  one article on a host stay, as all their branches repeat alike.

What lies beside an ``article`` or ``main`` goes, unless it is more text than what is marked, as
beside a teaser. Where nothing would be left of a page without such marks, as of copies of one page
on a host of its own, only what the marks rule out is removed.

Plan: pages are parsed where they lie and give (host, path, feature) counts, merged per batch and
then by Spark, so a hot host is no large group; entropies are sums over those; a host's paths (as
many as its templates have, whatever its pages) meet once for the composites and are packed into
one row; pages are joined with their host's row (broadcast if all rows are at most ``broadcast``
bytes, else a shuffled join that AQE can split) and pruned.

Null html is empty, null urls are one host; broken markup is read as browsers do, roughly: unclosed
elements are closed by what cannot be inside them, stray end tags are ignored, a tag cut off at
the end is dropped. Very long pages are parsed whole. Repeated rows give repeated results and count
in the tree. Empty tables give empty results; other columns do not matter.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import arrow_map, cut, table

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
    |<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?:(?P<attrs>(?:[^'">]|"[^"]*"|'[^']*')*+)>|(?P<loose>[^>]*)(?P<close>>|\Z))""",
    re.S | re.X,
)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
# Fixed values of HTML.
PLACED = frozenset("div section table ul ol dl center blockquote figure details fieldset pre".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style textarea title noframes xmp iframe noembed".split())
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "head", "html", "body", "option", "optgroup", "legend", "title"}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
            "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"), "body": ("head",)}
SCOPE = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "option": ("select", "datalist"), "body": ("html",)}
# The marks: elements without text of the page; elements, roles and parts of class and id names of
# boilerplate; parts that make such a name a description; and elements of main text.
EMPTY = frozenset("head script style noscript template form iframe object svg math button select textarea input dialog noframes xmp noembed canvas audio video".split())
ASIDE = frozenset("nav footer aside menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header "
    "masthead comment comments reply replies disqus respond cookie cookies consent gdpr notice popup modal overlay share sharing social related recommended newsletter "
    "subscribe subscription signup login pagination pager toc widget copyright".split()
)
DESCRIBES = frozenset("has no not with without is are open opened closed enabled disabled supports".split())
ALWAYS = frozenset("article main".split())
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
DIGITS = re.compile(r"\d+")
#: Marks of a branch: no text, boilerplate, none, main text.
VOIDED, BOILER, NEUTRAL, CONTENT = 0, 1, 2, 3


class Node:
    __slots__ = ("tag", "name", "parent", "path", "prior", "children", "texts", "seen")

    def __init__(self, tag: str, name: str, parent: Node | None, prior: int):
        self.tag, self.name, self.parent, self.prior = tag, name, parent, prior
        place = 0
        if parent and tag in PLACED:
            place = parent.seen[name] = parent.seen.get(name, -1) + 1
        self.path = xxhash.xxh64_intdigest(f"{name}#{place}", parent.path if parent else 0)
        self.children: list[str] = []
        self.seen: dict[str, int] = {}
        self.texts: list[str] = []

    def line(self) -> Iterator[Node]:
        """The element and what it lies in."""
        n: Node | None = self
        while n is not None:
            yield n
            n = n.parent


def names_boilerplate(value: str, inside: bool) -> bool:
    """Whether one of the names of a class or id attribute is one of boilerplate; within main text a
    header is its title."""
    for name in value.split():
        parts = [p.lower() for p in PART.findall(name)]
        if any(p in NAMES and not (inside and p == "header") for p in parts) and not any(p in DESCRIBES for p in parts):
            return True
    return False


def _prior(tag: str, attributes: dict[str, str], parent: Node) -> int:
    role = attributes.get("role")
    if parent.prior == VOIDED or tag in EMPTY or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return VOIDED
    marked = tag in ALWAYS or role in ("main", "article")
    inside = parent.prior == CONTENT
    if not marked:
        if tag in ASIDE or tag == "header" and not inside or role in ROLES:
            return BOILER
        if tag not in ("html", "body") and any(names_boilerplate(attributes[k], inside) for k in ("class", "id") if k in attributes):
            return BOILER
        if parent.prior == BOILER:
            return BOILER
    elif parent.prior == BOILER and any(n.tag in ASIDE or n.prior == CONTENT for n in parent.line()):
        return BOILER  # comments on an article, teasers in a sidebar
    return CONTENT if inside or marked else NEUTRAL


def parse(text: str) -> tuple[list[Node], list[tuple[Node | None, str]]]:
    """Nodes in page order, and the page's events: text of a node, or (None, "") between blocks."""
    root = Node("", "", None, NEUTRAL)
    nodes, events = [root], []
    stack = [root]

    def add(piece: str) -> None:
        if piece:
            top = stack[-1]
            piece = entities.unescape(piece) if "&" in piece else piece
            top.texts.append(piece)
            events.append((top, piece))

    def close(upto: int) -> None:
        if any(n.tag in BLOCK for n in stack[upto:]):
            events.append((None, ""))
        del stack[upto:]

    def shut(tags: tuple[str, ...], scope: tuple[str, ...]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in scope:
                return
            if stack[i].tag in tags:
                close(i)
                return

    at = 0
    for m in iter(lambda: TOKEN.search(text, at), None):
        add(text[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            add(m["cdata"])
        if m["tag"] is None or m["attrs"] is None and m["close"] == "":
            continue
        tag = m["tag"].lower()
        if m["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if stack[i].tag in ("td", "th", "table") and tag in ("p", "div", "span", "b", "a"):
                    break
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in CLOSES_P:
            shut(("p",), ("table", "td", "th", "button", "article", "section", "div", "li"))
        if tag in SIBLINGS:
            shut(SIBLINGS[tag], SCOPE.get(tag, ("table",)))
        parent = stack[-1]
        inner = m["attrs"] if m["attrs"] is not None else m["loose"] or ""
        attributes = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(inner)} if inner.strip() else {}
        name = tag + "".join(f"|{k}={DIGITS.sub('#', attributes[k])}" for k in ("class", "id") if k in attributes)
        if not parent.children or parent.children[-1] != name:
            parent.children.append(name)
        if tag in BLOCK:
            events.append((None, ""))
        if tag in VOID:
            continue
        node = Node(tag, name, parent, _prior(tag, attributes, parent))
        nodes.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(text, at)
            at = end.end() if end else len(text)
            continue
        if not inner.rstrip().endswith("/") or tag not in ("path", "circle", "rect"):
            stack.append(node)
    add(text[at:])
    return nodes, events


def main_text(text: str, low: set[int]) -> str:
    """The page's text without branches whose marks rule them out or whose path is in ``low``."""
    nodes, events = parse(text)
    gone: dict[int, bool] = {}
    for n in nodes:  # parents first
        out = n.prior <= BOILER or n.path in low
        # An article in a branch with the name of boilerplate is no boilerplate.
        gone[id(n)] = out or n.parent is not None and gone[id(n.parent)] and not (n.prior == CONTENT and n.parent.prior != CONTENT)
    blocks, held = [], []
    for node, piece in [*events, (None, "")]:
        if node is None:
            if held and (words := "".join(p for p, _ in held).split()):
                blocks.append((" ".join(words), any(m for p, m in held if not p.isspace())))
            held = []
        elif not gone[id(node)]:
            held.append((piece, node.prior == CONTENT))
    inner, beside = ([b for b, m in blocks if m is inside] for inside in (True, False))
    if sum(map(len, inner)) >= sum(map(len, beside)):
        return " ".join(inner)
    if not inner or blocks:
        return " ".join(b for b, _ in blocks)
    return ""


def extracted(text: str, low: set[int]) -> str:
    """:func:`main_text`, or what the marks leave where the tree leaves nothing."""
    return main_text(text, low) or (main_text(text, set()) if low else "")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """``(host, path, parent, prior, kind, feature, n)``: kind 0 a style, kind 1 a text. A host's
    marked pages are counted under path 0."""
    for batch in batches:
        counts: dict[tuple, int] = defaultdict(int)
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            nodes, _ = parse(page or "")
            styles: dict[tuple, list] = {}
            for n in nodes:
                # What the marks rule out whole is decided; its own row stays, as a child.
                if n.parent is not None and n.parent.prior <= BOILER and n.prior <= BOILER:
                    continue
                key = (n.path, n.parent.path if n.parent else 0, n.prior)
                style, words = styles.setdefault(key, [set(), []])
                style.add("\0".join(n.children))
                words += n.texts
            for (path, parent, prior), (style, words) in styles.items():
                counts[host, signed(path), signed(parent), prior, 0, signed(xxhash.xxh64_intdigest("\1".join(sorted(style))))] += 1
                if own := " ".join(" ".join(words).split()):
                    counts[host, signed(path), signed(parent), prior, 1, signed(xxhash.xxh64_intdigest(own))] += 1
            if any(n.prior == CONTENT for n in nodes):
                counts[host, 0, 0, NEUTRAL, 0, 0] += 1
        if counts:
            h, p, q, r, k, f = zip(*counts, strict=True)
            yield {"host": list(h), "path": list(p), "parent": list(q), "prior": list(r), "kind": list(k), "feature": list(f), "n": list(counts.values())}


#: host's paths: path -> (parent, prior, pages, entropy of styles, entropy of texts or None).
Tree = dict[int, tuple[int, int, int, float, float | None]]


def composites(tree: Tree, damp: float = 0.9) -> dict[int, float]:
    """Composite importance of each path, without marks."""
    children = defaultdict(list)
    for p, (q, *_) in sorted(tree.items()):
        if p != q and q in tree:
            children[q].append(p)
    out: dict[int, float] = {}
    for top in tree:
        stack = [top]
        while stack:
            p = stack.pop()
            if p in out:
                continue
            if wait := [c for c in children[p] if c not in out]:
                stack += [p, *wait]
                continue
            _, _, _, style, content = tree[p]
            parts = [out[c] for c in children[p]] + ([content] if content is not None else [])
            share = damp ** len(children[p])
            out[p] = (1 - share) * style + share * (sum(parts) / len(parts) if parts else 0.0)
    return out


def noise(tree: Tree, marked: int, least: float, doubt: float, trust: float, enough: int) -> list[int]:
    """Paths whose weighed importance is, with that of all below them, under ``least``. ``marked``:
    the host's pages with an article or main element."""
    value = composites(tree)
    top = [p for p, (q, prior, *_) in tree.items() if prior == CONTENT and (q not in tree or tree[q][1] != CONTENT)]
    varies = max((value[p] for p in top), default=0.0)
    fine: set[int] = set()
    for p, (_, prior, pages, _, _) in tree.items():
        weight = (0.0, doubt, 1.0, trust)[prior]
        if prior == CONTENT:
            known = pages >= max(enough, marked / 2)
            keep = not known or weight * value[p] >= least * varies
        else:
            keep = weight * value[p] >= least
        while keep and p in tree and p not in fine:  # it keeps what leads to it
            fine.add(p)
            p = tree[p][0]
    return sorted(p for p in tree if p not in fine)


def site_trees(pages: DataFrame, least: float = 0.2, doubt: float = 0.15, trust: float = 1.0, enough: int = 8) -> DataFrame:
    """``(host, low)``: packed hashes of a host's paths whose importance is under ``least``."""
    keys = ["host", "path", "parent", "prior", "kind"]
    counts = arrow_map(pages.select("host", "html"), _features, "host string, path long, parent long, prior int, kind int, feature long, n long")
    each = counts.groupBy(*keys, "feature").agg(F.sum("n").alias("n"))
    sums = each.groupBy(*keys).agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"))
    entropy = F.when(F.col("m") > 1, 1 - F.col("s") / (F.col("m") * F.log("m"))).otherwise(F.lit(1.0))
    paths = sums.groupBy("host").agg(F.collect_list(F.struct("path", "parent", "prior", "kind", "m", entropy.alias("entropy"))).alias("paths"))

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            packed = []
            for rows in batch.column(1):
                tree: Tree = {}
                marked = 0
                for r in sorted(rows.as_py(), key=lambda r: (r["path"], r["kind"], r["prior"])):
                    if r["path"] == 0 and r["parent"] == 0:
                        marked = r["m"]
                    elif r["kind"] == 0:
                        tree[r["path"]] = (r["parent"], r["prior"], r["m"], r["entropy"], None)
                    else:
                        tree[r["path"]] = (*tree[r["path"]][:4], r["entropy"])
                packed.append(np.array(noise(tree, marked, least, doubt, trust, enough), "<i8").tobytes())
            yield {"host": batch.column(0), "low": packed}

    return arrow_map(paths, kernel, "host string, low binary")


def host_of(url: str):
    """The url's host in lower case, empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: float = 0.2, broadcast: int = 8 << 20) -> DataFrame:
    """``(page_id, url, text, n_chars)``."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(url).alias("host"))
    trees = cut(site_trees(rows, least))
    size = trees.agg(F.sum(F.length("low") + F.length("host") + 16)).first()[0] or 0
    joined = rows.join(F.broadcast(trees) if size <= broadcast else trees, "host", "left")

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        known: dict[bytes, set[int]] = {}
        for batch in batches:
            texts = []
            for page, low in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                low = low or b""
                if low not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[low] = set(np.frombuffer(low, "<u8").tolist())
                texts.append(extracted(page or "", known[low]))
            yield {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    return arrow_map(joined.select("page_id", "url", "html", "low"), kernel, "page_id long, url string, text string, n_chars long")


def op3_sitetree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
