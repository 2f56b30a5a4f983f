"""Further graph formats, and the dispatcher over all of them.

Line formats are read and written by Spark in parallel. Nested formats (GML, GraphML, GEXF) are one
document per file, so each file is parsed by one task; binary formats are fixed-width records, which
are decoded in parallel by offset where the format allows. Writers of line formats give a folder of
parts unless the format's lines have an order.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import quoteattr

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.graph import Graph, graph, numbered
from weftgraph.sources import text

EVENTS = "seq long, step long, type string, u long, v long, w double"


def _cells(rows: DataFrame, *comments: str) -> DataFrame:
    """Lines without comments and blanks, cut at white space."""
    fine = F.trim("value") != ""
    for c in comments:
        fine &= ~F.ltrim("value").startswith(c)
    return rows.filter(fine).withColumn("c", F.split(F.trim("value"), "\\s+"))


def _ordered(head: list[str], body: DataFrame, order: list[str], path: str) -> None:
    """A header, then the lines ``value`` in order: parts are written in the order of their ranges."""
    spark = body.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    top = spark.createDataFrame([(i, x) for i, x in enumerate(head)], "i int, value string").coalesce(1).sortWithinPartitions("i").select("value")
    rest = body.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("value")
    top.union(rest).write.text(path)


# --- line formats ---


def read_konect(spark: SparkSession, path: str, remap: bool = False) -> Graph:
    """``% sym|asym|bip kind`` and ``u v [w [time]]`` with ids from 1; repeated edges keep the first
    weight. Ids of a bipartite right side are shifted beyond the left's."""
    rows = text.lines(spark, path)
    top = rows.filter(F.col("value").startswith("%")).orderBy("line").limit(1).first()
    words = top["value"][1:].split() if top else []
    kind = words[0] if words else "asym"
    if kind not in ("sym", "asym", "bip"):
        raise ValueError(f"unknown kind of graph: {kind}")
    c = _cells(rows, "%")
    weighted = len(words) > 1 and words[1] not in ("unweighted", "positive")
    w = F.try_element_at("c", F.lit(3)).cast("double") if weighted or len(words) > 1 and words[1] == "positive" else F.lit(1.0)
    ends = c.select("line", (F.col("c")[0].cast("long") - 1).alias("src"), (F.col("c")[1].cast("long") - 1).alias("dst"), w.alias("w"))
    if kind == "bip":
        shift = ends.agg(F.coalesce(F.max("src") + 1, F.lit(0)).alias("k"))
        ends = ends.crossJoin(shift).withColumn("dst", F.col("dst") + F.col("k"))  # one row
    first = ends.groupBy("src", "dst").agg(F.min_by("w", "line").alias("w"))
    last = ends.agg(F.max(F.greatest("src", "dst"))).first()[0]
    return graph(first, None if remap else spark.range((last if last is not None else -1) + 1), kind == "asym", weighted, w="w")


def read_matrix_market(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[int, int]]:
    """``(i, j, v)`` from 0, and the shape, of a coordinate file; symmetric and skew-symmetric ones are
    filled up, patterns have ones."""
    rows = text.lines(spark, path)
    head = rows.orderBy("line").limit(1).first()
    banner = head["value"].lower().split() if head else []
    if len(banner) < 5 or banner[0] != "%%matrixmarket" or banner[2] != "coordinate":
        raise ValueError("no coordinate matrix")
    field, symmetry = banner[3], banner[4]
    if field == "complex" or symmetry == "hermitian":
        raise ValueError("complex matrices are not read")
    c = _cells(rows, "%")
    size = c.orderBy("line").limit(1).first()
    v = F.lit(1.0) if field == "pattern" else F.col("c")[2].cast("double")
    body = c.filter(F.col("line") > size["line"]).select((F.col("c")[0].cast("long") - 1).alias("i"), (F.col("c")[1].cast("long") - 1).alias("j"), v.alias("v"))
    if symmetry != "general":
        sign = -1.0 if symmetry.startswith("skew") else 1.0
        body = body.unionByName(body.filter("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), (F.col("v") * sign).alias("v")))
    return body, (int(size["c"][0]), int(size["c"][1]))


def write_matrix_market(m: DataFrame, shape: tuple[int, int], path: str) -> None:
    body = m.select("i", "j", F.concat_ws(" ", (F.col("i") + 1).cast("string"), (F.col("j") + 1).cast("string"), F.col("v").cast("string")).alias("value"))
    _ordered(["%%MatrixMarket matrix coordinate real general", f"{shape[0]} {shape[1]} {m.count()}"], body, ["j", "i"], path)


def write_snap(g: Graph, path: str) -> None:
    """``u tab v`` with a header of comments."""
    body = g.edges.select("src", "dst", F.concat_ws("\t", F.col("src").cast("string"), F.col("dst").cast("string")).alias("value"))
    kind = "Directed" if g.directed else "Undirected"
    _ordered([f"# {kind} graph", f"# Nodes: {g.nodes.count()} Edges: {g.edges.count()}", "# FromNodeId\tToNodeId"], body, ["src", "dst"], path)


def write_dot(g: Graph, path: str, blocks: DataFrame | None = None) -> None:
    """GraphViz; with ``blocks`` each node has the number of its block as a colour."""
    arrow = " -> " if g.directed else " -- "
    label = F.concat(F.lit(' [label="'), F.col("w").cast("string"), F.lit('"]')) if g.weighted else F.lit("")
    lines = g.edges.select(F.lit(1).alias("k"), F.col("src").alias("a"), F.col("dst").alias("b"), F.concat(F.lit("  "), F.col("src").cast("string"), F.lit(arrow), F.col("dst").cast("string"), label, F.lit(";")).alias("value"))
    mark = F.concat(F.lit("  "), F.col("id").cast("string"), F.lit(";"))
    nodes = g.nodes
    if blocks is not None:
        nodes = nodes.join(blocks.select(F.col("node").alias("id"), "block"), "id", "left")
        mark = F.concat(F.lit("  "), F.col("id").cast("string"), F.coalesce(F.concat(F.lit(' [style=filled, colorscheme=set312, fillcolor="'), (F.pmod("block", F.lit(12)) + 1).cast("string"), F.lit('"]')), F.lit("")), F.lit(";"))
    rows = nodes.select(F.lit(0).alias("k"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), mark.alias("value")).unionByName(lines)
    end = g.spark.createDataFrame([(2, 0, 0, "}")], "k int, a long, b long, value string")
    _ordered(["digraph {" if g.directed else "graph {"], rows.unionByName(end), ["k", "a", "b"], path)


def read_dibap(spark: SparkSession, path: str) -> Graph:
    """Lines of a node's weight, degree and neighbours (from 1) behind a header of the nodes' number."""
    c = _cells(text.lines(spark, path), "#", "%")
    head = c.orderBy("line").limit(1).first()
    n = int(head["c"][0])
    body = numbered(c.filter(F.col("line") > head["line"]), ["line"], "u")
    pairs = body.select(F.col("u").cast("long").alias("src"), F.explode(F.slice("c", 3, 1 << 30)).alias("x"))
    return graph(pairs.select("src", (F.col("x").cast("long") - 1).alias("dst")), spark.range(n), duplicates="one")


# --- partitions and covers ---


def write_partition(blocks: DataFrame, path: str) -> None:
    """Line i has the block of node i; nodes are dense from 0."""
    _ordered([], blocks.select("node", F.col("block").cast("string").alias("value")), ["node"], path)


def write_cover(cover: DataFrame, path: str) -> None:
    """A line of members for each block."""
    body = cover.groupBy("block").agg(F.array_join(F.transform(F.array_sort(F.collect_list("node")), lambda x: x.cast("string")), " ").alias("value"))
    _ordered([], body, ["block"], path)


def read_edge_list_cover(spark: SparkSession, path: str, first: int = 1) -> DataFrame:
    """``(node, block)`` of ``node block block ...`` lines."""
    c = _cells(spark.read.text(path), "#")
    return c.select((F.col("c")[0].cast("long") - first).alias("node"), F.explode(F.slice("c", 2, 1 << 30)).alias("x")).select("node", F.col("x").cast("long").alias("block"))


def read_snap_partition(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """A line of members for each block; ``ids``: ``(key, id)`` of names."""
    rows = text.read_cover(spark, path) if ids is None else numbered(text.lines(spark, path).filter(~F.col("value").startswith("#")), ["line"], "block").select(F.explode(F.split(F.trim("value"), "\\s+")).alias("key"), "block").join(ids, "key").select(F.col("id").alias("node"), "block")
    return rows


def write_binary_partition(blocks: DataFrame, path: str, width: int = 4) -> None:
    """Little-endian block numbers of nodes 0, 1, ..., ``width`` bytes each; one file for each range of
    nodes, in order."""
    _write_records(blocks.select("node", "block"), ["node"], lambda t: t.column(1).to_numpy().astype(f"<u{width}"), path)


def read_binary_partition(spark: SparkSession, path: str, width: int = 4) -> DataFrame:
    return _read_records(spark, path, width, lambda a, at: {"node": at + np.arange(len(a) // width), "block": a.view(f"<u{width}").astype(np.int64)}, "node long, block long")


def write_binary_pairs(pairs: DataFrame, path: str, width: int = 4) -> None:
    """Little-endian (node, block) records."""
    _write_records(pairs.select("node", "block"), ["node", "block"], lambda t: np.stack([c.to_numpy().astype(f"<u{width}") for c in t.columns], 1), path)


def read_binary_pairs(spark: SparkSession, path: str, width: int = 4) -> DataFrame:
    return _read_records(spark, path, 2 * width, lambda a, at: dict(zip(("node", "block"), a.view(f"<u{width}").reshape(-1, 2).T.astype(np.int64), strict=True)), "node long, block long")


def _write_records(rows: DataFrame, order: list[str], encode: Callable, path: str) -> None:
    """A table ``(part, data)`` of packed records in order, as a folder of Parquet: the bytes of a
    shared store without paths local to an executor; ``export`` joins them into one file."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"data": [np.ascontiguousarray(encode(b)).tobytes()]})

    packed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(kernel, "data binary")
    packed.select(F.monotonically_increasing_id().alias("part"), "data").write.parquet(path)


def export(spark: SparkSession, path: str) -> bytes:
    """The records of a written binary table as one string, for small files."""
    return b"".join(bytes(r["data"]) for r in spark.read.parquet(path).orderBy("part").toLocalIterator())


def _read_records(spark: SparkSession, path: str, size: int, decode: Callable, schema: str) -> DataFrame:
    """Either such a folder, or plain binary files, each read by one task."""
    packed = _is_packed(spark, path)
    rows = spark.read.parquet(path).select("part", "data") if packed else spark.read.format("binaryFile").load(path).select(F.col("path").alias("part"), F.col("content").alias("data"))
    ordered = numbered(rows.withColumn("n", F.length("data")), ["part"], "k")
    from weftgraph.operators.generators import numbered_sum

    held = numbered_sum(ordered.select("k", "data", "n"), "n")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, begin in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_pydict(decode(np.frombuffer(data.as_buffer(), np.uint8), begin // size))

    return held.select("data", F.col("begin").cast("long")).mapInArrow(kernel, schema)


def _is_packed(spark: SparkSession, path: str) -> bool:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path").limit(1).count()
    return files > 0


# --- binary graphs ---


def read_thrill(spark: SparkSession, path: str, n: int | None = None) -> Graph:
    """Adjacency records: a varint of the degree, then the neighbours as 32-bit numbers; node i is the
    i-th record. Each file is decoded by one task, files continue each other."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw, at, node, src, dst = data.as_buffer().to_pybytes(), 0, 0, [], []
                while at < len(raw):
                    degree = shift = 0
                    while True:
                        byte = raw[at]
                        at += 1
                        degree |= (byte & 0x7F) << shift
                        shift += 7
                        if byte < 0x80:
                            break
                    near = np.frombuffer(raw, "<u4", degree, at)
                    at += 4 * degree
                    src.append(np.full(degree, node))
                    dst.append(near.astype(np.int64))
                    node += 1
                empty = np.zeros(0, np.int64)
                yield pa.RecordBatch.from_pydict({"file": [name] * (sum(map(len, src)) + 1), "n": np.full(sum(map(len, src)) + 1, node), "src": np.concatenate([*src, [-1]]), "dst": np.concatenate([*dst, empty, [-1]])})

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(kernel, "file string, n long, src long, dst long")
    from weftgraph.lineage import cut

    rows = cut(rows)
    sizes = sorted((r["file"], r["n"]) for r in rows.filter("src = -1").select("file", "n").collect())  # a row for each file
    shift, total = [], 0
    for name, count in sizes:
        shift.append((name, total))
        total += count
    at = spark.createDataFrame(shift or [("", 0)], "file string, shift long")
    edges = rows.filter("src >= 0").join(F.broadcast(at), "file").select((F.col("src") + F.col("shift")).alias("src"), "dst")
    return graph(edges, spark.range(max(n or 0, total)), duplicates="one")


def thrill_bytes(g: Graph) -> DataFrame:
    """``(id, data)``: the record of each node, each edge at its larger end (``src``)."""
    near = g.edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("near"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v in b.column(1).to_pylist():
                v, head, n = v or [], bytearray(), len(v or [])
                while True:
                    head.append(n & 0x7F | (0x80 if n > 0x7F else 0))
                    n >>= 7
                    if not n:
                        break
                out.append(bytes(head) + struct.pack(f"<{len(v)}I", *v))
            yield pa.RecordBatch.from_pydict({"id": b.column(0), "data": out})

    return g.nodes.join(near, "id", "left").select("id", "near").mapInArrow(kernel, "id long, data binary")


# --- nested formats: one task for each file ---


def _documents(spark: SparkSession, path: str, parse: Callable[[str], tuple[list[tuple], list[tuple]]]) -> DataFrame:
    """``(kind, a, b, w)``: kind 0 a node with the key a, 1 a directed and 2 an undirected edge."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0).to_pylist():
                rows = parse(content)
                kind, x, y, w = zip(*rows, strict=True) if rows else ((),) * 4
                yield pa.RecordBatch.from_pydict({"at": np.arange(len(rows)), "kind": pa.array(kind, pa.int32()), "a": pa.array(x, pa.string()), "b": pa.array(y, pa.string()), "w": pa.array(w, pa.float64())})

    return spark.read.text(path, wholetext=True).mapInArrow(kernel, "at long, kind int, a string, b string, w double")


def _keyed(rows: DataFrame) -> tuple[Graph, DataFrame]:
    """The graph of such rows, and the ids ``(key, id)`` of its keys in their order."""
    from weftgraph.lineage import cut

    rows = cut(rows)
    ids = numbered(rows.filter("kind = 0").groupBy(F.col("a").alias("key")).agg(F.min("at").alias("at")), ["at"], "id").select("key", F.col("id").cast("long").alias("id"))
    ends = rows.filter("kind > 0").join(ids.select(F.col("key").alias("a"), F.col("id").alias("src")), "a").join(ids.select(F.col("key").alias("b"), F.col("id").alias("dst")), "b")
    directed = rows.filter("kind = 1").limit(1).count() > 0
    weighted = rows.filter("kind > 0 AND w IS NOT NULL").limit(1).count() > 0
    return graph(ends.select("src", "dst", "w"), ids.select("id"), directed, weighted, w="w"), ids


GML = re.compile(r'"[^"]*"|\[|\]|[^\s\[\]]+')


def parse_gml(content: str) -> list[tuple]:
    tokens = GML.findall(re.sub(r"(?m)^\s*#.*$", "", content))

    def block(at: int) -> tuple[list[tuple], int]:
        out: list[tuple] = []
        while at < len(tokens) and tokens[at] != "]":
            key, value = tokens[at].lower(), tokens[at + 1]
            if value == "[":
                inner, at = block(at + 2)
                out.append((key, inner))
            else:
                out.append((key, value.strip('"')))
                at += 2
        return out, at + 1

    top = dict(block(0)[0]).get("graph", [])
    kind = 1 if dict((k, v) for k, v in top if isinstance(v, str)).get("directed") == "1" else 2
    rows: list[tuple] = []
    for key, inner in top:
        if key == "node":
            rows.append((0, dict(inner)["id"], None, None))
        elif key == "edge":
            e = dict(inner)
            w = e.get("weight", e.get("value"))
            rows.append((kind, e["source"], e["target"], float(w) if w is not None else None))
    return rows


def read_gml(spark: SparkSession, path: str) -> tuple[Graph, DataFrame]:
    return _keyed(_documents(spark, path, parse_gml))


def write_gml(g: Graph, path: str) -> None:
    node = g.nodes.select(F.lit(0).alias("k"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.concat(F.lit("  node [ id "), F.col("id").cast("string"), F.lit(" ]")).alias("value"))
    weight = F.concat(F.lit(" weight "), F.col("w").cast("string")) if g.weighted else F.lit("")
    edge = g.edges.select(F.lit(1).alias("k"), F.col("src").alias("a"), F.col("dst").alias("b"), F.concat(F.lit("  edge [ source "), F.col("src").cast("string"), F.lit(" target "), F.col("dst").cast("string"), weight, F.lit(" ]")).alias("value"))
    end = g.spark.createDataFrame([(2, 0, 0, "]")], "k int, a long, b long, value string")
    _ordered(["graph [", f"  directed {int(g.directed)}"], node.unionByName(edge).unionByName(end), ["k", "a", "b"], path)


def _tag(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def parse_graphml(content: str) -> list[tuple]:
    root = ElementTree.fromstring(content)
    weights = {e.get("id") for e in root.iter() if _tag(e) == "key" and e.get("for") in ("edge", None) and e.get("attr.name") == "weight"}
    rows: list[tuple] = []
    for top in (e for e in root.iter() if _tag(e) == "graph"):
        by_default = top.get("edgedefault") == "directed"
        for e in top:
            if _tag(e) == "node":
                rows.append((0, e.get("id"), None, None))
            elif _tag(e) == "edge":
                directed = {"true": True, "false": False}.get(e.get("directed", ""), by_default)
                w = next((float(d.text) for d in e if _tag(d) == "data" and d.get("key") in weights), None)
                rows.append((1 if directed else 2, e.get("source"), e.get("target"), w))
    return rows


def read_graphml(spark: SparkSession, path: str) -> tuple[Graph, DataFrame]:
    return _keyed(_documents(spark, path, parse_graphml))


def write_graphml(g: Graph, path: str) -> None:
    node = g.nodes.select(F.lit(0).alias("k"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.concat(F.lit('  <node id="'), F.col("id").cast("string"), F.lit('"/>')).alias("value"))
    data = F.concat(F.lit('"><data key="w">'), F.col("w").cast("string"), F.lit("</data></edge>")) if g.weighted else F.lit('"/>')
    edge = g.edges.select(F.lit(1).alias("k"), F.col("src").alias("a"), F.col("dst").alias("b"), F.concat(F.lit('  <edge source="'), F.col("src").cast("string"), F.lit('" target="'), F.col("dst").cast("string"), data).alias("value"))
    end = g.spark.createDataFrame([(2, 0, 0, " </graph>"), (3, 0, 0, "</graphml>")], "k int, a long, b long, value string")
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', ' <key id="w" for="edge" attr.name="weight" attr.type="double"/>', f' <graph edgedefault={quoteattr("directed" if g.directed else "undirected")}>']
    _ordered(head, node.unionByName(edge).unionByName(end), ["k", "a", "b"], path)


def parse_gexf(content: str) -> list[tuple]:
    root = ElementTree.fromstring(content)
    rows: list[tuple] = []
    for top in (e for e in root.iter() if _tag(e) == "graph"):
        kind = 1 if top.get("defaultedgetype") == "directed" else 2
        for e in top.iter():
            if _tag(e) == "node":
                rows.append((0, e.get("id"), None, None))
            elif _tag(e) == "edge":
                w = e.get("weight")
                rows.append(({"directed": 1, "undirected": 2}.get(e.get("type", ""), kind), e.get("source"), e.get("target"), float(w) if w else None))
    return rows


def read_gexf(spark: SparkSession, path: str) -> tuple[Graph, DataFrame]:
    """The static part: nodes and edges whatever their times."""
    return _keyed(_documents(spark, path, parse_gexf))


def write_gexf(g: Graph, path: str) -> None:
    node = g.nodes.select(F.lit(0).alias("k"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.concat(F.lit('   <node id="'), F.col("id").cast("string"), F.lit('"/>')).alias("value"))
    edge = g.edges.select(F.lit(2).alias("k"), F.col("src").alias("a"), F.col("dst").alias("b"), F.concat(F.lit('   <edge source="'), F.col("src").cast("string"), F.lit('" target="'), F.col("dst").cast("string"), F.lit('" weight="'), F.col("w").cast("string"), F.lit('"/>')).alias("value"))
    marks = g.spark.createDataFrame([(1, 0, 0, "  </nodes>\n  <edges>"), (3, 0, 0, "  </edges>\n </graph>\n</gexf>")], "k int, a long, b long, value string")
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2">', f' <graph mode="static" defaultedgetype="{"directed" if g.directed else "undirected"}">', "  <nodes>"]
    _ordered(head, node.unionByName(edge).unionByName(marks), ["k", "a", "b"], path)


# --- event streams ---


def read_dgs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Events of a DGS file (an, dn, ae, ce, de, st), and the ids ``(key, id)`` of its node names. An
    edge is named by its own key, which later lines use."""
    rows = text.lines(spark, path)
    c = _cells(rows, "#").filter(~F.col("value").startswith("DGS")).withColumn("op", F.lower(F.col("c")[0])).filter(F.col("op").isin("an", "dn", "ae", "ce", "de", "st"))
    key = F.regexp_replace(F.col("c")[1], '"', "")
    tail = F.transform(F.slice("c", 3, 1 << 30), lambda x: F.regexp_replace(x, '[">]|--', ""))
    w = F.regexp_extract("value", r"weight\s*=\s*([0-9.eE+-]+)", 1)
    flat = c.select("line", "op", key.alias("key"), F.filter(tail, lambda x: (x != "") & ~x.contains("=")).alias("t"), F.when(w != "", w.cast("double")).alias("w"))
    names = flat.filter("op = 'an'").select("key", "line").unionByName(flat.filter("op = 'ae'").select(F.explode(F.slice("t", 1, 2)).alias("key"), "line"))
    ids = numbered(names.groupBy("key").agg(F.min("line").alias("line")), ["line", "key"], "id").select("key", F.col("id").cast("long").alias("id"))
    born = flat.filter("op = 'ae'").select("key", F.get("t", F.lit(0)).alias("a"), F.get("t", F.lit(1)).alias("b")).dropDuplicates(["key"])
    edge = flat.filter("op IN ('ae', 'ce', 'de')").join(born, "key").join(ids.select(F.col("key").alias("a"), F.col("id").alias("u")), "a").join(ids.select(F.col("key").alias("b"), F.col("id").alias("v")), "b")
    kind = F.when(F.col("op") == "ae", "edge_add").when(F.col("op") == "ce", "weight").otherwise("edge_remove")
    edge = edge.select("line", kind.alias("type"), "u", "v", F.coalesce("w", F.when(F.col("op") == "ae", 1.0)).alias("w"))
    none = F.lit(None)
    node = flat.filter("op IN ('an', 'dn')").join(ids, "key").select("line", F.when(F.col("op") == "an", "node_add").otherwise("node_remove").alias("type"), F.col("id").alias("u"), none.cast("long").alias("v"), none.cast("double").alias("w"))
    tick = flat.filter("op = 'st'").select("line", F.lit("step").alias("type"), none.cast("long").alias("u"), none.cast("long").alias("v"), none.cast("double").alias("w"))
    both = edge.unionByName(node)
    seq = numbered(both.unionByName(tick).withColumn("tick", (F.col("type") == "step").cast("long")), ["line"], "seq")
    from weftgraph.operators.generators import numbered_sum

    return numbered_sum(seq.withColumnRenamed("seq", "k"), "tick").filter("type <> 'step'").select(F.col("k").cast("long").alias("seq"), F.col("begin").cast("long").alias("step"), "type", "u", "v", "w"), ids


def write_dgs(events: DataFrame, path: str) -> None:
    """The events with a line for the end of each step."""
    u, v = F.col("u").cast("string"), F.col("v").cast("string")
    edge = F.concat(u, F.lit("-"), v)
    weight = F.concat(F.lit(" weight="), F.col("w").cast("string"))
    line = (
        F.when(F.col("type") == "node_add", F.concat(F.lit("an "), u)).when(F.col("type") == "node_remove", F.concat(F.lit("dn "), u))
        .when(F.col("type") == "edge_add", F.concat(F.lit("ae "), edge, F.lit(" "), u, F.lit(" "), v, F.coalesce(weight, F.lit(""))))
        .when(F.col("type") == "edge_remove", F.concat(F.lit("de "), edge)).otherwise(F.concat(F.lit("ce "), edge, F.coalesce(weight, F.lit(""))))
    )
    body = events.select("step", F.lit(0).alias("k"), "seq", line.alias("value"))
    ends = events.groupBy("step").agg(F.max("seq").alias("seq")).select("step", F.lit(1).alias("k"), "seq", F.concat(F.lit("st "), (F.col("step") + 1).cast("string")).alias("value"))
    _ordered(["DGS004", "graph 0 0"], body.unionByName(ends), ["step", "k", "seq"], path)


# --- dispatch ---


def _alone(read: Callable) -> Callable:
    def one(spark: SparkSession, path: str, **how) -> Graph:
        found = read(spark, path, **how)
        return found[0] if isinstance(found, tuple) else found

    return one


def _matrix_graph(spark: SparkSession, path: str) -> Graph:
    m, (rows, columns) = read_matrix_market(spark, path)
    return Graph(spark.range(max(rows, columns)), m.select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("v").alias("w")), True, True)


READERS: dict[str, Callable] = {
    "edgelist": _alone(text.read_edge_list), "metis": text.read_metis, "snap": _alone(text.read_snap), "konect": read_konect, "gml": _alone(read_gml), "graphml": _alone(read_graphml),
    "gexf": _alone(read_gexf), "mtx": _matrix_graph, "thrill": read_thrill, "dibap": read_dibap,
}
WRITERS: dict[str, Callable] = {"edgelist": text.write_edge_list, "metis": text.write_metis, "snap": write_snap, "gml": write_gml, "graphml": write_graphml, "gexf": write_gexf, "dot": write_dot}


def read_graph(spark: SparkSession, path: str, form: str, **how) -> Graph:
    """A graph in any of ``READERS``."""
    if form not in READERS:
        raise ValueError(f"no reader of {form}; there are {', '.join(sorted(READERS))}")
    return READERS[form](spark, path, **how)


def write_graph(g: Graph, path: str, form: str, **how) -> None:
    if form not in WRITERS:
        raise ValueError(f"no writer of {form}; there are {', '.join(sorted(WRITERS))}")
    WRITERS[form](g, path, **how)


def convert(spark: SparkSession, source: str, form: str, target: str, other: str) -> None:
    write_graph(read_graph(spark, source, form), target, other)
