"""Text formats of graphs and partitions. Files are read line by line by Spark; where a line's
number matters it is made from the file's order, without a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.graph import Graph, graph


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line, value)``: lines in order from 0, the files of a folder in the order of their names. A
    split's rows are numbered where they are read, and shifted by the splits before it."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("at"))
    sizes = rows.groupBy("f", "b").agg(F.count("*").alias("n"), F.min("at").alias("first"))  # a row for each split
    shift = sizes.select("f", "b", "first", F.coalesce(F.sum("n").over(Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s"))
    return rows.join(F.broadcast(shift), ["f", "b"]).select((F.col("s") + F.col("at") - F.col("first")).alias("line"), "value")


def read_edge_list(spark: SparkSession, path: str, separator: str = "\t", first: int = 0, comment: str = "#", continuous: bool = True, directed: bool = False) -> tuple[Graph, DataFrame | None]:
    """A graph of ``u sep v [w]`` lines, and the names' ids if not ``continuous``.

    The first row of data decides whether there are weights. ``continuous``: ids are numbers from
    ``first``, and all up to the greatest are nodes; else names, with ids in the order of first
    sight. Of repeated edges the first stays.
    """
    cells = F.split(F.trim("value"), separator if len(separator) > 1 else f"[{separator}]+")
    data = lines(spark, path).filter(~F.trim("value").startswith(comment) & (F.trim("value") != "")).select("line", cells.alias("c"))
    head = data.orderBy("line").limit(1).first()
    weighted = head is not None and len(head["c"]) > 2
    w = F.try_element_at("c", F.lit(3)).cast("double") if weighted else F.lit(1.0)
    rows = data.select("line", F.trim(F.element_at("c", 1)).alias("a"), F.trim(F.element_at("c", 2)).alias("b"), w.alias("w"))
    names = None
    if continuous:
        rows = rows.select("line", (F.col("a").cast("long") - first).alias("src"), (F.col("b").cast("long") - first).alias("dst"), "w")
        last = rows.agg(F.coalesce(F.max(F.greatest("src", "dst")), F.lit(-1)).alias("last"))
        nodes = last.filter("last >= 0").select(F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("id"))
    else:
        from weftgraph.graph import numbered

        seen = rows.select(F.col("a").alias("key"), (F.col("line") * 2).alias("at")).unionByName(rows.select(F.col("b").alias("key"), (F.col("line") * 2 + 1).alias("at")))
        names = numbered(seen.groupBy("key").agg(F.min("at").alias("at")), ["at"], "id").select("key", F.col("id").cast("long").alias("id"))
        rows = rows.join(names.select(F.col("key").alias("a"), F.col("id").alias("src")), "a").join(names.select(F.col("key").alias("b"), F.col("id").alias("dst")), "b").select("line", "src", "dst", "w")
        nodes = names.select("id")
    if not directed:
        rows = rows.select("line", F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"), "w")
    first_ = rows.groupBy("src", "dst").agg(F.min_by("w", "line").alias("w"))
    return graph(first_, nodes, directed, weighted, w="w"), names


def write_edge_list(g: Graph, path: str, separator: str = "\t", first: int = 0, both: bool = False) -> None:
    rows = g.adjacency.select(F.col("u").alias("src"), F.col("v").alias("dst"), "w") if both and not g.directed else g.edges
    cells = [(F.col("src") + first).cast("string"), (F.col("dst") + first).cast("string"), *([F.col("w").cast("string")] if g.weighted else [])]
    rows.select(F.concat_ws(separator, *cells).alias("value")).write.text(path)


def read_metis(spark: SparkSession, path: str) -> Graph:
    """METIS: a header ``n m [fmt [ncon]]``, then the neighbours (from 1) of each node by line, with
    edge weights where fmt ends in 1 and after ``ncon`` node weights where its tens digit is 1."""
    data = lines(spark, path).filter(~F.trim("value").startswith("%"))
    top = data.orderBy("line").limit(1).first()
    if top is None:
        raise ValueError("no header")
    head = [int(x) for x in top["value"].split()]
    n, fmt = head[0], head[2] if len(head) > 2 else 0
    weighted, skip = fmt % 10 == 1, (head[3] if len(head) > 3 else 1) if fmt // 10 % 10 == 1 else 0
    from weftgraph.graph import numbered

    body = numbered(data.filter(F.col("line") > top["line"]), ["line"], "u").filter(F.col("u") < n)
    cells = F.expr(f"slice(filter(split(trim(value), '\\\\s+'), x -> x <> ''), {skip + 1}, 1000000000)")
    step = 2 if weighted else 1
    pairs = body.select("u", F.posexplode(cells).alias("k", "x"), cells.alias("c")).filter(F.col("k") % step == 0)
    w = F.get("c", F.col("k") + 1).cast("double") if weighted else F.lit(1.0)
    half = pairs.select(F.col("u").cast("long").alias("u"), (F.col("x").cast("long") - 1).alias("v"), w.alias("w")).filter("v >= 0")
    edges = half.select(F.greatest("u", "v").alias("src"), F.least("u", "v").alias("dst"), "w").groupBy("src", "dst").agg(F.min("w").alias("w"))
    return graph(edges, spark.range(n), False, weighted, w="w")


def write_metis(g: Graph, path: str) -> None:
    """Needs dense ids from 0; one file, as the format's lines have an order."""
    size = (g.nodes.count(), g.edges.count())
    cell = F.concat_ws(" ", (F.col("v") + 1).cast("string"), *([F.col("w").cast("string")] if g.weighted else []))
    near = g.adjacency.groupBy("u").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("v", cell.alias("c")))), lambda x: x["c"]), " ").alias("value"))
    body = g.nodes.join(near, F.col("id") == F.col("u"), "left").select("id", F.coalesce("value", F.lit("")).alias("value"))
    head = g.spark.createDataFrame([(-1, f"{size[0]} {size[1]} {1 if g.weighted else 0}")], "id long, value string")
    head.unionByName(body).coalesce(1).sortWithinPartitions("id").select("value").write.text(path)


def read_snap(spark: SparkSession, path: str, directed: bool = False, remap: bool = True) -> tuple[Graph, DataFrame | None]:
    """SNAP: tab-separated pairs, ``#`` comments; ids as they are or in the order of first sight."""
    return read_edge_list(spark, path, "\t ", 0, "#", not remap, directed)


def read_partition(spark: SparkSession, path: str) -> DataFrame:
    """``(node, block)``: line i has the block of node i."""
    return lines(spark, path).filter("trim(value) <> ''").select(F.col("line").alias("node"), F.trim("value").cast("long").alias("block"))


def read_edge_list_partition(spark: SparkSession, path: str, separator: str = "\t", first: int = 1) -> DataFrame:
    """``(node, block)`` of ``node sep block`` lines."""
    c = F.split("value", separator)
    rows = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return rows.select((F.element_at(c, 1).cast("long") - first).alias("node"), F.element_at(c, 2).cast("long").alias("block"))


def read_cover(spark: SparkSession, path: str) -> DataFrame:
    """``(node, block)``: line i has the members of block i; comments do not count."""
    from weftgraph.graph import numbered

    rows = numbered(lines(spark, path).filter(~F.col("value").startswith("#")), ["line"], "block")
    return rows.select(F.explode(F.split(F.trim("value"), "\\s+")).alias("x"), F.col("block").cast("long").alias("block")).filter("x <> ''").select(F.col("x").cast("long").alias("node"), "block")
