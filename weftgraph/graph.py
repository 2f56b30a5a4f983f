"""The graph: a table of nodes and a table of edges, with two flags.

``nodes(id)`` holds live nodes; an id that is not there is a hole. ``edges(src, dst, w)`` holds one
row for each edge; an undirected edge lies once, with ``src >= dst``. Weights of an unweighted graph
are 1. Multi-edges and self-loops may occur; a self-loop appears once in ``adjacency``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.lineage import cut


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    directed: bool = False
    weighted: bool = False

    @cached_property
    def adjacency(self) -> DataFrame:
        """``(u, v, w)``: out-neighbours; of an undirected graph both ways."""
        out = self.edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), "w")
        if self.directed:
            return out
        return out.unionByName(self.edges.filter("src <> dst").select(F.col("dst").alias("u"), F.col("src").alias("v"), "w"))

    @cached_property
    def reverse(self) -> DataFrame:
        """``(u, v, w)``: in-neighbours v of u."""
        if not self.directed:
            return self.adjacency
        return self.edges.select(F.col("dst").alias("u"), F.col("src").alias("v"), "w")

    def degrees(self, incoming: bool = False, loops: bool = True, twice: bool = False) -> DataFrame:
        """``(id, degree, weighted)`` of every node. ``loops``: count self-loops; ``twice``: at
        double weight."""
        rows = self.reverse if incoming else self.adjacency
        if not loops:
            rows = rows.filter("u <> v")
        w = F.when(F.col("u") == F.col("v"), F.col("w") * 2).otherwise(F.col("w")) if twice else F.col("w")
        found = rows.groupBy("u").agg(F.count("*").alias("degree"), F.sum(w).alias("weighted"))
        joined = self.nodes.join(found, F.col("id") == F.col("u"), "left")
        return joined.select("id", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("weighted", F.lit(0.0)).alias("weighted"))

    def kept(self) -> Graph:
        """The same graph, computed once; for loops and repeated use."""
        return replace(self, nodes=cut(self.nodes), edges=cut(self.edges))

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession


def spread(spark: SparkSession, rows: int, each: int = 500_000) -> int:
    """In how many partitions to put ``rows``: at most ``each`` in one on average, and all cores busy where the
    rows are worth it. AQE merges the partitions of its own exchanges until there are about as many as
    cores, whose tasks grow with the data; it leaves those of ``repartition`` with a number."""
    return max(-(-rows // each), min(spark.sparkContext.defaultParallelism, -(-rows // 20_000)), 1)


def canonical(src: str | Column = "src", dst: str | Column = "dst") -> tuple[Column, Column]:
    """The ends of an undirected edge, larger first."""
    return F.greatest(src, dst).alias("src"), F.least(src, dst).alias("dst")


def graph(edges: DataFrame, nodes: DataFrame | None = None, directed: bool = False, weighted: bool | None = None, src: str = "src", dst: str = "dst", w: str | None = None, duplicates: str = "keep") -> Graph:
    """A graph from rows of edges. Rows with a null end are dropped, a null weight is 1.

    ``duplicates``: ``keep`` multi-edges, ``sum`` their weights, keep the ``least`` weight, or
    keep ``one`` of them (weight: the least too, which makes it the same at each run).
    ``nodes``: ``(id)``; by default the ends of edges.
    """
    weight = F.coalesce(F.col(w).cast("double"), F.lit(1.0)) if w else F.lit(1.0)
    ends = (F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"))
    rows = edges.select(*ends, weight.alias("w")).dropna(subset=["src", "dst"])
    if not directed:
        rows = rows.select(*canonical(), "w")
    if duplicates != "keep":
        how = {"sum": F.sum, "least": F.min, "one": F.min}[duplicates]
        rows = rows.groupBy("src", "dst").agg(how("w").alias("w"))
    if nodes is None:
        nodes = rows.select(F.col("src").alias("id")).unionByName(rows.select(F.col("dst").alias("id"))).distinct()
    else:
        nodes = nodes.select(F.col(nodes.columns[0]).cast("long").alias("id")).dropna().distinct()
    return Graph(nodes, rows, directed, bool(w) if weighted is None else weighted)


def numbered(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """``df`` with consecutive numbers along ``order``, without bringing rows to one task: rows are
    range-partitioned, numbered within each partition and shifted by the sizes of those before."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    shift = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_place", place).join(F.broadcast(shift), "_part").withColumn(name, F.col("_place") + F.col("_shift") - 1 + start).drop("_part", "_place", "_shift")


def index_edges(g: Graph) -> Graph:
    """The graph with dense edge ids ``eid`` in the order of (src, dst, w)."""
    return replace(g, edges=numbered(g.edges, ["src", "dst", "w"], "eid"))
