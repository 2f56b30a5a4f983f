"""Graphs derived from the sales tables, as DataFrames and as SQL that builds the same tables. They
are computed once, so that a query reads each table once however often it uses the edges.

* ``trade``: directed, weighted, nation of the customer -> nation of the supplier, w = line items;
* ``copurchase(least)``: undirected, weighted, parts bought together in at least ``least`` orders
  (nodes: all parts); with 1 the whole graph, with 2 one with isolated nodes for queries over pairs at two steps;
* ``basket``: bipartite, customer - part (ids shifted beyond the customers') of all line items;
* ``heavy``, ``flows``: the pairs of nations that trade more than most, undirected and directed;
* ``brands`` and ``sizes``: partitions of the parts.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.graph import Graph, canonical, graph, spread
from weftgraph.lineage import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade(spark: SparkSession, sf_dir: str) -> Graph:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("src"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("dst"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    edges = rows.groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))
    return graph(edges, nodes, directed=True, w="w").kept()


def copurchase(spark: SparkSession, sf_dir: str, least: int = 2) -> Graph:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = spread(spark, lines.count())
    bought = lines.repartition(parts, "l_orderkey").distinct()
    # An order has a handful of lines, so that its pairs are few.
    pairs = bought.join(bought.withColumnRenamed("l_partkey", "other"), "l_orderkey").filter("l_partkey > other")
    ends = pairs.select(F.col("l_partkey").cast("long").alias("src"), F.col("other").cast("long").alias("dst")).repartition(2 * parts, "src", "dst")
    edges = ends.groupBy("src", "dst").agg(F.count("*").cast("double").alias("w")).filter(F.col("w") >= least)
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    # The rows are canonical as they are, and stay where they lie.
    return replace(graph(edges, nodes, w="w"), edges=edges).kept()


def basket(spark: SparkSession, sf_dir: str) -> Graph:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = spread(spark, lines.count())
    shift = table(spark, sf_dir, "customer").agg((F.max("c_custkey") + 1).alias("shift"))
    rows = lines.repartition(parts, "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).crossJoin(shift)  # one row
    ends = rows.select(F.col("o_custkey").cast("long").alias("src"), (F.col("l_partkey") + F.col("shift")).cast("long").alias("dst")).dropna().select(*canonical())
    # Kept before the nodes are taken from them, so that the tables are joined once.
    edges = cut(ends.repartition(parts, "src", "dst").distinct().withColumn("w", F.lit(1.0)))
    return replace(graph(edges), edges=edges).kept()


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("node"), F.col("p_size").cast("long").alias("block"))


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("node"), F.col("p_brand").alias("block"))


TRADE = """nodes AS (SELECT n_nationkey::BIGINT AS id FROM nation), edges AS (
  SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, count(*)::DOUBLE AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  GROUP BY 1, 2), adj AS (SELECT src AS u, dst AS v, w FROM edges), rev AS (SELECT dst AS u, src AS v, w FROM edges)"""


def copurchase_sql(least: int = 2) -> str:
    return f"""bought AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), nodes AS (SELECT p_partkey AS id FROM part), edges AS (
  SELECT a.l_partkey AS src, b.l_partkey AS dst, count(*)::DOUBLE AS w FROM bought a JOIN bought b ON a.l_orderkey = b.l_orderkey AND a.l_partkey > b.l_partkey
  GROUP BY 1, 2 HAVING count(*) >= {least}), adj AS (SELECT src AS u, dst AS v, w FROM edges UNION ALL SELECT dst, src, w FROM edges),
  deg AS (SELECT id, count(v) AS d, coalesce(sum(w), 0) AS wd FROM nodes LEFT JOIN adj ON id = u GROUP BY id),
  size_of AS (SELECT p_partkey AS node, p_size::BIGINT AS block FROM part), brand_of AS (SELECT p_partkey AS node, p_brand AS block FROM part)"""


BASKET = """edges AS MATERIALIZED (SELECT DISTINCT greatest(o_custkey, l_partkey + (SELECT max(c_custkey) + 1 FROM customer)) AS src,
  least(o_custkey, l_partkey + (SELECT max(c_custkey) + 1 FROM customer)) AS dst, 1.0::DOUBLE AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  nodes AS MATERIALIZED (SELECT DISTINCT id FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges)),
  adj AS MATERIALIZED (SELECT src AS u, dst AS v, w FROM edges UNION ALL SELECT dst, src, w FROM edges)"""


def heavy(spark: SparkSession, sf_dir: str) -> Graph:
    """Undirected, weighted: pairs of different nations whose trade is over the mean of all pairs."""
    both = trade(spark, sf_dir).edges.filter("src <> dst").select(*canonical(), "w").groupBy("src", "dst").agg(F.sum("w").alias("w"))
    mean = both.agg(F.avg("w").alias("mean"))
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))
    return graph(both.crossJoin(mean).filter("w > 1.1 * mean").drop("mean"), nodes, w="w").kept()  # one row


def flows(spark: SparkSession, sf_dir: str) -> Graph:
    """Directed, weighted: the same over ordered pairs."""
    rows = trade(spark, sf_dir).edges.filter("src <> dst")
    mean = rows.agg(F.avg("w").alias("mean"))
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))
    return graph(rows.crossJoin(mean).filter("w > 1.15 * mean").drop("mean"), nodes, directed=True, w="w").kept()  # one row


_ALL = TRADE.replace("nodes AS", "nodes AS MATERIALIZED").replace("edges AS (", "every AS MATERIALIZED (").split(", adj AS")[0]
HEAVY = f"""{_ALL}, pairs AS MATERIALIZED (SELECT greatest(src, dst) AS src, least(src, dst) AS dst, sum(w) AS w FROM every WHERE src <> dst GROUP BY 1, 2),
  edges AS MATERIALIZED (SELECT * FROM pairs WHERE w > 1.1 * (SELECT avg(w) FROM pairs)),
  adj AS MATERIALIZED (SELECT src AS u, dst AS v, w FROM edges UNION ALL SELECT dst, src, w FROM edges),
  deg AS MATERIALIZED (SELECT id, count(v) AS d, coalesce(sum(w), 0) AS wd FROM nodes LEFT JOIN adj ON id = u GROUP BY id)"""
FLOWS = f"""{_ALL}, edges AS MATERIALIZED (SELECT * FROM every WHERE src <> dst AND w > 1.15 * (SELECT avg(w) FROM every WHERE src <> dst)),
  adj AS MATERIALIZED (SELECT src AS u, dst AS v, w FROM edges)"""
