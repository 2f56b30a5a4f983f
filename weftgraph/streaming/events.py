"""Graphs as streams of events ``(seq, type, u, v, w)``.

Types: ``node_add``, ``node_remove``, ``edge_add``, ``edge_remove``, ``weight`` (sets a weight),
``weight_add`` (raises one), ``step`` (a time mark). ``fold`` turns a finished stream into a graph by
one aggregate for each edge: what counts is what comes after its last removal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.graph import Graph

SCHEMA = "seq long, type string, u long, v long, w double"


def fold(events: DataFrame, directed: bool = False) -> Graph:
    """The graph after all events; weights of added edges, later set or raised. Removing a node
    removes its edges."""
    gone = events.filter("type = 'node_remove'").groupBy("u").agg(F.max("seq").alias("gone"))
    ends = events.filter("type IN ('edge_add', 'edge_remove', 'weight', 'weight_add')")
    if not directed:
        ends = ends.select("seq", "type", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), "w")
    dead = ends.filter("type = 'edge_remove'").groupBy("u", "v").agg(F.max("seq").alias("dead"))
    rows = ends.filter("type <> 'edge_remove'").join(dead, ["u", "v"], "left")
    rows = rows.join(gone, "u", "left").join(gone.select(F.col("u").alias("v"), F.col("gone").alias("gone2")), "v", "left")
    rows = rows.filter(F.col("seq") > F.greatest(F.coalesce("dead", F.lit(-1)), F.coalesce("gone", F.lit(-1)), F.coalesce("gone2", F.lit(-1))))
    base = F.max(F.when(F.col("type") != "weight_add", F.struct("seq", F.coalesce("w", F.lit(1.0)).alias("w"))))
    last = rows.groupBy("u", "v").agg(base.alias("base"), F.max((F.col("type") == "edge_add")).alias("there"), F.collect_list(F.when(F.col("type") == "weight_add", F.struct("seq", "w"))).alias("more"))
    more = F.aggregate(F.filter("more", lambda x: x["seq"] > F.col("base.seq")), F.lit(0.0), lambda a, x: a + x["w"])
    edges = last.filter("there").select(F.col("u").alias("src"), F.col("v").alias("dst"), (F.col("base.w") + more).alias("w"))
    added = events.filter("type = 'node_add'").select("seq", "u").unionByName(ends.filter("type = 'edge_add'").select("seq", F.explode(F.array("u", "v")).alias("u")))
    live = added.groupBy("u").agg(F.max("seq").alias("seq")).join(gone, "u", "left").filter("gone IS NULL OR seq > gone")
    return Graph(live.select(F.col("u").alias("id")), edges, directed, True)


def difference(before: Graph, after: Graph) -> DataFrame:
    """Events ``(type, u, v, w)`` that turn one graph into the other."""
    a, b = before.edges.select("src", "dst", F.col("w").alias("wa")), after.edges.select("src", "dst", F.col("w").alias("wb"))
    both = a.join(b, ["src", "dst"], "full")
    kind = F.when(F.col("wa").isNull(), "edge_add").when(F.col("wb").isNull(), "edge_remove").when(F.col("wa") != F.col("wb"), "weight")
    edges = both.select(kind.alias("type"), F.col("src").alias("u"), F.col("dst").alias("v"), F.col("wb").alias("w")).filter("type IS NOT NULL")
    new = after.nodes.join(before.nodes, "id", "left_anti").select(F.lit("node_add").alias("type"), F.col("id").alias("u"))
    old = before.nodes.join(after.nodes, "id", "left_anti").select(F.lit("node_remove").alias("type"), F.col("id").alias("u"))
    nodes = new.unionByName(old).select("type", "u", F.lit(None).cast("long").alias("v"), F.lit(None).cast("double").alias("w"))
    return edges.unionByName(nodes)


def steps(events: DataFrame) -> DataFrame:
    """``events`` with ``step``, the number of time marks before each; marks are few and are
    broadcast as ranges only by the planner's own choice."""
    marks = events.filter("type = 'step'").select("seq").withColumn("k", F.row_number().over(Window.orderBy("seq")))  # one row for each mark
    ranges = marks.select("k", F.col("seq").alias("lo"), F.lead("seq").over(Window.orderBy("seq")).alias("hi"))
    found = events.join(ranges, (F.col("seq") >= F.col("lo")) & (F.col("hi").isNull() | (F.col("seq") < F.col("hi"))), "left")
    return found.select(events.columns + [F.coalesce("k", F.lit(0)).alias("step")])


def activity(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Of a stream with ``ts`` and ``event_type``: counts and sums by window, late rows dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
