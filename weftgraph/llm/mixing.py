"""Mixing sources to target weights by systematic sampling.

A source's expected number of copies for each of its documents is target / size. Expected copies
are summed along the documents of a source, the longest first and equal ones by doc_id, one random
offset in [0, 1) is added for each source (from a hash of its name, so that reruns agree), and a document is
emitted once for each integer boundary that its interval crosses. In the order of sizes, the words
taken from documents of about one size are near their share, so a source misses its target by about
the words of its longest document. All sums are of integers (2**-24 copies), so their order does not
matter.

The prefix sum is distributed: documents are range-partitioned by (source, size, doc_id), which
cuts a hot source into many ranges, ranges are summed, and each range starts from the total of
those before it. No task holds a source.

Sizes are numbers of words. A null text has size 0. Sources are ordered by code point, a null
source last, and weigh 1, 2, 3, repeating; a target above ``most`` times its source's size is
lowered to that and the rest is shared again by weight, which is water-filling and is solved in
closed form over the sources. Rows that repeat source, doc_id and text are one unit of all their
words, found by partial counts: each of them is taken as often. Rows of one doc_id, or of none, with
different texts are units of their own. A source whose texts have no words gets target 0 and no
copies. Very long texts count whole. An empty table gives an empty result. Other columns, whatever
their names, do not matter and pass through ``mix_sources`` unchanged, but for ``copy``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import arrow_map, cut, table, tags, utf8

ONE = 1 << 24


def sized(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``(doc_id, source, t1, t2, size)``; t1 and t2 stand for the text, size: number of ``[^\\x20\\x09-\\x0D]+``."""

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            sizes = [len(t.as_py().split()) for t in batch.column(4)]
            yield {k: batch.column(i) for i, k in enumerate(("doc_id", "source", "t1", "t2"))} | {"size": sizes}

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), *tags(text), utf8(text).alias("text"))
    return arrow_map(rows, kernel, "doc_id long, source string, t1 long, t2 long, size long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """``(source, source_size, target)``: one row for each source."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weigh = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    ceiling = (F.lit(most) * F.col("source_size")).alias("ceiling")
    full = by.select("source", "source_size", weigh.cast("double").alias("weight"), ceiling)
    # Sources fill up in this order; those before the first that stays below its ceiling are full.
    order = Window.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").asc_nulls_first())
    before = F.coalesce(F.sum("ceiling").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = full.select("*", F.sum("source_size").over(whole).alias("total"), before.alias("before"), after.alias("after"))
    level = level.withColumn("level", (F.col("total") - F.col("before")) / F.col("after"))
    open_ = F.col("ceiling") > F.col("level") * F.col("weight")
    water = F.first(F.when(open_, F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    filled = level.withColumn("open", open_).withColumn("water", water)
    return filled.select("source", "source_size", F.when(F.col("open"), F.col("water") * F.col("weight")).otherwise(F.col("ceiling")).alias("target"))


KEY = ("doc_id", "source", "t1", "t2")


def allot(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, seed: str = "mix") -> DataFrame:
    """``(doc_id, source, t1, t2, n, size, source_size, target, copies)``: one row for each unit,
    of ``n`` equal rows with ``size`` words each."""
    spark = sizes.sparkSession
    goal = targets(sizes, weights, most)
    unit = sizes.groupBy(*KEY).agg(F.first("size").alias("size"), F.count("*").alias("n")).withColumn("fewer", -F.col("size") * F.col("n"))
    order = ["fewer", "doc_id", "t1", "t2"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(unit.repartitionByRange(parts, "source", *order).withColumn("part", F.spark_partition_id()))
    share = F.when(F.col("source_size") > 0, F.floor(F.col("target") * ONE / F.col("source_size"))).otherwise(0).cast("long")
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce("source", F.lit("null")))), 1, 6)
    goal = goal.select(F.col("source").alias("s"), "source_size", "target", share.alias("share"), F.conv(digits, 16, 10).cast("long").alias("offset"))
    range_ = Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = ranged.groupBy("source", "part").agg(F.count("*").alias("m"))  # a row for each source of each range
    start = counted.join(goal, F.col("source").eqNullSafe(F.col("s"))).select(
        "s", F.col("part").alias("p"), "source_size", "target", "share", (F.col("offset") + F.coalesce(F.sum(F.col("m") * F.col("share")).over(range_), F.lit(0))).alias("start")
    )
    placed = ranged.join(start, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    along = Window.partitionBy("part", "s").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("start") + F.sum("share").over(along)
    crossed = F.shiftright(end, 24) - F.shiftright(end - F.col("share"), 24)
    return placed.select(*KEY, "n", "size", "source_size", "target", crossed.cast("int").alias("copies"))


def same_unit(a: DataFrame, b: DataFrame) -> Column:
    """Joins rows with their units, keyed by structs ``key`` and ``of``."""
    on = [a["key"][c].eqNullSafe(b["of"][c]) for c in KEY]
    return on[0] & on[1] & on[2] & on[3]


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = cut(sized(table(spark, sf_dir, "documents")))
    got = allot(sizes).select(F.struct(*KEY).alias("of"), "source_size", "target", "copies")
    rows = sizes.select(F.struct(*KEY).alias("key"), "size")
    found = rows.join(got.hint("shuffle_hash"), same_unit(rows, got))
    return found.select("key.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it, with ``copy`` counting from 1
    (a column of that name in the input is replaced)."""
    got = allot(cut(sized(docs))).filter("copies > 0").select(F.struct(*KEY).alias("of"), "copies")
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), *tags("text"))
    rows = docs.select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "copy"]).alias("row"))
    return rows.join(got.hint("shuffle_hash"), same_unit(rows, got)).select("row.*", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size)::DOUBLE AS ceiling,
    (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS weight
  FROM sized GROUP BY source
), leveled AS (
  SELECT *, ((SELECT sum(size)::DOUBLE FROM sized)
      - coalesce(sum(ceiling) OVER (ORDER BY ceiling / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY ceiling / weight, source NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources
), goals AS (
  SELECT source, source_size, CASE WHEN ceiling > level * weight
    THEN weight * (SELECT arg_min(l.level, l.ceiling / l.weight) FROM leveled l WHERE l.ceiling > l.level * l.weight) ELSE ceiling END AS target
  FROM leveled
), shared AS (
  SELECT doc_id, size, s.source, source_size, target,
    CASE WHEN source_size > 0 THEN floor(target * 16777216 / source_size)::BIGINT ELSE 0 END AS share,
    ('0x' || substr(md5('mix/' || coalesce(s.source, 'null')), 1, 6))::BIGINT AS shift
  FROM sized s JOIN goals ON s.source IS NOT DISTINCT FROM goals.source
), placed AS (
  SELECT *, shift + sum(share) OVER (PARTITION BY source ORDER BY size DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto FROM shared
)
SELECT doc_id, size, source_size, target, ((upto >> 24) - ((upto - share) >> 24)) * size AS taken, ((upto >> 24) - ((upto - share) >> 24))::INT AS copies FROM placed
"""
