"""The corpus pipeline: documents in, training mix out.

Each stage takes (spark, docs, sf_dir), where ``docs`` is what its predecessor returned, written
as Parquet and read again, and works on all of it. All stages but the last return the columns of
documents; the last adds ``copy``.

Odd input: null texts and texts without words are one group of the near-dedup stage, so one of them
stays at most; rows without a doc_id or with a repeated one
are judged by their texts; very long texts go through whole; an empty table gives an empty result; other
columns, whatever their names, pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from weftgraph.lineage import shared_folder
from weftgraph.llm import mixing, simhash, subword, superkmer, template

STAGES = [
    ("quality classifier", subword.keep_good),
    ("SimHash near-dedup", simhash.keep_first),
    ("substring dedup", superkmer.dedup_text),
    ("benchmark decontamination", template.drop_leaks),
    ("mixing sources to target weights", mixing.mix_sources),
]

#: Hashes of words, learned weights and XXH64 are beyond SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:  # what the stage before wrote is not read again
                gone = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
                gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
