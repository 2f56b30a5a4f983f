"""Lineage cuts for loops and reused intermediate tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's ``spark.checkpoint.dir``. A temporary
    one is made only where that is unset, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="weft-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and written to the shared folder, so that a lost executor costs no
    recomputation of what came before. A frame that is the result of a cut stays as it is."""
    if getattr(df, "_was_cut", False):
        return df
    shared_folder(df.sparkSession)
    done = df.checkpoint(eager=True)
    done._was_cut = True
    return done

