"""Helpers shared by the training-data operators: table access, lineage cuts, Arrow plumbing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.lineage import cut

__all__ = ["arrow_map", "chunks", "cut", "pack", "release", "remainder", "slices", "table", "tags", "unpack", "utf8"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % F.lit(modulus)


def utf8(column: str) -> Column:
    """The UTF-8 bytes of a text column; a null text is empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def tags(column: str) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a text, ``t1`` and ``t2``, by which equal texts are told."""
    return F.xxhash64(column).alias("t1"), F.xxhash64(F.lit(1), F.col(column)).alias("t2")


def chunks(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts holding about ``most`` bytes (one text at least)."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield begin, i
            begin, held = i, 0
        held += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Smaller batches of the same rows, for kernels that copy what they get."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def pack(*parts: bytes, level: int = 3) -> bytes:
    head = np.array([len(p) for p in parts], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=level).compress(head + b"".join(parts))


def unpack(blob: bytes, n: int) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    ends = np.cumsum(np.frombuffer(data, np.int64, n)) + 8 * n
    return [data[s:e] for s, e in zip([8 * n, *ends[:-1]], ends, strict=True)]


_trim = getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def release() -> None:
    """Returns freed memory to the system. Workers are used again, and what one keeps from its largest
    task adds to all that its executor does later."""
    pa.default_memory_pool().release_unused()
    _trim(0)


def arrow_map(
    df: DataFrame, kernel: Callable[[Iterable[pa.RecordBatch]], Iterable[dict]], schema: str
) -> DataFrame:
    """``mapInArrow`` over a kernel that yields dicts of columns in the order of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    fields = _parse_datatype_string(schema)
    assert isinstance(fields, StructType)
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in kernel(batches):
            yield pa.RecordBatch.from_arrays(
                [
                    x if isinstance(x, pa.Array) and x.type == f.type else pa.array(x, f.type)
                    for f, x in zip(arrow, (columns[f.name] for f in arrow), strict=True)
                ],
                schema=arrow,
            )
        release()

    return df.mapInArrow(run, fields)
