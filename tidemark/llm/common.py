"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in every word contract here: space, tab to carriage return.
WORD_BREAK = r"[\x20\x09-\x0D]+"

#: Bytes of text handled at once inside a Python task.
SLICE_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches hold about ``SLICE_BYTES`` if the session has Spark's default (64 MB): a batch of
    10,000 long texts fills tens of MB several times over, in the executor's JVM and in its Python worker."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit) == "67108864b":               # Spark's default
        spark.conf.set(limit, str(SLICE_BYTES))


def words(text: Column) -> Column:
    """Words of a text as an array; null or blank text gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")


def crc_mod(key: Column, modulus: int) -> Column:
    """crc32 of the key's text modulo ``modulus`` (null key: null)."""
    return F.crc32(key.cast("string")) % modulus


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges of a batch with at most ``most`` bytes of ``column``
    each (one row at least), so memory follows the longest text, not the batch."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]
