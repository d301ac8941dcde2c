"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import ship_package
from ..sources.recovery import cut_lineage, remove_stored

__all__ = ["BATCH_BYTES", "read", "stage", "release", "row_key", "SPACE", "WORD", "small_enough", "parts", "text_batches", "tidied", "give_back", "CACHES"]

BATCH_BYTES = 200_000           # of texts whose words or letters are arrays at a time: about a hundred times that in memory
SPACE = r"[\x20\x09-\x0D]"      # the white space of the contracts
WORD = r"[^\x20\x09-\x0D]+"     # and what lies between


def read(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stage(df: DataFrame) -> DataFrame:
    """Write to the shared folder of spark.checkpoint.dir and read again: a lineage cut with column pruning. The files go
    with release(), remove_stored() or when Python ends."""
    return cut_lineage(df)


def release(*frames: DataFrame) -> None:
    """Delete the files of stored tables that no later step reads."""
    if frames:
        remove_stored(*frames)


def row_key(id_col: str, text_col: str) -> Column:
    """Names a row by its id and whole text, so null and repeated ids are told apart by their texts."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(F.lit(11), text_col).alias("a"), F.xxhash64(F.lit(29), text_col).alias("b"))


def text_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """df, with the session sending at most ``rows`` texts to Python at a time: ten thousand long ones, the default, take
    much of an executor's memory on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        df.sparkSession.conf.set(key, str(rows))
    return df


def parts(batch: pa.RecordBatch, text: str, most_bytes: int = 1_000_000, most_rows: int = 512) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of bounded text, so that memory hangs on the longest text and not on the batch."""
    start = total = 0
    for i, size in enumerate(pc.binary_length(batch.column(text)).to_pylist()):
        if i > start and (total + (size or 0) > most_bytes or i - start >= most_rows):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size or 0
    if batch.num_rows > start:
        yield batch.slice(start)


CACHES: list[dict] = []   # what modules keep between batches in a Python worker


def give_back() -> None:
    """Empty the caches of this worker and return its free memory to the system."""
    for cache in CACHES:
        cache.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)   # of glibc
    if trim is not None:
        trim(0)


def tidied(run: Callable) -> Callable:
    """run for mapInArrow, which gives memory back when its partition ends: Python workers live on and wait beside those of
    the next stages."""
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()
    return wrapped


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether a stored table has at most ``rows`` rows; only then may it be broadcast."""
    return df.limit(rows + 1).count() <= rows
