"""What the training-data operators share: reading a table, cutting lineage, hashing."""

from __future__ import annotations

import ctypes
import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.checkpoints import cut, shared_folder

__all__ = ["BATCH_ROWS", "crc_mod", "cut", "fresh", "release", "resident", "shared_folder", "small_batches", "table", "tidy", "unit_hash"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a batch that a Python worker gets at once: documents are long.
BATCH_ROWS = 500


def small_batches(df: DataFrame) -> None:
    """Bound what Python workers hold of texts: batches of this session get BATCH_ROWS rows at most."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(key)) > BATCH_ROWS or int(conf.get(key)) <= 0:
        conf.set(key, str(BATCH_ROWS))


def release() -> None:
    """Give memory that Python, Arrow and numpy have freed back to the system; a reused worker
    keeps its peak otherwise, and an executor has several."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(function):
    """A batch function of a task that releases memory when the task's batches are done."""

    @functools.wraps(function)
    def wrapped(batches):
        try:
            yield from function(batches)
        finally:
            release()

    return wrapped


_RESIDENT: dict = {}


def resident(key, make):
    """What an operator keeps in a Python worker: made once, and dropped when the worker goes
    on to another operator, so that a reused worker holds the tables of one at a time."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo `modulus`; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(0))


def unit_hash(column: Column, seed: int) -> Column:
    """A seeded, reproducible order: 64-bit hash of the value and the seed."""
    return F.xxhash64(F.lit(seed), column)


def fresh(df: DataFrame, *wanted: str) -> DataFrame:
    """Only the wanted columns, so that extra columns of the caller cannot clash with ours."""
    return df.select(*wanted)
