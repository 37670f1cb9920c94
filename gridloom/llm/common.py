"""Shared plumbing of the corpus operators: reading, shared files, bounded samples, byte columns."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ready(spark: SparkSession) -> None:
    """Lets Python workers import this package where it isn't on their path yet."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if _ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, have) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"file://{tempfile.gettempdir()}/gridloom-shared"
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df below the shared folder and reads it again: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """doc_id and text alone (other columns, whatever they are called, are left behind)."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more
    )


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of every value; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def crc_of(ids: list) -> list[int]:
    """crc32 of each id written as text; of the empty string for null."""
    return [zlib.crc32(b"" if x is None else str(x).encode()) for x in ids]


def bounded_sample(docs: DataFrame, bound: int, id_col: str = "doc_id", salt: int = 7) -> DataFrame:
    """About 0.9 x bound rows chosen by a hash of the id (all rows if there are no more than bound)."""
    n = docs.count()
    if n <= bound:
        return docs
    share = int(0.9 * bound / n * (1 << 40))
    return docs.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(salt)), F.lit(1 << 40)) < F.lit(share))


def trim() -> None:
    """Gives memory that a Python worker has freed back to the system, where the C library can: workers are kept, and
    what they keep counts against the executor."""
    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give(0)


def slices(sizes: list[int], most: int):
    """(start, end) ranges of consecutive items whose sizes add up to about most."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def segment_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of each consecutive run of values; runs may be empty."""
    ends = np.cumsum(lengths)
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[ends] - total[ends - lengths]
