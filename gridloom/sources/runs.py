"""Run-length masks: alternating runs (outside first) as unsigned LEB128 numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridloom.grid import GridSpec


def decode_runs(payload: bytes, total: int) -> list[int]:
    """Lengths of the alternating runs. They must cover exactly `total` cells; an empty run is allowed first only."""
    runs, value, shift = [], 0, 0
    for b in payload:
        if shift > 28:
            raise ValueError("run length overflows")
        value |= (b & 127) << shift
        if b & 128:
            shift += 7
            continue
        if value == 0 and runs:
            raise ValueError("empty inner run")
        runs.append(value)
        value = shift = 0
    if shift:
        raise ValueError("payload ends within a number")
    if sum(runs) != total:
        raise ValueError(f"runs cover {sum(runs)} of {total} cells")
    return runs


def encode_runs(runs: list[int]) -> bytes:
    out = bytearray()
    for n in runs:
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        out.append(n)
    return bytes(out)


def mask_cells(spark: SparkSession, payload: bytes, grid: GridSpec) -> DataFrame:
    """(r, c) of the inside cells: runs become ranges on the driver, cells on the executors."""
    at, spans = 0, []
    for k, n in enumerate(decode_runs(payload, grid.height * grid.width)):
        if k % 2 and n:
            spans.append((at, n))
        at += n
    schema = T.StructType([T.StructField("first", T.LongType()), T.StructField("n", T.LongType())])
    ids = spark.createDataFrame(spans, schema).select(F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("id"))
    return ids.select(F.floor(F.col("id") / grid.width).cast("int").alias("r"), (F.col("id") % grid.width).cast("int").alias("c"))


def mask_runs(mask: DataFrame, grid: GridSpec) -> DataFrame:
    """(start, n) of the maximal inside runs in row-major order. Rows are joined where one ends at the right border
    and the next begins at the left, so windows never span more than a row and then one run a row."""
    row = Window.partitionBy("r").orderBy("c")
    runs = (
        mask.select("r", "c")
        .distinct()
        .withColumn("g", F.col("c") - F.row_number().over(row))
        .groupBy("r", "g")
        .agg(F.min("c").alias("first"), F.count("*").alias("n"))
        .select((F.col("r").cast("long") * grid.width + F.col("first")).alias("start"), "n")
    )
    line = Window.orderBy("start")
    joined = runs.withColumn("new", (F.col("start") != F.coalesce(F.lag(F.col("start") + F.col("n")).over(line), F.lit(-1))).cast("long"))
    return joined.withColumn("g", F.sum("new").over(line)).groupBy("g").agg(F.min("start").alias("start"), F.sum("n").alias("n")).select("start", "n")


def encode_mask(mask: DataFrame, grid: GridSpec) -> bytes:
    """The payload that decode_runs() reads; only runs reach the driver."""
    at, out = 0, []
    for row in mask_runs(mask, grid).orderBy("start").toLocalIterator():
        out += [row.start - at, row.n]
        at = row.start + row.n
    total = grid.height * grid.width
    return encode_runs([*out, total - at] if at < total else out)
