"""Deterministic cell, point and support tables over relational tables, for tests, benches and parity with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.grid import GridSpec

GRID = GridSpec(96, 80)
POINT_GRID = GridSpec(24, 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_cells(spark: SparkSession, sf_dir: str, grid: GridSpec = GRID) -> DataFrame:
    """(r, c, p, q): mean discount times ten from integers (p in [0, 1], no rounding) and summed quantity."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy((F.col("l_orderkey") % grid.height).cast("int").alias("r"), (F.col("l_partkey") % grid.width).cast("int").alias("c"))
        .agg(F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("s"), F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("q"))
        .select("r", "c", (F.col("s").cast("double") / (F.col("n") * 10).cast("double")).alias("p"), "q")
    )


def cells(spark: SparkSession, sf_dir: str, grid: GridSpec = GRID) -> DataFrame:
    """raw_cells() inside an elliptic footprint, with cell_id, known, truth and part (the component catalogue)."""
    r, c, hr, hc = F.col("r"), F.col("c"), grid.height // 2, grid.width // 2
    inside = (r - hr) * (r - hr) * (hc * hc) + (c - hc) * (c - hc) * (hr * hr) <= hr * hr * hc * hc
    return (
        raw_cells(spark, sf_dir, grid)
        .where(inside)
        .select("r", "c", grid.cell_id().alias("cell_id"), "p", "q", ((r + 2 * c) % 37 == 0).alias("known"), ((2 * r + c) % 41 == 0).alias("truth"), (((r + c) % 11 == 0) & (r % 13 < 9)).alias("part"))
    )


#: The same tables as SQL, to prefix a query with.
CELLS_SQL = """WITH cells AS (
  SELECT CAST(l_orderkey % 96 AS INT) AS r, CAST(l_partkey % 80 AS INT) AS c,
         CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / CAST(count(*) * 10 AS DOUBLE) AS p,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q
  FROM lineitem GROUP BY 1, 2),
fp AS (
  SELECT r, c, CAST(r * 80 + c AS BIGINT) AS cell_id, p, q, (r + 2 * c) % 37 = 0 AS known, (2 * r + c) % 41 = 0 AS truth,
         ((r + c) % 11 = 0 AND r % 13 < 9) AS part
  FROM cells WHERE (r - 48) * (r - 48) * 1600 + (c - 40) * (c - 40) * 2304 <= 3686400),
spine AS (SELECT CAST(a.range AS INT) AS r, CAST(b.range AS INT) AS c FROM range(96) a, range(80) b),
full_q AS (SELECT s.r, s.c, coalesce(CAST(x.q AS DOUBLE), 0.0) AS q FROM spine s LEFT JOIN cells x USING (r, c))
"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(r, c, kind, value, user_id, event_id) from events."""
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 24).cast("int").alias("r"), (F.col("event_id") % 20).cast("int").alias("c"), F.col("event_type").alias("kind"), "value", "user_id", "event_id")


def supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(artifact, cell_id): distinct cells of eight artifacts."""
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_suppkey") % 8).cast("int").alias("artifact"), ((F.col("l_orderkey") % 96) * 80 + F.col("l_partkey") % 80).alias("cell_id")).distinct()


SUPPORTS_SQL = """WITH sup AS (SELECT DISTINCT CAST(l_suppkey % 8 AS INT) AS artifact,
  CAST((l_orderkey % 96) * 80 + l_partkey % 80 AS BIGINT) AS cell_id FROM lineitem)
"""
