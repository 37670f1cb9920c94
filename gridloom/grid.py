"""Grid geometry: shape, reference system, affine transform, cell ids and the dense spine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GridSpec:
    height: int
    width: int
    epsg: int = 0
    transform: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0, -1.0, 0.0)

    def cell_id(self) -> Column:
        return F.col("r").cast("long") * self.width + F.col("c")

    def spine(self, spark: SparkSession) -> DataFrame:
        """All cells of the rectangle as (r, c)."""
        n = F.col("id")
        return spark.range(self.height * self.width).select(F.floor(n / self.width).cast("int").alias("r"), (n % self.width).cast("int").alias("c"))

    def inside(self) -> Column:
        return F.col("r").between(0, self.height - 1) & F.col("c").between(0, self.width - 1)


def require_same(a: GridSpec, b: GridSpec) -> None:
    if a != b:
        raise ValueError(f"grids differ: {a} and {b}")


def dense(cells: DataFrame, grid: GridSpec, value: str, fill: float = 0.0) -> DataFrame:
    """(r, c, value) for every cell of the rectangle; `fill` where the table has none."""
    v = cells.select("r", "c", F.col(value).cast("double").alias("v"))
    return grid.spine(cells.sparkSession).join(v, ["r", "c"], "left").select("r", "c", F.coalesce("v", F.lit(fill)).alias(value))
