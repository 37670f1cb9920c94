"""Points to cells, impulses and per-cell estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.grid import GridSpec


def nearest_cell(x: Column, y: Column, grid: GridSpec) -> tuple[Column, Column]:
    """Row and column whose centre is nearest, halves to even."""
    a, _, x0, _, e, y0 = grid.transform
    return F.rint((y0 - y) / -e - 0.5).cast("int"), F.rint((x - x0) / a - 0.5).cast("int")


def floor_cell(x: Column, y: Column, grid: GridSpec) -> tuple[Column, Column]:
    """Containing cell, clipped to the grid."""
    a, _, x0, _, e, y0 = grid.transform
    clip = lambda v, n: F.least(F.greatest(F.floor(v), F.lit(0)), F.lit(n - 1)).cast("int")
    return clip((y0 - y) / -e, grid.height), clip((x - x0) / a, grid.width)


def truncated_cell(x: Column, y: Column, grid: GridSpec) -> tuple[Column, Column]:
    """Cell by truncation toward zero: differs from floor_cell() for points beyond the upper left corner."""
    a, _, x0, _, e, y0 = grid.transform
    return ((y0 - y) / -e).cast("int"), ((x - x0) / a).cast("int")


def impulses(points: DataFrame, weight: Column) -> DataFrame:
    """(r, c, w): summed weights."""
    return points.groupBy("r", "c").agg(F.sum(weight).alias("w"))


def site_estimates(points: DataFrame, estimators: list[str], low: float, high: float, hot: float, spread_limit: float = 0.25) -> DataFrame:
    """A row for each cell: the median of each estimator's values in [low, high]; n_est, how many there are; t_med,
    the median of these medians; spread_rel, their range over t_med (0 for one); agreement, 1 - spread_rel /
    spread_limit within [0, 1]; eligible, with two or more estimators, t_med >= hot and agreement above 0; weight,
    agreement x t_med where eligible."""
    med = points.groupBy("r", "c").agg(*(F.median(F.when((F.col("kind") == k) & F.col("value").between(low, high), F.col("value"))).alias(f"m_{k}") for k in estimators))
    all_ = F.array_compact(F.array(*(f"m_{k}" for k in estimators)))
    s = F.sort_array(F.col("ms"))
    n = F.col("n_est")
    at = lambda i: F.get(s, i)
    out = med.withColumn("ms", all_).withColumn("n_est", F.size("ms")).withColumn("t_med", (at(F.floor((n - 1) / 2).cast("int")) + at(F.floor(n / 2).cast("int"))) / 2)
    spread = F.when(n >= 2, (F.array_max("ms") - F.array_min("ms")) / F.greatest("t_med", F.lit(1e-9))).when(n == 1, 0.0)
    out = out.withColumn("spread_rel", spread).withColumn("agreement", F.least(F.greatest(1 - F.col("spread_rel") / spread_limit, F.lit(0.0)), F.lit(1.0)))
    ok = F.coalesce((n >= 2) & (F.col("t_med") >= hot) & (F.col("agreement") > 0), F.lit(False))
    return out.withColumn("eligible", ok).select("r", "c", "n_est", "t_med", "spread_rel", "agreement", "eligible", F.when(ok, F.col("agreement") * F.col("t_med")).otherwise(0.0).alias("weight"))


def block_mean(cells: DataFrame, value: str, k: int = 2) -> DataFrame:
    return cells.groupBy(F.floor(F.col("r") / k).cast("int").alias("r"), F.floor(F.col("c") / k).cast("int").alias("c")).agg(F.avg(value).alias(value))


def block_max(cells: DataFrame, value: str, k: int = 2) -> DataFrame:
    return cells.groupBy(F.floor(F.col("r") / k).cast("int").alias("r"), F.floor(F.col("c") / k).cast("int").alias("c")).agg(F.max(value).alias(value))


def upsample(coarse: DataFrame, k: int = 2) -> DataFrame:
    """Every coarse cell as k x k cells of the same values."""
    wide = coarse.withColumn("dr", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("dc", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return wide.withColumn("r", F.col("r") * k + F.col("dr")).withColumn("c", F.col("c") * k + F.col("dc")).drop("dr", "dc")


def mosaic(*tiles: DataFrame) -> DataFrame:
    """Overlapping tiles (r, c, v): the largest value that is there."""
    out = tiles[0]
    for t in tiles[1:]:
        out = out.unionByName(t)
    return out.groupBy("r", "c").agg(F.max(F.when(F.isnan("v"), None).otherwise(F.col("v"))).alias("v"))


def rasterise(lines: DataFrame, grid: GridSpec, footprint: DataFrame | None = None) -> DataFrame:
    """(id, r, c): the distinct cells that polylines (id, points array<struct<x, y>>) pass through, as a walk of each
    segment in steps of at most half a cell visits them; within the footprint where one is given."""
    a, _, x0, _, e, y0 = grid.transform
    seg = lines.select("id", F.explode(F.arrays_zip(F.slice("points", 1, F.greatest(F.size("points") - 1, F.lit(0))).alias("p"), F.slice("points", 2, F.greatest(F.size("points") - 1, F.lit(0))).alias("q"))).alias("s")).select("id", *[((F.col(f"s.{k}.x") - x0) / a).alias(f"{k}x") for k in "pq"], *[((y0 - F.col(f"s.{k}.y")) / -e).alias(f"{k}y") for k in "pq"])
    n = F.greatest(F.ceil(2 * F.greatest(F.abs(F.col("qx") - F.col("px")), F.abs(F.col("qy") - F.col("py")))), F.lit(1))
    walk = seg.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))
    t = F.col("k") / F.col("n")
    out = walk.select("id", F.floor(F.col("py") + t * (F.col("qy") - F.col("py"))).cast("int").alias("r"), F.floor(F.col("px") + t * (F.col("qx") - F.col("px"))).cast("int").alias("c")).where(grid.inside()).distinct()
    return out if footprint is None else out.join(footprint.select("r", "c").distinct(), ["r", "c"], "left_semi").select("id", "r", "c")


def line_lengths(lines: DataFrame) -> DataFrame:
    """(id, length, x, y) of polylines: total length, and the centroid weighted by it (of the points where it is 0)."""
    part = F.transform(F.sequence(F.lit(1), F.greatest(F.size("points") - 1, F.lit(1))), lambda i: F.struct(F.get("points", i - 1).alias("p"), F.coalesce(F.get("points", i), F.get("points", i - 1)).alias("q")))
    seg = F.transform(part, lambda s: F.struct(F.sqrt(F.pow(s["q"]["x"] - s["p"]["x"], 2) + F.pow(s["q"]["y"] - s["p"]["y"], 2)).alias("l"), ((s["q"]["x"] + s["p"]["x"]) / 2).alias("x"), ((s["q"]["y"] + s["p"]["y"]) / 2).alias("y")))
    own = lines.select("id", seg.alias("s"))
    total = lambda f: F.aggregate("s", F.lit(0.0), lambda acc, s: acc + f(s))
    length = total(lambda s: s["l"])
    weighted = lambda k: F.when(length > 0, total(lambda s: s["l"] * s[k]) / F.when(length > 0, length)).otherwise(F.get("s", F.lit(0))[k])
    return own.select("id", length.alias("length"), weighted("x").alias("x"), weighted("y").alias("y"))
