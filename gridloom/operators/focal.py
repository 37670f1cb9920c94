"""Neighbourhood operators on the dense rectangle. Row and column passes are windows over one row or one column."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _line(axis: str, k: int | None = None):
    w = Window.partitionBy("r" if axis == "c" else "c").orderBy(axis)
    return w if k is None else w.rangeBetween(-k, k)


def padded(cells: DataFrame, axis: str, size: int, k: int, border: str) -> DataFrame:
    """Cells and, beyond both ends of every line, k more: `reflect` mirrors about the edge, `nearest` repeats it,
    `zero` adds none (a sum skips what is missing)."""
    if border == "zero":
        return cells
    x = F.col(axis)
    if border == "reflect":
        at = F.array(x, F.when(x < k, -1 - x), F.when(x >= size - k, 2 * size - 1 - x))
    else:
        at = F.concat(F.array(x), F.when(x == 0, F.sequence(F.lit(-k), F.lit(-1))).otherwise(F.array().cast("array<int>")), F.when(x == size - 1, F.sequence(F.lit(size), F.lit(size + k - 1))).otherwise(F.array().cast("array<int>")))
    return cells.withColumn(axis, F.explode(at)).where(F.col(axis).isNotNull())


def _pass(cells: DataFrame, value: str, axis: str, size: int, k: int, border: str, fn) -> DataFrame:
    wide = padded(cells, axis, size, k, border)
    return wide.withColumn(value, fn(F.col(value), axis)).where(F.col(axis).between(0, size - 1))


def box_mean(cells: DataFrame, value: str, height: int, width: int, size: int, border: str = "reflect") -> DataFrame:
    """Mean over a size x size box (size odd)."""
    k = size // 2
    out = cells
    for axis, n in (("c", width), ("r", height)):
        out = _pass(out, value, axis, n, k, border, lambda v, a: F.sum(v).over(_line(a, k)) / size)
    return out


def extreme(cells: DataFrame, value: str, size: int, largest: bool = True) -> DataFrame:
    """Largest (or smallest) value over a size x size box; the border adds nothing that isn't inside."""
    k, f = size // 2, F.max if largest else F.min
    return cells.withColumn(value, f(value).over(_line("c", k))).withColumn(value, f(value).over(_line("r", k)))


def local_anomaly(cells: DataFrame, value: str, height: int, width: int, size: int) -> DataFrame:
    mean = box_mean(cells.select("r", "c", F.col(value).alias("m")), "m", height, width, size)
    return cells.join(mean, ["r", "c"]).withColumn(value, F.col(value) - F.col("m")).drop("m")


def local_z(cells: DataFrame, value: str, height: int, width: int, size: int) -> DataFrame:
    """(x - mean) / (std + 0.25) clipped to [-3, 6]; the variance is at least 1e-6."""
    m = box_mean(cells.select("r", "c", F.col(value).alias("m")), "m", height, width, size)
    s = box_mean(cells.select("r", "c", (F.col(value) * F.col(value)).alias("s")), "s", height, width, size)
    std = F.sqrt(F.greatest(F.col("s") - F.col("m") * F.col("m"), F.lit(1e-6)))
    z = (F.col(value) - F.col("m")) / (std + 0.25)
    return cells.join(m, ["r", "c"]).join(s, ["r", "c"]).withColumn(value, F.least(F.greatest(z, F.lit(-3.0)), F.lit(6.0))).drop("m", "s")


def taps(sigma: float, order: int = 0, truncate: float = 4.0) -> list[float]:
    """Gaussian weights of radius int(truncate sigma + 0.5), normalised; order 1 and 2 are its derivatives."""
    k = int(truncate * sigma + 0.5)
    g = [math.exp(-0.5 * (x / sigma) ** 2) for x in range(-k, k + 1)]
    total = sum(g)
    g = [x / total for x in g]
    at = range(-k, k + 1)
    if order == 1:
        return [-x / sigma**2 * y for x, y in zip(at, g, strict=True)]
    if order == 2:
        return [(x * x / sigma**4 - 1 / sigma**2) * y for x, y in zip(at, g, strict=True)]
    return g


def convolve(cells: DataFrame, value: str, axis: str, size: int, weights: list[float], border: str = "reflect") -> DataFrame:
    """out(x) = sum of weights[k + j] v(x - j) along dense lines; missing neighbours (border zero) count as 0."""
    k = len(weights) // 2

    def sums(v: Column, a: str) -> Column:
        w = _line(a)
        out = None
        for j, x in zip(range(-k, k + 1), weights, strict=True):
            t = F.coalesce(F.lag(v, j).over(w), F.lit(0.0)) * x
            out = t if out is None else out + t
        return out

    return _pass(cells, value, axis, size, k, border, sums)


def gaussian(cells: DataFrame, value: str, height: int, width: int, sigma: float, orders: tuple[int, int] = (0, 0), border: str = "reflect", truncate: float = 4.0) -> DataFrame:
    """Separable Gaussian, or its derivative of the given orders by row and column."""
    out = convolve(cells, value, "c", width, taps(sigma, orders[1], truncate), border)
    return convolve(out, value, "r", height, taps(sigma, orders[0], truncate), border)


def gradient(cells: DataFrame, value: str) -> DataFrame:
    """gr, gc: central differences, one-sided at the ends of a line; slope: their norm."""
    out = cells
    for axis in ("r", "c"):
        w = _line(axis)
        before, after = F.lag(value).over(w), F.lead(value).over(w)
        v = F.col(value)
        out = out.withColumn(f"g{axis}", F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), after - v).when(after.isNull(), v - before).otherwise((after - before) / 2))
    return out.withColumn("slope", F.sqrt(F.col("gr") * F.col("gr") + F.col("gc") * F.col("gc")))


def offsets(mask: DataFrame, reach: int, keep) -> DataFrame:
    """(r, c) displaced by every (dr, dc) within reach that keep(dr, dc) admits, with dr and dc: one row a pair."""
    pairs = [(a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if keep(a, b)]
    near = F.explode(F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in pairs))).alias("d")
    return mask.select("*", near).select(*[x for x in mask.columns if x not in ("r", "c")], (F.col("r") + F.col("d.dr")).alias("r"), (F.col("c") + F.col("d.dc")).alias("c"), F.col("d.dr").alias("dr"), F.col("d.dc").alias("dc"))


def dilate(mask: DataFrame, height: int, width: int, times: int) -> DataFrame:
    """Cells within `times` steps of the mask by 4-connected moves."""
    wide = offsets(mask.select("r", "c"), times, lambda a, b: abs(a) + abs(b) <= times).select("r", "c")
    return wide.where(F.col("r").between(0, height - 1) & F.col("c").between(0, width - 1)).distinct()


def erode(mask: DataFrame, spine: DataFrame, height: int, width: int, times: int) -> DataFrame:
    """Mask cells that no cell outside the mask reaches in `times` steps; beyond the border all counts as mask."""
    outside = spine.join(mask.select("r", "c"), ["r", "c"], "left_anti")
    return mask.select("r", "c").join(dilate(outside, height, width, times), ["r", "c"], "left_anti")


def neighbours(mask: DataFrame) -> DataFrame:
    """Mask cells with n, how many of their eight neighbours are in the mask; one is a tip, three or more a junction."""
    near = offsets(mask.select("r", "c"), 1, lambda a, b: (a, b) != (0, 0)).groupBy("r", "c").agg(F.count("*").alias("n"))
    return mask.select("r", "c").join(near, ["r", "c"], "left").select("r", "c", F.coalesce("n", F.lit(0)).alias("n"))
