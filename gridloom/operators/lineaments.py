"""Line and ridge detection, point fields, thinning."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.grid import GridSpec, dense
from gridloom.operators import focal, tiles
from gridloom.operators.regions import distance
from gridloom.session import settle

#: Steps (dr, dc) of the four line directions, by quantised angle.
STEPS = ((0, 1), (1, 1), (1, 0), (1, -1))


def _along(step: tuple[int, int]):
    """Windows over dense lines in one of the four directions."""
    dr, dc = step
    if dr == 0:
        return Window.partitionBy("r").orderBy("c")
    return Window.partitionBy(F.col("c") - F.col("r") * dc).orderBy("r")


def both_sides(value: str, step: tuple[int, int]) -> tuple[Column, Column]:
    w = _along(step)
    return F.lag(value).over(w), F.lead(value).over(w)


def hessian_lines(cells: DataFrame, interior: DataFrame, value: str, polarity: str = "ridge", sigmas: tuple[float, ...] = (2, 4, 8), beta: float = 0.5) -> DataFrame:
    """(r, c, response) in [0, 1] of bright (ridge) or dark (trough) lines on a dense grid, 0 outside `interior`.

    At each scale the Hessian of Gaussian derivatives (edge values repeated, times sigma squared) has eigenvalues
    ordered by magnitude: exp(-(small / large)^2 / 2 beta^2) (1 - exp(-s^2 / 2 C^2)) where the large one is negative,
    s their norm and C its 90 % quantile over the interior. The largest response over scales counts."""
    sign = {"ridge": 1.0, "trough": -1.0}[polarity]
    inside = interior.select("r", "c").distinct()
    mid = cells.join(inside, ["r", "c"]).agg(F.median(value).alias("m"))
    x = settle(cells.crossJoin(F.broadcast(mid)).select("r", "c", (sign * (F.col(value) - F.col("m"))).alias("v")), "hessian")
    out = None
    for s in sigmas:
        part = [tiles.strip_gaussian(x, "v", s, o, "nearest").select("r", "c", (F.col("v") * s * s).alias(n)) for o, n in (((2, 0), "a"), ((1, 1), "h"), ((0, 2), "b"))]
        m = part[0].join(part[1], ["r", "c"]).join(part[2], ["r", "c"]).join(inside, ["r", "c"])
        root = F.sqrt(F.pow((F.col("a") - F.col("b")) / 2, 2) + F.col("h") * F.col("h"))
        up, down = (F.col("a") + F.col("b")) / 2 + root, (F.col("a") + F.col("b")) / 2 - root
        large, small = F.when(F.abs(up) > F.abs(down), up).otherwise(down), F.when(F.abs(up) > F.abs(down), down).otherwise(up)
        m = settle(m.select("r", "c", large.alias("large"), small.alias("small"), F.sqrt(up * up + down * down).alias("s")), "hessian-scale")
        q = m.agg(F.greatest(F.percentile("s", 0.9), F.lit(1e-12)).alias("q"))
        ratio = F.abs("small") / F.greatest(F.abs("large"), F.lit(1e-12))
        score = F.when(F.col("large") < 0, F.exp(-ratio * ratio / (2 * beta**2)) * (1 - F.exp(-F.col("s") * F.col("s") / (2 * F.col("q") * F.col("q"))))).otherwise(0.0)
        one = m.crossJoin(F.broadcast(q)).select("r", "c", score.alias("response"))
        out = one if out is None else out.unionByName(one)
    best = out.groupBy("r", "c").agg(F.max("response").alias("response"))
    return cells.select("r", "c").join(best, ["r", "c"], "left").select("r", "c", F.coalesce("response", F.lit(0.0)).alias("response"))


def ridge_cells(cells: DataFrame, value: str, height: int, width: int, sigma: float = 1.0) -> DataFrame:
    """(r, c, ridge): cells of a dense grid on a crest of the smoothed score: its sharpest negative curvature is under
    -1e-7, the value positive, no less than both neighbours across the crest and more than one of them. The direction
    across is quantised to four."""
    s = focal.gaussian(cells.select("r", "c", F.col(value).alias("s")), "s", height, width, sigma)
    g = focal.gradient(s, "s").drop("slope")
    a = focal.gradient(g.select("r", "c", F.col("gr").alias("x")), "x").select("r", "c", F.col("gr").alias("hrr"), F.col("gc").alias("hrc"))
    b = focal.gradient(g.select("r", "c", F.col("gc").alias("x")), "x").select("r", "c", F.col("gc").alias("hcc"))
    m = s.join(a, ["r", "c"]).join(b, ["r", "c"])
    lam = (F.col("hrr") + F.col("hcc")) / 2 - F.sqrt(F.pow((F.col("hrr") - F.col("hcc")) / 2, 2) + F.col("hrc") * F.col("hrc"))
    # eigenvector of the smaller eigenvalue, as (row, column)
    angle = 0.5 * F.atan2(2 * F.col("hrc"), F.col("hcc") - F.col("hrr")) + F.lit(math.pi / 2)
    m = m.withColumn("lam", lam).withColumn("way", F.pmod(F.rint(angle / (math.pi / 4)).cast("int"), F.lit(4)))
    lo, hi = F.lit(None).cast("double"), F.lit(None).cast("double")
    for k, step in enumerate(STEPS):
        before, after = both_sides("s", step)
        lo, hi = F.when(F.col("way") == k, before).otherwise(lo), F.when(F.col("way") == k, after).otherwise(hi)
    m = m.withColumn("lo", F.coalesce(lo, F.lit(0.0))).withColumn("hi", F.coalesce(hi, F.lit(0.0)))
    crest = (F.col("s") >= F.col("lo")) & (F.col("s") >= F.col("hi")) & ((F.col("s") > F.col("lo")) | (F.col("s") > F.col("hi")))
    return m.select("r", "c", (crest & (F.col("lam") < -1e-7) & (F.col("s") > 0)).alias("ridge"))


def strike_response(cells: DataFrame, grid: GridSpec, value: str, half: int = 7, flank: int = 3, azimuths: int = 6, tile: int = 128, box: int = 31) -> DataFrame:
    """(r, c, value) of the cells that have a value: the local z-score (box x box; 0: the value itself) averaged along a line of 2 half + 1
    cells, less that of the two parallel lines `flank` off, the largest over the azimuths and at least 0. Cells without
    a value count as 0 before the z-score; beyond the edge z-scores repeat."""
    own = cells.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select("r", "c", F.col(value).cast("double").alias(value))
    dense = grid.spine(cells.sparkSession).join(own, ["r", "c"], "left").select("r", "c", F.coalesce(value, F.lit(0.0)).alias(value))
    reach = half + 1
    weights: list[dict] = []
    for k in range(azimuths):
        u, v = math.sin(math.pi * k / azimuths), math.cos(math.pi * k / azimuths)
        at: dict = {}
        for t in range(-half, half + 1):
            for side, w in ((0, 1.0), (1, -0.5), (-1, -0.5)):
                # rounded from the kernel's corner, so that halves fall as they do on its cells
                r, c = round(reach + t * u - side * flank * v) - reach, round(reach + t * v + side * flank * u) - reach
                if max(abs(r), abs(c)) <= reach:
                    at[r, c] = at.get((r, c), 0.0) + w / (2 * half + 1)
        weights.append(at)

    def kernel(x: np.ndarray) -> np.ndarray:
        return np.maximum(0, np.max([sum(w * np.roll(x, at, (0, 1)) for at, w in one.items()) for one in weights], axis=0))

    z = focal.local_z(dense, value, grid.height, grid.width, box) if box else dense
    return tiles.tile_apply(z, grid, value, reach, kernel, tile).join(own.select("r", "c"), ["r", "c"])


def fill_nearest(cells: DataFrame, grid: GridSpec, value: str, guard: float = 32) -> DataFrame:
    """(r, c, value, interior) on the whole rectangle: missing cells take the nearest cell's value (ties: the smaller
    row, then column), interior is more than `guard` cells from any missing cell. Nearest cells are found from the
    exact distance: the candidates are cells at just that distance."""
    own = cells.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select("r", "c", F.col(value).cast("double").alias("v"))
    d = distance(own, grid).withColumn("d2", F.rint(F.col("d") * F.col("d")).cast("int"))
    gaps = settle(d.where("d2 > 0"), "fill-gaps")
    reach = gaps.agg(F.max("d2").alias("m")).first().m
    filled = own
    if reach:
        k = math.isqrt(reach)
        step = F.explode(F.sequence(F.lit(-k), F.lit(k)))
        far = gaps.withColumn("dr", step).where("dr * dr <= d2").withColumn("x", F.rint(F.sqrt((F.col("d2") - F.col("dr") * F.col("dr")).cast("double"))).cast("int")).where("x * x + dr * dr = d2")
        at = far.withColumn("dc", F.explode(F.array_distinct(F.array(-F.col("x"), F.col("x"))))).select(F.col("r").alias("gr"), F.col("c").alias("gc"), (F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c"))
        first = at.join(own, ["r", "c"]).groupBy("gr", "gc").agg(F.min_by("v", F.struct("r", "c")).alias("v"))
        filled = own.union(first.select("gr", "gc", "v"))
    hole = grid.spine(cells.sparkSession).join(own.select("r", "c"), ["r", "c"], "left_anti")
    inner = distance(hole, grid).select("r", "c", F.coalesce(F.col("d") > guard, F.lit(True)).alias("interior"))
    return filled.join(inner, ["r", "c"]).select("r", "c", F.col("v").alias(value), "interior")


def point_field(impulses: DataFrame, footprint: DataFrame, grid: GridSpec, sigma: float = 5.0, truncate: float = 3.0) -> DataFrame:
    """(r, c, v) on the footprint: impulses (r, c, w) blurred, nothing beyond the border, over the largest value."""
    wide = dense(impulses.select("r", "c", F.col("w").alias("v")), grid, "v")
    blurred = tiles.strip_gaussian(wide, "v", sigma, border="zero", truncate=truncate).join(footprint.select("r", "c").distinct(), ["r", "c"])
    blurred = settle(blurred, "point-field")
    top = blurred.agg(F.max("v").alias("top"))
    return blurred.crossJoin(F.broadcast(top)).select("r", "c", F.when(F.col("top") > 0, F.col("v") / F.col("top")).otherwise(0.0).alias("v"))


def transfer_field(known: DataFrame, footprint: DataFrame, grid: GridSpec, sigma: float) -> DataFrame:
    """(r, c, v): exp(-d^2 / 2 sigma^2) of the distance to known cells, over its largest value on the footprint."""
    d = settle(distance(known, grid).join(footprint.select("r", "c").distinct(), ["r", "c"]), "transfer")
    v = F.coalesce(F.exp(-F.col("d") * F.col("d") / (2 * sigma * sigma)), F.lit(0.0))
    top = d.agg(F.max(v).alias("top"))
    return d.crossJoin(F.broadcast(top)).select("r", "c", F.when(F.col("top") > 0, v / F.col("top")).otherwise(0.0).alias("v"))


def skeleton(mask: DataFrame, most: int = 500) -> DataFrame:
    """(r, c) left by thinning: in two alternating steps a cell goes if it has 2 to 6 neighbours, one rise from empty
    to full around it, and an empty one in each of the step's two triples. Neighbours come from displaced copies."""
    ring = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))
    now = settle(mask.select("r", "c").distinct(), "skeleton")
    for _ in range(most):
        gone = 0
        for first, second in (((0, 2, 4), (2, 4, 6)), ((0, 2, 6), (0, 4, 6))):
            near = focal.offsets(now, 1, lambda a, b: (a, b) != (0, 0)).withColumn("k", _ring_of(ring))
            seen = now.join(near.groupBy("r", "c").agg(F.collect_set("k").alias("n")), ["r", "c"], "left").withColumn("n", F.coalesce("n", F.array().cast("array<int>")))
            on = [F.array_contains("n", k) for k in range(8)]
            rises = sum(((~on[k]) & on[(k + 1) % 8]).cast("int") for k in range(8))
            empty = lambda t: ~(on[t[0]] & on[t[1]] & on[t[2]])  # noqa: B023, E731
            leaves = F.size("n").between(2, 6) & (rises == 1) & empty(first) & empty(second)
            step = settle(seen.select("r", "c", leaves.alias("leaves")), "skeleton")
            gone += step.where("leaves").count()
            now = step.where("not leaves").select("r", "c")
        if not gone:
            return now
    raise RuntimeError(f"not thin after {most} rounds")


def _ring_of(ring: tuple) -> Column:
    """Index of the neighbour that an offset came from: a cell displaced by (dr, dc) sees its source at (-dr, -dc)."""
    out = F.lit(None).cast("int")
    for k, (a, b) in enumerate(ring):
        out = F.when((F.col("dr") == -a) & (F.col("dc") == -b), k).otherwise(out)
    return out


def trace_lengths(labelled: DataFrame, thinned: DataFrame, step: float = 108.0) -> DataFrame:
    """(component, length): step x the skeleton cells of each region, one at least."""
    n = labelled.join(thinned.withColumn("thin", F.lit(1)), ["r", "c"], "left").groupBy("component").agg(F.coalesce(F.sum("thin"), F.lit(0)).alias("n"))
    return n.select("component", (F.greatest("n", F.lit(1)) * step).alias("length"))


def phase_coherence(a: DataFrame, b: DataFrame) -> DataFrame:
    """(r, c, v): geometric mean of the gradient norms of two angle grids (column v)."""
    g = lambda x, n: focal.gradient(x.select("r", "c", "v"), "v").select("r", "c", F.col("slope").alias(n))
    return g(a, "x").join(g(b, "y"), ["r", "c"]).select("r", "c", F.sqrt(F.col("x") * F.col("y")).alias("v"))


def openness(cells: DataFrame, grid: GridSpec, value: str, radii: tuple[int, ...] = (5, 10, 20), tile: int = 128) -> DataFrame:
    """(r, c, value): mean over eight azimuths and the radii of 90 degrees less the steepest rise within the radius;
    heights beyond the edge repeat the edge."""
    far = max(radii)

    def kernel(z: np.ndarray) -> np.ndarray:
        total = np.zeros_like(z)
        for dr, dc in ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)):
            steep = np.full_like(z, -np.inf)
            for k in range(1, far + 1):
                d = k * math.hypot(dr, dc)
                if d <= far:
                    steep = np.maximum(steep, (np.roll(z, (-k * dr, -k * dc), (0, 1)) - z) / d)
                if k in radii:
                    total += 90 - np.degrees(np.arctan(steep))
        return total / (8 * len(radii))

    return tiles.tile_apply(cells, grid, value, far, kernel, tile)


def standardise(cells: DataFrame, grid: GridSpec, value: str, sigma: float = 0.8) -> DataFrame:
    """(r, c, value) on the rectangle: gaps filled from the nearest cell, clipped to the 1 % and 99 % quantiles, centred
    and scaled by the population deviation (zeros where that is under 1e-6), blurred with the border repeated. Quantiles,
    mean and deviation are those of the cells that have a value."""
    has = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    x = settle(fill_nearest(cells, grid, value, 0).select("r", "c", F.col(value).alias("v")), "standardise")
    own = cells.where(has).select(F.col(value).cast("double").alias("v"))
    q = own.agg(F.percentile("v", F.array(F.lit(0.01), F.lit(0.99))).alias("q"))
    cut = F.least(F.greatest("v", F.col("q")[0]), F.col("q")[1])
    m = own.crossJoin(F.broadcast(q)).agg(F.avg(cut).alias("m"), F.stddev_pop(cut).alias("s"), F.first("q").alias("q"))
    z = F.when(F.col("s") >= 1e-6, (cut - F.col("m")) / F.when(F.col("s") >= 1e-6, F.col("s"))).otherwise(0.0)
    return tiles.strip_gaussian(x.crossJoin(F.broadcast(m)).select("r", "c", z.alias(value)), value, sigma, border="nearest")


#: Directions of a line as (row, column) steps, lags along it, and cells off it of the two profiles compared: one on
#: either side, and twice both on one side. Fixed values.
LINES = ((1, 0), (1, 1), (0, 1), (-1, 1))
LAGS = (-3, -2, 2, 3)
PROFILES = ((2, -2), (6, 2), (-2, -6))


def _guarded(cells: DataFrame, grid: GridSpec, guard: int, columns: list[str]) -> DataFrame:
    """(r, c) more than `guard` cells from cells without all columns' values and from what is beyond the rectangle."""
    have = cells
    for c in columns:
        have = have.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    hole = grid.spine(cells.sparkSession).join(have.select("r", "c"), ["r", "c"], "left_anti")
    edge = F.least(F.col("r") + 1, F.lit(grid.height) - F.col("r"), F.col("c") + 1, F.lit(grid.width) - F.col("c"))
    return distance(hole, grid).where(F.coalesce(F.col("d") > guard, F.lit(True)) & (edge > guard)).select("r", "c")


def _profiles(x: np.ndarray, step: tuple[int, int], pair: tuple[int, int], half: int) -> tuple:
    """match(lag): correlation of the profiles at the pair's distances from the line, the second one moved along by
    `lag`; and where both vary."""
    (dr, dc), span = step, range(-half, half + 1)

    def moved(y: np.ndarray, r: int, c: int) -> np.ndarray:
        return np.roll(y, (r, c), (0, 1))

    def mean(y: np.ndarray) -> np.ndarray:
        return sum(moved(y, t * dr, t * dc) for t in span) / len(span)

    one, two = (moved(x, -o * dc, o * dr) for o in pair)
    m1, m2 = mean(one), mean(two)
    v1, v2 = np.maximum(mean(one * one) - m1 * m1, 0), np.maximum(mean(two * two) - m2 * m2, 0)

    def match(lag: int) -> tuple[np.ndarray, np.ndarray]:
        y, m, v = (moved(a, lag * dr, lag * dc) for a in (two, m2, v2))
        return np.clip((mean(one * y) - m1 * m) / np.sqrt(np.maximum(v1 * v, 1e-12)), -1, 1), np.minimum(v1, v)

    return match


def marker_displacement(cells: DataFrame, grid: GridSpec, first: str, second: str, lags: tuple[int, ...] = LAGS, half: int = 5, floor: float = 0.01, least: float = 0.5, guard: int = 25, tile: int = 128) -> DataFrame:
    """(r, c, first) of the guarded cells: how much better two standardised markers match across a line once one side is
    moved along it.

    In four directions, profiles of 2 half + 1 cells on either side are correlated as they are and moved by each lag;
    half of what a moved correlation over `least` has above the unmoved one is the gain (zero where a variance isn't over
    `floor`). The larger gain of two pairs of profiles of one side, at the same lag, is taken off, for an oblique pattern
    without a break gains as well. A cell takes the largest geometric mean of both markers' gains at one lag."""
    halo = max(map(abs, lags)) + max(abs(o) for p in PROFILES for o in p) + 2 * half + 1

    def gains(x: np.ndarray, step: tuple[int, int]) -> list[np.ndarray]:
        out = []
        for pair in PROFILES:
            match = _profiles(x, step, pair, half)
            still, _ = match(0)
            told = [match(lag) for lag in lags]
            out.append([np.where((v > floor) & (c > least), np.maximum(c - still, 0) / 2, 0) for c, v in told])
        return [np.maximum(a - np.maximum(b, c), 0) for a, b, c in zip(*out, strict=True)]

    def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        best = np.zeros_like(a)
        for step in LINES:
            for x, y in zip(gains(a, step), gains(b, step), strict=True):
                best = np.maximum(best, np.sqrt(x * y))
        return best

    return tiles.tile_apply(cells, grid, [first, second], halo, kernel, tile).join(_guarded(cells, grid, guard, [first, second]), ["r", "c"])


def unmoved_match(cells: DataFrame, grid: GridSpec, first: str, second: str, half: int = 5, guard: int = 25, tile: int = 128) -> DataFrame:
    """(r, c, first) of the guarded cells: the control at lag 0, the largest geometric mean over the directions of both
    markers' unmoved correlations across the line, at least 0."""

    def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        every = [np.sqrt(np.maximum(_profiles(a, s, PROFILES[0], half)(0)[0], 0) * np.maximum(_profiles(b, s, PROFILES[0], half)(0)[0], 0)) for s in LINES]
        return np.max(every, axis=0)

    return tiles.tile_apply(cells, grid, [first, second], 2 * half + 3, kernel, tile).join(_guarded(cells, grid, guard, [first, second]), ["r", "c"])
