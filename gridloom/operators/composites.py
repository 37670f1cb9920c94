"""Surfaces composed of focal, morphology and point operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import cells as fx
from gridloom.grid import GridSpec, dense
from gridloom.operators import focal, lineaments, tiles
from gridloom.operators.regions import label, large_regions
from gridloom.session import settle

KEY = ["r", "c"]

# The weights, scales and limits that define the composites.
ANOMALY_BOXES = {"ratio": 21, "rtp": 15, "cond": 21}
GRAVITY_SLOPE_WEIGHT = 10.0
TRUNK_SHARE, TRUNK_CELLS, TRUNK_BLUR = 0.965, 14, 2.5
TIP_NEAR, TIP_MID, RELAY, LOBE_ANGLE = 14.0, 24.0, 22.0, 35.0
TIP_IN_RELAY, LOBE_WEIGHT, NEAR_WEIGHT, RELAY_WEIGHT, GAIN_WEIGHT, MID_WEIGHT = 0.5, 0.35, 0.6, 0.4, 0.25, 0.5
UPFLOW, OUTFLOW, TERRAIN_BLUR = 11.0, 24.0, 4.0
ADVECTION, UPFLOW_WEIGHT, SHIFTED_WEIGHT, STEP_WEIGHT, STEP_MOST = 6.0, 0.55, 0.45, 0.3, 3.0
SLOPE_UNIT, SLOPE_LEAST, SLOPE_MOST = 6.0, 0.15, 1.5
THERMAL_UPFLOW, THERMAL_OUTFLOW = 0.6, 0.4
OWN_TILT_WEIGHT = 0.5
EDGE_QUANTILE, PRIOR_QUANTILE, NEUTRAL_SHARE = 0.99, 0.99, 0.02
DEVIATION_FLOOR, NORM_FLOOR, TERRAIN_FLOOR = 1e-6, 1e-6, 1e-5


def _blur(x: DataFrame, sigma: float, name: str, orders: tuple[int, int] = (0, 0)) -> DataFrame:
    """The dense column v of x blurred, as column `name`."""
    return tiles.strip_gaussian(x, "v", sigma, orders).select("r", "c", F.col("v").alias(name))


def _joined(first: DataFrame, *others: DataFrame) -> DataFrame:
    for x in others:
        first = first.join(x, KEY)
    return first


def _clip(v: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def alteration(bands: DataFrame, grid: GridSpec, slope_floor: float = 1.5) -> DataFrame:
    """(r, c, potassic, demagnetised, clay) of dense bands k, th, rtp, hg, cond, slope, gravity_slope: local anomalies
    (boxes of 21, 15 and 21 cells), zero where the slope is not above the floor."""
    steep = F.when(F.col("slope") > slope_floor, 1.0).otherwise(0.0)
    base = bands.withColumn("ratio", fx.potassic_ratio(F.col("k"), F.col("th")))
    part = [focal.local_anomaly(base.select(*KEY, F.col(n).cast("double").alias(a)), a, grid.height, grid.width, size) for (n, size), a in zip(ANOMALY_BOXES.items(), "afe", strict=True)]
    x = _joined(base, *part)
    return x.select(
        *KEY,
        (F.col("a") * steep).alias("potassic"),
        (F.greatest(-F.col("f"), F.lit(0.0)) * fx.log_positive(F.col("hg")) * steep).alias("demagnetised"),
        (F.greatest(F.col("e"), F.lit(0.0)) * (F.col("slope") + GRAVITY_SLOPE_WEIGHT * F.col("gravity_slope")) * steep).alias("clay"),
    )


def trunks(field: DataFrame, grid: GridSpec, share: float = TRUNK_SHARE, least: int = TRUNK_CELLS) -> DataFrame:
    """(r, c): thinned regions of at least `least` cells where the field (r, c, v on the footprint) reaches its
    `share` quantile."""
    x = settle(field.select(*KEY, "v"), "trunks")
    q = x.agg(F.percentile("v", share).alias("q"))
    thin = lineaments.skeleton(x.crossJoin(F.broadcast(q)).where("v >= q").select(*KEY))
    return large_regions(label(thin, grid), least).select(*KEY)


def wing_crack(trunk: DataFrame, gain: DataFrame, grid: GridSpec, near: float = TIP_NEAR, mid: float = TIP_MID, relay: float = RELAY, angle: float = LOBE_ANGLE) -> DataFrame:
    """(r, c, stress, relay) on the cells of gain (r, c, v): halos of trunk tips, stronger along the given angle to the
    trunk's tangent, and of junctions, raised by the gain over its deviation."""
    n = settle(focal.neighbours(trunk), "wing-ends")
    grid_of = lambda m, w: dense(m.select(*KEY, w.cast("double").alias("v")), grid, "v")
    tips = grid_of(n.where("n = 1"), F.lit(1.0))
    ends = grid_of(n.where("n = 1 or n >= 3"), F.when(F.col("n") == 1, TIP_IN_RELAY).otherwise(1.0))
    g = focal.gradient(_blur(grid_of(trunk, F.lit(1.0)), TRUNK_BLUR, "v"), "v")
    norm = F.col("slope") + NORM_FLOOR
    along = F.abs(-F.col("gc") / norm * math.cos(math.radians(angle)) + F.col("gr") / norm * math.sin(math.radians(angle)))
    s = gain.agg((F.stddev_pop("v") + DEVIATION_FLOOR).alias("s"))
    x = _joined(gain.select(*KEY, F.col("v").alias("gain")), g.select(*KEY, (1 + LOBE_WEIGHT * along).alias("lobe")), _blur(tips, near, "tip_near"), _blur(tips, mid, "tip_mid"), _blur(ends, relay, "halo")).crossJoin(F.broadcast(s))
    stress = (NEAR_WEIGHT * F.col("tip_near") * F.col("lobe") + RELAY_WEIGHT * F.col("halo")) * (1 + GAIN_WEIGHT * F.col("gain") / F.col("s"))
    return x.select(*KEY, stress.alias("stress"), (F.col("halo") + MID_WEIGHT * F.col("tip_mid")).alias("relay"))


def updip_conduit(sources: DataFrame, terrain: DataFrame, grid: GridSpec, near: float = UPFLOW, far: float = OUTFLOW) -> DataFrame:
    """(r, c, conduit, thermal) of heat sources (r, c, w) over dense terrain (elevation, slope, basement): the far plume,
    moved up-slope against its own gradient, with the near one, gated by slope and raised by the basement's step."""
    heat = dense(sources.groupBy(*KEY).agg(F.log1p(F.sum("w")).alias("v")), grid, "v")
    up = focal.gradient(_blur(terrain.select(*KEY, F.col("elevation").cast("double").alias("v")), TERRAIN_BLUR, "v"), "v").select(*KEY, *[(F.col(g) / (F.col("slope") + TERRAIN_FLOOR)).alias(u) for g, u in (("gr", "ur"), ("gc", "uc"))])
    plume = focal.gradient(_blur(heat, far, "v"), "v").select(*KEY, F.col("v").alias("outflow"), "gr", "gc")
    s = terrain.agg((F.stddev_pop("basement") + DEVIATION_FLOOR).alias("s"))
    x = _joined(terrain.select(*KEY, "slope", "basement"), up, plume, _blur(heat, near, "upflow")).crossJoin(F.broadcast(s))
    shifted = F.greatest(F.lit(0.0), F.col("outflow") - ADVECTION * (F.col("gr") * F.col("ur") + F.col("gc") * F.col("uc")))
    conduit = (UPFLOW_WEIGHT * F.col("upflow") + SHIFTED_WEIGHT * shifted) * _clip(F.col("slope") / SLOPE_UNIT, SLOPE_LEAST, SLOPE_MOST) * (1 + STEP_WEIGHT * _clip(F.col("basement") / F.col("s"), 0.0, STEP_MOST))
    return x.select(*KEY, conduit.alias("conduit"), (THERMAL_UPFLOW * F.col("upflow") + THERMAL_OUTFLOW * F.col("outflow")).alias("thermal"))


def tilt_worm(magnetic: DataFrame, gravity: DataFrame, grid: GridSpec, tile: int = 128) -> DataFrame:
    """(r, c, v): strike response of two tilt grids' (r, c, v) phase coherence and half the first one's gradient."""
    own = focal.gradient(magnetic.select(*KEY, "v"), "v").select(*KEY, "slope")
    x = lineaments.phase_coherence(magnetic, gravity).join(own, KEY).select(*KEY, (F.col("v") + OWN_TILT_WEIGHT * F.col("slope")).alias("v"))
    return lineaments.strike_response(x, grid, "v", tile=tile)


def dual_edge(a: DataFrame, b: DataFrame, interior: DataFrame) -> DataFrame:
    """(r, c, v) on the interior: phase_coherence() over its 99 % quantile there, at most 1."""
    x = settle(lineaments.phase_coherence(a, b).join(interior.select(*KEY).distinct(), KEY), "dual-edge")
    q = x.agg(F.greatest(F.percentile("v", EDGE_QUANTILE), F.lit(1e-6)).alias("q"))
    return x.crossJoin(F.broadcast(q)).select(*KEY, _clip(F.col("v") / F.col("q"), 0.0, 1.0).alias("v"))


def edge_agreement(a: DataFrame, b: DataFrame, grid: GridSpec, sigma: float) -> DataFrame:
    """(r, c, edge_a, edge_b, parallel, crossed): gradient norms of two blurred dense grids (r, c, v) over their 99 %
    quantiles, at most 1; their geometric mean by how parallel and by how perpendicular the gradients are."""
    part = []
    for x, n in ((a, "a"), (b, "b")):
        g = settle(focal.gradient(_blur(x, sigma, "v"), "v").select(*KEY, "gr", "gc", "slope"), f"edge-{n}")
        q = g.agg(F.greatest(F.percentile("slope", EDGE_QUANTILE), F.lit(1e-12)).alias("q"))
        part.append(g.crossJoin(F.broadcast(q)).select(*KEY, F.col("gr").alias(f"r_{n}"), F.col("gc").alias(f"c_{n}"), F.col("slope").alias(f"s_{n}"), _clip(F.col("slope") / F.col("q"), 0.0, 1.0).alias(f"edge_{n}")))
    x = part[0].join(part[1], KEY)
    scale = F.greatest(F.col("s_a") * F.col("s_b"), F.lit(1e-12))
    both = F.sqrt(F.col("edge_a") * F.col("edge_b"))
    return x.select(*KEY, "edge_a", "edge_b", (both * F.abs(F.col("r_a") * F.col("r_b") + F.col("c_a") * F.col("c_b")) / scale).alias("parallel"), (both * F.abs(F.col("r_a") * F.col("c_b") - F.col("c_a") * F.col("r_b")) / scale).alias("crossed"))


def complexity_prior(surface: DataFrame, known: DataFrame, grid: GridSpec, sigma: float = 50.0, strength: float = 1.0) -> DataFrame:
    """surface (r, c, p) times 1 + strength z: z is the blurred density of tips and junctions of the thinned known
    cells over its 99 % quantile on the surface, at most 1. The caller passes only what the information rule admits."""
    n = focal.neighbours(lineaments.skeleton(known)).where("n = 1 or n >= 3")
    density = _blur(dense(n.select(*KEY, F.lit(1.0).alias("v")), grid, "v"), sigma, "z")
    x = settle(surface.join(density, KEY), "complexity")
    q = x.agg(F.percentile("z", PRIOR_QUANTILE).alias("q"))
    z = F.when(F.col("q") > 0, F.least(F.col("z") / F.nullif("q", F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return x.crossJoin(F.broadcast(q)).withColumn("p", F.col("p") * (1 + strength * z)).drop("z", "q")


def oblique_prior(surface: DataFrame, known: DataFrame, grid: GridSpec, sigma: float = 100.0, fine: float = 2.0, strength: float = 1.0) -> DataFrame:
    """surface (r, c, p) times 1 + strength sin^2 of the angle between its own strike and the known cells'.

    The known strike is the structure tensor's axis of least change, the own one the Hessian's axis of largest
    curvature (at scale `fine`). Neutral where the tensor's trace is under 2 % of its 99 % quantile."""
    g = settle(focal.gradient(_blur(dense(known.select(*KEY, F.lit(1.0).alias("v")), grid, "v"), 1.0, "v"), "v"), "oblique")
    j = _joined(*[_blur(g.select(*KEY, (F.col(a) * F.col(b)).alias("v")), sigma, n) for a, b, n in (("gr", "gr", "jrr"), ("gr", "gc", "jrc"), ("gc", "gc", "jcc"))])
    p = dense(surface, grid, "p").withColumnRenamed("p", "v")
    h = _joined(*[_blur(p, fine, n, o) for o, n in (((2, 0), "hrr"), ((1, 1), "hrc"), ((0, 2), "hcc"))])
    x = settle(_joined(surface, j, h), "oblique-all").withColumn("trace", F.col("jrr") + F.col("jcc"))
    q = x.agg(F.percentile("trace", PRIOR_QUANTILE).alias("q"))
    normal = F.atan2(2 * F.col("jrc"), F.col("jcc") - F.col("jrr")) / 2
    strike = F.atan2(2 * F.col("hrc"), F.col("hcc") - F.col("hrr")) / 2
    turn = F.pow(F.cos(strike - normal), 2)  # the known strike is perpendicular to the normal
    boost = F.when((F.col("q") > 0) & (F.col("trace") >= NEUTRAL_SHARE * F.col("q")), 1 + strength * turn).otherwise(1.0)
    return x.crossJoin(F.broadcast(q)).withColumn("p", F.col("p") * boost).select(*surface.columns)
