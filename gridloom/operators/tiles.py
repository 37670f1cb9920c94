"""NumPy kernels on dense grids: strips of whole lines, and tiles with a halo."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.grid import GridSpec

PAD = {"reflect": "symmetric", "nearest": "edge", "zero": "constant", "wrap": "wrap"}


def strip_convolve(cells: DataFrame, value: str, axis: str, weights: list[float], border: str = "reflect", rows: int = 64) -> DataFrame:
    """Convolution along whole dense lines, `rows` lines to a group; any border, any number of weights."""
    across = "r" if axis == "c" else "c"
    w, k = np.array(weights), len(weights) // 2

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([across, axis])
        lines = pdf.groupby(across).ngroup().to_numpy()
        x = pdf.v.to_numpy().reshape(lines[-1] + 1, -1)
        wide = np.pad(x, ((0, 0), (k, k)), mode=PAD[border])
        out = np.zeros_like(x)
        for j in range(2 * k + 1):
            out += w[2 * k - j] * wide[:, j : j + x.shape[1]]
        return pd.DataFrame({"r": pdf.r, "c": pdf.c, value: out.ravel()})

    own = cells.select("r", "c", F.col(value).cast("double").alias("v"))
    return own.groupBy(F.floor(F.col(across) / rows)).applyInPandas(run, f"r int, c int, {value} double")


def strip_gaussian(cells: DataFrame, value: str, sigma: float, orders: tuple[int, int] = (0, 0), border: str = "reflect", truncate: float = 4.0) -> DataFrame:
    """As focal.gaussian(), for wide kernels."""
    from gridloom.operators.focal import taps

    out = strip_convolve(cells, value, "c", taps(sigma, orders[1], truncate), border)
    return strip_convolve(out, value, "r", taps(sigma, orders[0], truncate), border)


def tile_apply(cells: DataFrame, grid: GridSpec, value: str | list[str], halo: int, kernel: Callable[..., np.ndarray], tile: int = 128, border: str = "nearest") -> DataFrame:
    """kernel over tiles widened by `halo` cells on every side (at the rectangle's edge by `border`), one array for
    each value column; it returns one of the widened shape, whose core becomes the first value column."""
    names = [value] if isinstance(value, str) else list(value)
    lo = lambda x: F.floor((F.col(x) - halo) / tile)
    hi = lambda x: F.floor((F.col(x) + halo) / tile)
    last = {"r": (grid.height - 1) // tile, "c": (grid.width - 1) // tile}
    span = lambda x: F.sequence(F.greatest(lo(x), F.lit(0)), F.least(hi(x), F.lit(last[x])))
    wide = cells.select("r", "c", *[F.col(n).cast("double").alias(f"v{k}") for k, n in enumerate(names)]).withColumn("tr", F.explode(span("r"))).withColumn("tc", F.explode(span("c")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(pdf.tr.iloc[0]), int(pdf.tc.iloc[0])
        r0, r1 = tr * tile, min((tr + 1) * tile, grid.height)
        c0, c1 = tc * tile, min((tc + 1) * tile, grid.width)
        ra, rb, ca, cb = max(0, r0 - halo), min(grid.height, r1 + halo), max(0, c0 - halo), min(grid.width, c1 + halo)
        bands = []
        for k in range(len(names)):
            x = np.zeros((rb - ra, cb - ca))
            x[pdf.r.to_numpy() - ra, pdf.c.to_numpy() - ca] = pdf[f"v{k}"].to_numpy()
            bands.append(np.pad(x, ((halo - (r0 - ra), halo - (rb - r1)), (halo - (c0 - ca), halo - (cb - c1))), mode=PAD[border]))
        out = kernel(*bands)[halo : halo + r1 - r0, halo : halo + c1 - c0]
        rr, cc = np.mgrid[r0:r1, c0:c1]
        return pd.DataFrame({"r": rr.ravel(), "c": cc.ravel(), names[0]: out.ravel()})

    return wide.groupBy("tr", "tc").applyInPandas(run, f"r int, c int, {names[0]} double")
