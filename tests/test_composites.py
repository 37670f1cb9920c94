"""Composite surfaces and evidence tables against NumPy and by cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.grid import GridSpec
from gridloom.operators import composites, evidence

GRID = GridSpec(30, 26)


def frame(spark, **arrays):
    names = list(arrays)
    first = arrays[names[0]]
    rows = [(r, c, *(float(arrays[n][r, c]) for n in names)) for r in range(first.shape[0]) for c in range(first.shape[1])]
    return spark.createDataFrame(rows, "r int, c int, " + ", ".join(f"{n} double" for n in names))


def grid_of(df, name):
    out = np.full((GRID.height, GRID.width), np.nan)
    for x in df.collect():
        out[x.r, x.c] = x[name]
    return out


def blur(x, sigma, orders=(0, 0)):
    k = int(4 * sigma + 0.5)
    at = np.arange(-k, k + 1)
    g = np.exp(-0.5 * (at / sigma) ** 2)
    g /= g.sum()
    w = {0: g, 1: -at / sigma**2 * g, 2: (at**2 / sigma**4 - 1 / sigma**2) * g}
    for axis in (0, 1):
        pad = [(k, k) if a == axis else (0, 0) for a in (0, 1)]
        x = np.apply_along_axis(lambda v, f=w[orders[axis]]: np.convolve(v, f, "valid"), axis, np.pad(x, pad, mode="symmetric"))
    return x


def box(x, size):
    k = size // 2
    y = np.pad(x, k, mode="symmetric")
    return np.array([[y[r : r + size, c : c + size].mean() for c in range(x.shape[1])] for r in range(x.shape[0])])


@pytest.fixture(scope="module")
def a():
    return np.random.default_rng(3).random((GRID.height, GRID.width)) * 4


@pytest.fixture(scope="module")
def b():
    return np.random.default_rng(4).random((GRID.height, GRID.width)) * 3


def test_alteration(spark, a, b):
    df = frame(spark, k=a, th=b, rtp=a, hg=b, cond=b, slope=a, gravity_slope=b)
    got = composites.alteration(df, GRID)
    steep = a > 1.5
    ratio = (a + 1) / (b + 10)
    assert np.allclose(grid_of(got, "potassic"), (ratio - box(ratio, 21)) * steep)
    assert np.allclose(grid_of(got, "demagnetised"), np.maximum(box(a, 15) - a, 0) * np.log1p(b) * steep)
    assert np.allclose(grid_of(got, "clay"), np.maximum(b - box(b, 21), 0) * (a + 10 * b) * steep)


def test_wing_crack(spark, a):
    on = np.zeros_like(a)
    on[10, 5:20] = on[11:16, 12] = 1
    n = np.array([[sum(on[i, j] for i in range(max(0, r - 1), min(30, r + 2)) for j in range(max(0, c - 1), min(26, c + 2))) - on[r, c] for c in range(26)] for r in range(30)])
    tips, forks = (on * (n == 1)), (on * (n >= 3))
    gr, gc = np.gradient(blur(on, 2.5))
    norm = np.hypot(gr, gc) + 1e-6
    lobe = 1 + 0.35 * np.abs(-gc / norm * math.cos(math.radians(35)) + gr / norm * math.sin(math.radians(35)))
    halo = blur(forks + 0.5 * tips, 5)
    want = (0.6 * blur(tips, 3) * lobe + 0.4 * halo) * (1 + 0.25 * a / (a.std() + 1e-6))
    got = composites.wing_crack(frame(spark, on=on).where("on = 1"), frame(spark, v=a), GRID, 3, 4, 5)
    assert np.allclose(grid_of(got, "stress"), want)
    assert np.allclose(grid_of(got, "relay"), halo + 0.5 * blur(tips, 4))


def test_updip(spark, a, b):
    heat = spark.createDataFrame([(4, 5, 1.0), (4, 5, 2.0), (20, 9, 1.5)], "r int, c int, w double")
    src = np.zeros_like(a)
    src[4, 5], src[20, 9] = 3, 1.5
    src = np.log1p(src)
    er, ec = np.gradient(blur(a, 4))
    m = np.hypot(er, ec) + 1e-5
    out = blur(src, 5)
    tr, tc = np.gradient(out)
    shifted = np.maximum(0, out - 6 * (tr * er / m + tc * ec / m))
    want = (0.55 * blur(src, 3) + 0.45 * shifted) * np.clip(b / 6, 0.15, 1.5) * (1 + 0.3 * np.clip(a / (a.std() + 1e-6), 0, 3))
    got = composites.updip_conduit(heat, frame(spark, elevation=a, slope=b, basement=a), GRID, 3, 5)
    assert np.allclose(grid_of(got, "conduit"), want)
    assert np.allclose(grid_of(got, "thermal"), 0.6 * blur(src, 3) + 0.4 * out)


def test_edges(spark, a, b):
    got = composites.edge_agreement(frame(spark, v=a), frame(spark, v=b), GRID, 1.0)
    (ar, ac), (br, bc) = np.gradient(blur(a, 1)), np.gradient(blur(b, 1))
    sa, sb = np.hypot(ar, ac), np.hypot(br, bc)
    na, nb = np.minimum(sa / np.quantile(sa, 0.99), 1), np.minimum(sb / np.quantile(sb, 0.99), 1)
    assert np.allclose(grid_of(got, "edge_a"), na)
    assert np.allclose(grid_of(got, "parallel"), np.sqrt(na * nb) * np.abs(ar * br + ac * bc) / (sa * sb))
    assert np.allclose(grid_of(got, "crossed"), np.sqrt(na * nb) * np.abs(ar * bc - ac * br) / (sa * sb))
    both = np.sqrt(np.hypot(*np.gradient(a)) * np.hypot(*np.gradient(b)))
    edge = composites.dual_edge(frame(spark, v=a), frame(spark, v=b), GRID.spine(spark))
    assert np.allclose(grid_of(edge, "v"), np.clip(both / np.quantile(both, 0.99), 0, 1))


def test_complexity_prior(spark, a):
    on = np.zeros_like(a)
    on[10, 5:20] = 1
    ends = np.zeros_like(a)
    ends[10, 5] = ends[10, 19] = 1
    d = blur(ends, 3)
    got = composites.complexity_prior(frame(spark, p=a), frame(spark, on=on).where("on = 1"), GRID, 3)
    assert np.allclose(grid_of(got, "p"), a * (1 + np.minimum(d / np.quantile(d, 0.99), 1)))
    none = composites.complexity_prior(frame(spark, p=a), frame(spark, on=on).where("on = 2"), GRID, 3)
    assert np.allclose(grid_of(none, "p"), a)


def test_oblique_prior(spark):
    """Known cells run along rows: a ridge along a column doubles, one along a row stays."""
    known, p = np.zeros((30, 26)), np.zeros((30, 26))
    known[15, :] = 1
    p[22, 3:23] = 0.4
    p[2:12, 12] = 0.4
    got = grid_of(composites.oblique_prior(frame(spark, p=p), frame(spark, k=known).where("k = 1"), GRID, 12.0), "p")
    assert got[22, 12] == pytest.approx(0.4, rel=0.02) and got[7, 12] == pytest.approx(0.8, rel=0.02)
    same = composites.oblique_prior(frame(spark, p=p), frame(spark, k=known).where("k = 2"), GRID, 12.0)
    assert np.allclose(grid_of(same, "p"), p)


def test_trunks(spark):
    x = np.zeros((30, 26))
    x[8, 2:22] = 5
    x[20, 2:7] = 5
    got = {(r.r, r.c) for r in composites.trunks(frame(spark, v=x), GRID, 0.969, 14).collect()}
    assert got and {r for r, _ in got} == {8} and len(got) >= 14


def test_evidence_edges(spark):
    few = spark.createDataFrame([(3, 3), (9, 9)], "r int, c int")
    none = few.where("r < 0")
    rows = {r.reach: r for r in evidence.agreement(few, none).collect()}
    assert len(rows) == 4 and rows[3].mask_within == 0 and rows[3].labels_cells == 0 and rows[3].labels_within is None
    same = {r.reach: r for r in evidence.agreement(few, few).collect()}
    assert same[0].mask_within == same[0].labels_within == 1
    pts = few.withColumn("kind", F.lit("x"))
    far = evidence.orphans(pts, none, GRID, "kind").first()
    assert (far.n, far.beyond_5, far.share_10) == (2, 2, 1.0)
    seen = evidence.draw_scores(few.withColumn("p", F.lit(1.0)), few.withColumn("component", F.col("r").cast("long")), 0.5, 7, 3).collect()
    assert sorted(r.draw for r in seen) == [0, 1, 2] and all(r.dti == pytest.approx(1, abs=1e-6) for r in seen)
