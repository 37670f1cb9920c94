import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.grid import GridSpec
from gridloom.operators import focal, lineaments, tiles
from gridloom.sources import tiff


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("compression", [1, 5, 8])
@pytest.mark.parametrize(("predictor", "kind"), [(1, "f4"), (3, "f4"), (2, "i2"), (1, "u1"), (3, "f8")])
@pytest.mark.parametrize("shape", [{"rows_per_strip": 7}, {"tile": 16}, {}])
def test_tiff_round_trip(tmp_path, order, compression, predictor, kind, shape):
    rng = np.random.default_rng(1)
    x = (rng.random((2, 37, 29)) * 100).astype(kind)
    x[:, 5:20] = x[:, 5:6]
    raw = tiff.write(x, compression=compression, predictor=predictor, order=order, **shape)
    read = lambda a, n: raw[a : a + n]
    header = tiff.parse(read)
    got = np.zeros_like(x)
    for offset, size, r, c, rows, columns, _ in tiff.blocks(header):
        b = tiff.block(header, read(offset, size), rows, columns, 2)[: 37 - r, : 29 - c]
        got[:, r : r + b.shape[0], c : c + b.shape[1]] = np.moveaxis(b, -1, 0)
    assert np.array_equal(got, x)


def test_tiff_fails_closed():
    raw = tiff.write(np.ones((1, 8, 8), "f4"), compression=8, nodata="-1")
    header = tiff.parse(lambda a, n: raw[a : a + n])
    assert header.fields["nodata"] == "-1" and header.fields["pixel_scale"][0] == 1
    with pytest.raises(ValueError):
        tiff.parse(lambda a, n: raw[:20][a : a + n])
    with pytest.raises(ValueError):
        tiff.block(header, tiff.zlib.compress(b"abc"), 8, 8, 1)
    big = np.random.default_rng(0).integers(0, 256, 9000).astype(np.uint8).tobytes()
    assert tiff.unpack_lzw(tiff.pack_lzw(big)) == big


def test_tiff_source(spark, tmp_path):
    x = np.arange(2 * 30 * 20, dtype="f4").reshape(2, 30, 20)
    (tmp_path / "x.tif").write_bytes(tiff.write(x, compression=8, rows_per_strip=4))
    df = tiff.read_tiff(spark, str(tmp_path / "x.tif"))
    assert df.count() == x.size
    assert all(x[r.band - 1, r.r, r.c] == r.v for r in df.collect())
    assert tiff.read_tiff(spark, str(tmp_path / "x.tif"), [2]).agg(F.min("v")).first()[0] == 600


def frame(spark, x):
    return spark.createDataFrame([(r, c, float(x[r, c])) for r in range(x.shape[0]) for c in range(x.shape[1])], "r int, c int, v double")


def array(df, shape, name="v"):
    out = np.full(shape, np.nan)
    for row in df.collect():
        out[row.r, row.c] = row[name]
    return out


def test_strips_equal_windows(spark):
    x = np.random.default_rng(2).random((30, 41))
    for border in ("reflect", "nearest", "zero"):
        a = array(tiles.strip_gaussian(frame(spark, x), "v", 1.0, (0, 1), border), x.shape)
        b = array(focal.gaussian(frame(spark, x), "v", 30, 41, 1.0, (0, 1), border), x.shape)
        assert np.allclose(a, b, atol=1e-9)


def test_strike_response_by_tiles(spark):
    x = np.random.default_rng(4).random((50, 44))
    grid = GridSpec(50, 44)
    whole = array(lineaments.strike_response(frame(spark, x), grid, "v", 3, 2, tile=64), x.shape)
    cut = array(lineaments.strike_response(frame(spark, x), grid, "v", 3, 2, tile=16), x.shape)
    assert np.allclose(whole, cut) and (whole >= 0).all()
    line = np.zeros((40, 40))
    line[20] = 1
    got = array(lineaments.strike_response(frame(spark, line), GridSpec(40, 40), "v", 4, 2, box=0), line.shape)
    assert got[20, 20] == pytest.approx(1) and got[10, 10] == 0


def test_ridge_cells(spark):
    rr, cc = np.mgrid[0:40, 0:40]
    for x in (np.exp(-((rr - 20) ** 2) / 8), np.exp(-((rr - cc) ** 2) / 16), np.exp(-((cc - 12) ** 2) / 8)):
        got = array(lineaments.ridge_cells(frame(spark, x), "v", 40, 40), x.shape, "ridge")
        on = np.isclose(x, 1)
        inner = (rr > 3) & (rr < 36) & (cc > 3) & (cc < 36)
        assert (got[on & inner] == 1).all() and (got[(x < 0.7) & inner] == 0).all()


def test_hessian_lines(spark):
    rr, cc = np.mgrid[0:48, 0:40]
    x = np.exp(-((rr - 24) ** 2) / 18)
    inside = frame(spark, x).where("r between 3 and 44 and c between 3 and 36")
    ridge = array(lineaments.hessian_lines(frame(spark, x), inside, "v", sigmas=(2, 3)), x.shape, "response")
    trough = array(lineaments.hessian_lines(frame(spark, -x), inside, "v", "trough", sigmas=(2, 3)), x.shape, "response")
    assert np.allclose(ridge, trough) and ridge[24, 20] > 0.7 and ridge[8, 20] < 0.05 and ridge[0, 0] == 0


def test_fill_nearest(spark):
    rng = np.random.default_rng(7)
    x = rng.random((18, 16))
    keep = rng.random((18, 16)) < 0.15
    have = {(r, c): x[r, c] for r in range(18) for c in range(16) if keep[r, c]}
    cells = spark.createDataFrame([(r, c, float(v)) for (r, c), v in have.items()], "r int, c int, v double")
    got = array(lineaments.fill_nearest(cells, GridSpec(18, 16), "v"), x.shape)
    for r in range(18):
        for c in range(16):
            assert got[r, c] == have[min(have, key=lambda k: ((k[0] - r) ** 2 + (k[1] - c) ** 2, k))]


def test_point_and_transfer_fields(spark):
    grid = GridSpec(60, 60)
    spot = spark.createDataFrame([(30, 30, 2.0)], "r int, c int, w double")
    got = array(lineaments.point_field(spot, grid.spine(spark), grid), (60, 60))
    assert got[30, 30] == 1 and got[30, 30 + 17] == 0 and got[30, 33] == pytest.approx(math.exp(-9 / 50))
    far = array(lineaments.transfer_field(spot, grid.spine(spark), grid, 4.0), (60, 60))
    assert far[30, 30] == 1 and far[27, 34] == pytest.approx(math.exp(-25 / 32))


def zhang_suen(x):
    x = x.copy()
    ring = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))
    while True:
        changed = False
        for a, b in (((0, 2, 4), (2, 4, 6)), ((0, 2, 6), (0, 4, 6))):
            p = np.pad(x, 1)
            n = [np.roll(p, (-dr, -dc), (0, 1))[1:-1, 1:-1] for dr, dc in ring]
            rises = sum((~n[k]) & n[(k + 1) % 8] for k in range(8)) if False else np.sum([(~n[k]) & n[(k + 1) % 8] for k in range(8)], axis=0)
            gone = x & (np.sum(n, axis=0) >= 2) & (np.sum(n, axis=0) <= 6) & (rises == 1) & ~(n[a[0]] & n[a[1]] & n[a[2]]) & ~(n[b[0]] & n[b[1]] & n[b[2]])
            changed |= gone.any()
            x &= ~gone
        if not changed:
            return x


def test_skeleton(spark):
    x = np.zeros((20, 24), bool)
    x[5:11, 3:20] = x[2:18, 8:12] = True
    got = {(r.r, r.c) for r in lineaments.skeleton(frame(spark, x.astype(float)).where("v > 0")).collect()}
    assert got == set(zip(*(k.tolist() for k in np.nonzero(zhang_suen(x))), strict=True))
