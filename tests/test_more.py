import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.grid import GridSpec
from gridloom.operators import forensics, lineaments, points
from gridloom.plans import holdout
from gridloom.sources import readers


def test_holdout_reports(spark):
    grid = GridSpec(40, 40)
    foot = grid.spine(spark)
    labels = foot.where("(r % 6 = 0) and (c % 8 < 4)")
    h = holdout.build(foot, labels, grid, 0.2, 1).cache()
    n = {r.fold: (r.d, r.s) for r in h.groupBy("fold").agg(F.count_if("dense").alias("d"), F.count_if("sparse").alias("s")).collect()}
    assert sorted(n) == [0, 1, 2, 3] and all(0 < s < d for d, s in n.values())
    perfect = holdout.evaluate(labels.withColumn("p", F.lit(1.0)), h).collect()
    assert len(perfect) == 8 and all(r.dti == pytest.approx(1, abs=1e-5) for r in perfect)
    rep = holdout.report(holdout.evaluate(labels.withColumn("p", F.lit(1.0)), h))
    worse = holdout.report(holdout.evaluate(foot.withColumn("p", F.lit(0.5)), h))
    assert holdout.gate(rep, worse)["promoted"] and not holdout.gate(worse, rep)["promoted"]
    h.unpersist()


def test_history_lineage_ledger(spark):
    history = spark.createDataFrame([("same", k) for k in range(50)] + [("near", k) for k in range(45)] + [("far", 900 + k) for k in range(9)], "artifact string, cell_id long")
    mine = spark.range(50).select(F.col("id").alias("cell_id"))
    got = {r.artifact: r.verdict for r in forensics.against_history(mine, history).collect()}
    assert got == {"same": "DUPLICATE", "near": "NEAR_DUPLICATE", "far": "DISTINCT"}
    assert {r.verdict for r in forensics.against_history(mine.limit(0), history).collect()} == {"DISTINCT"}
    e = spark.createDataFrame([("a", "x", "s1"), ("b", "y", "s1"), ("c", "x", "s2")], "id string, repo string, sha string")
    rows = {r.sha: (r.n, r.repos, r.first_id) for r in forensics.lineage(e).collect()}
    assert rows == {"s1": (2, ["x", "y"], "a"), "s2": (1, ["x"], "c")}
    assert {r.id: r.rep for r in forensics.with_representative(e, spark.createDataFrame([("b", "a")], "id string, rep string")).collect()} == {"a": "a", "b": "a", "c": "c"}
    led = spark.createDataFrame([("a", 0.2, "1"), ("a", 0.1, "2")], "id string, score double, recorded_utc string")
    row = forensics.best_scores(led).first()
    assert (row.best, row.latest, row.n) == (0.2, 0.1, 2)


def test_readers(spark, tmp_path):
    (tmp_path / "p.csv").write_text("name,row,temp\na,1,2.5\nb,2,nan\n")
    rows = readers.read_points(spark, str(tmp_path / "p.csv"), "name string, row int, temp double").collect()
    assert [(r.name, r.row, r.temp) for r in rows] == [("a", 1, 2.5), ("b", 2, None)]
    (tmp_path / "r.json").write_text(json.dumps({"entries": [{"id": "x", "lb_score": 0.1}, {"id": "y"}]}, indent=1))
    assert {r.id: r.lb_score for r in readers.read_registry(spark, str(tmp_path / "r.json")).collect()} == {"x": 0.1, "y": None}
    pages = spark.createDataFrame([('[{"a": 1}][{"a": 2}, {"a": 3}]',), (' {"a": 4} ',), (None,)], "t string")
    assert sorted(r.a for r in readers.json_pages(pages, "t", "a:int").collect()) == [1, 2, 3, 4]


def test_lines(spark):
    grid = GridSpec(10, 10, 0, (1.0, 0.0, 0.0, 0.0, -1.0, 10.0))
    df = spark.createDataFrame([(1, [(0.5, 9.5), (5.5, 9.5), (5.5, 4.5)]), (2, [(2.5, 2.5)])], "id int, points array<struct<x:double,y:double>>")
    got = {(r.r, r.c) for r in points.rasterise(df, grid).where("id = 1").collect()}
    assert got == {(0, c) for c in range(6)} | {(r, 5) for r in range(6)}
    rows = {r.id: r for r in points.line_lengths(df).collect()}
    assert rows[1].length == 10 and rows[1].x == pytest.approx(4.25) and rows[1].y == pytest.approx(8.25) and rows[2].length == 0 and rows[2].x == 2.5


def test_openness(spark):
    z = np.zeros((30, 30))
    z[15, 15] = 10
    df = spark.createDataFrame([(r, c, float(z[r, c])) for r in range(30) for c in range(30)], "r int, c int, v double")
    grid = GridSpec(30, 30)
    whole, cut = ({(r.r, r.c): r.v for r in lineaments.openness(df, grid, "v", (2, 4), t).collect()} for t in (64, 8))
    assert whole == pytest.approx(cut) and whole[0, 0] == 90 and whole[15, 15] > 90 and whole[15, 14] < 90
    assert whole[15, 14] == pytest.approx(90 - math.degrees(math.atan(10)) / 8)


def frame_of(spark, **bands):
    h, w = next(iter(bands.values())).shape
    names = list(bands)
    rows = [(r, c, *(float(bands[n][r, c]) for n in names)) for r in range(h) for c in range(w)]
    return spark.createDataFrame(rows, "r int, c int, " + ", ".join(f"{n} double" for n in names))


def test_marker_displacement(spark):
    """Against the definition, cell by cell with np.corrcoef, far from the borders."""
    grid, rng = GridSpec(64, 68), np.random.default_rng(3)
    t = np.repeat(np.convolve(rng.normal(size=90), np.ones(3) / 3, "same")[None, :], 64, axis=0)
    bands = {}
    for n in "ab":
        x = t[:, 10:78] + rng.normal(size=(64, 68)) * 0.05
        x[32:] = t[32:, 13:81]
        bands[n] = x / x.std()
    df = frame_of(spark, **bands)

    def profile(x, r, c, step, off, lag):
        (dr, dc) = step
        return np.array([x[r - lag * dr + off * dc + k * dr, c - lag * dc - off * dr + k * dc] for k in range(-5, 6)])

    def corr(x, r, c, step, pair, lag):
        p, q = profile(x, r, c, step, pair[0], 0), profile(x, r, c, step, pair[1], lag)
        vp, vq = p.var(), q.var()
        return np.clip(((p * q).mean() - p.mean() * q.mean()) / np.sqrt(max(vp * vq, 1e-12)), -1, 1), min(vp, vq)

    def want(r, c):
        best = 0.0
        for step in ((1, 0), (1, 1), (0, 1), (-1, 1)):
            for lag in (-3, -2, 2, 3):
                both = []
                for n in "ab":
                    g = []
                    for pair in ((2, -2), (6, 2), (-2, -6)):
                        now, v = corr(bands[n], r, c, step, pair, lag)
                        g.append(max(now - corr(bands[n], r, c, step, pair, 0)[0], 0) / 2 if v > 0.01 and now > 0.5 else 0.0)
                    both.append(max(g[0] - max(g[1], g[2]), 0))
                best = max(best, np.sqrt(both[0] * both[1]))
        return best

    got = {t: {(r.r, r.c): r.a for r in lineaments.marker_displacement(df, grid, "a", "b", tile=t).collect()} for t in (64, 24)}
    inside = {(r, c) for r in range(25, 39) for c in range(25, 43)}
    assert got[64].keys() == got[24].keys() == inside
    for at in inside:
        assert np.isclose(got[64][at], want(*at), atol=1e-9) and np.isclose(got[24][at], got[64][at])
    assert max(got[64].values()) > 0.2
    still = {(r.r, r.c): r.a for r in lineaments.unmoved_match(df, grid, "a", "b", tile=24).collect()}
    for at in inside:
        pairs = [max(corr(bands["a"], *at, s, (2, -2), 0)[0], 0) * max(corr(bands["b"], *at, s, (2, -2), 0)[0], 0) for s in ((1, 0), (1, 1), (0, 1), (-1, 1))]
        assert np.isclose(still[at], np.sqrt(max(pairs)), atol=1e-9)


def test_strike_response_by_definition(spark):
    grid, rng = GridSpec(40, 44), np.random.default_rng(5)
    x = rng.normal(size=(40, 44)).cumsum(axis=1)
    gap = rng.random(x.shape) < 0.03
    rows = [(r, c, float(x[r, c])) for r in range(40) for c in range(44) if not gap[r, c]]
    got = {(r.r, r.c): r.v for r in lineaments.strike_response(spark.createDataFrame(rows, "r int, c int, v double"), grid, "v", tile=16).collect()}
    y = np.where(gap, 0, x)
    wide = np.pad(y, 15, mode="symmetric")
    box = np.lib.stride_tricks.sliding_window_view(wide, (31, 31))
    m, q = box.mean((2, 3)), (box**2).mean((2, 3))
    z = np.clip((y - m) / (np.sqrt(np.maximum(q - m * m, 1e-6)) + 0.25), -3, 6)
    for r, c in [(20, 20), (0, 0), (39, 43), (7, 30), (33, 4)]:
        if gap[r, c]:
            continue
        best = 0.0
        for deg in range(0, 180, 30):
            u, v = np.sin(np.radians(deg)), np.cos(np.radians(deg))
            at = lambda a, b: z[min(max(r + 8 - round(8 + a), 0), 39), min(max(c + 8 - round(8 + b), 0), 43)]  # noqa: B023, E731
            line = [np.mean([at(t * u - s * 3 * v, t * v + s * 3 * u) for t in range(-7, 8)]) for s in (0, 1, -1)]
            best = max(best, line[0] - (line[1] + line[2]) / 2)
        assert np.isclose(got[r, c], best, atol=1e-6), (r, c)
    assert len(got) == len(rows)


def test_standardise(spark):
    grid = GridSpec(12, 12)
    df = spark.createDataFrame([(r, c, float(r * c)) for r in range(12) for c in range(12) if (r, c) != (5, 5)], "r int, c int, v double")
    rows = lineaments.standardise(df, grid, "v").collect()
    own = np.array([float(r * c) for r in range(12) for c in range(12) if (r, c) != (5, 5)])
    lo, hi = np.quantile(own, [0.01, 0.99])
    z = np.array([[float(r * c) if (r, c) != (5, 5) else 20.0 for c in range(12)] for r in range(12)]).clip(lo, hi)  # filled from (4, 5)
    z = (z - own.clip(lo, hi).mean()) / own.clip(lo, hi).std()
    w = np.exp(-0.5 * (np.arange(-3, 4) / 0.8) ** 2)
    w /= w.sum()
    wide = np.pad(z, 3, mode="edge")
    want = sum(w[a] * w[b] * wide[a : a + 12, b : b + 12] for a in range(7) for b in range(7))
    assert len(rows) == 144 and all(np.isclose(r.v, want[r.r, r.c]) for r in rows)
    flat = lineaments.standardise(df.withColumn("v", F.lit(3.0)), grid, "v").collect()
    assert {r.v for r in flat} == {0.0}


def test_quantile_map_at_1001_knots(spark):
    from gridloom.operators.partition import quantile_map

    rng = np.random.default_rng(8)
    x, y = rng.exponential(size=3000) ** 2, rng.normal(size=3000)
    df = spark.createDataFrame([(0, k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))], "g int, k int, x double, y double")
    at = np.linspace(0, 1, 1001)
    want = np.interp(x, np.quantile(x, at), np.quantile(y, at))
    got = {r.k: r.mapped for r in quantile_map(df, "x", "y", "g").collect()}
    assert all(np.isclose(got[k], want[k]) for k in range(3000))
