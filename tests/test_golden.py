"""Golden values and behaviour of single operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import cells as fx
from gridloom.grid import GridSpec, dense, require_same
from gridloom.operators import focal, forensics, metric, partition, points, regions, stats
from gridloom.plans.holdout import gate
from gridloom.sources import runs

CELL = "r int, c int, p double, truth boolean, valid boolean, known boolean"


def grid_rows(n, p=lambda r, c: 0.0, truth=lambda r, c: False, known=lambda r, c: False):
    return [(r, c, float(p(r, c)), truth(r, c), True, known(r, c)) for r in range(n) for c in range(n)]


def brute(rows, alpha=0.2, beta=0.8):
    p = {(r, c): v for r, c, v, *_ in rows}
    truth = [(r, c) for r, c, _, t, *_ in rows if t]
    k = lambda a, b: max(0.0, 1 - math.dist(a, b) / 3)
    tp = sum(max(v * k(x, t) for x, v in p.items()) for t in truth)
    fp = sum(0 if known else v * (1 - max((k((r, c), t) for t in truth), default=0)) for r, c, v, _, _, known in rows)
    return tp, fp, len(truth) - tp, tp / (tp + alpha * fp + beta * (len(truth) - tp) + 1e-7)


def test_tversky_brute(spark):
    rng = np.random.default_rng(3)
    v, t, k = rng.random((12, 12)), rng.random((12, 12)) < 0.08, rng.random((12, 12)) < 0.1
    rows = grid_rows(12, lambda r, c: v[r, c], lambda r, c: bool(t[r, c]), lambda r, c: bool(k[r, c]))
    got = metric.tversky(spark.createDataFrame(rows, CELL)).first()
    want = brute(rows)
    assert [got.tp_w, got.fp_w, got.fn_w, got.dti] == pytest.approx(list(want), abs=1e-9)
    assert got.mass == pytest.approx(v.sum()) and got.n_truth == t.sum()


def test_tversky_without_truth_and_known_neutral(spark):
    none = metric.tversky(spark.createDataFrame(grid_rows(5, lambda r, c: 0.5), CELL)).first()
    assert none.dti == 0 and none.fp_w == pytest.approx(12.5) and none.coverage == 0
    line = lambda extra: grid_rows(20, lambda r, c: r == 10 or (extra and r == 3), lambda r, c: r == 10, lambda r, c: r == 3)
    a, b = (metric.tversky(spark.createDataFrame(line(x), CELL), mask_predictions=True).first().dti for x in (False, True))
    assert a == pytest.approx(b) and a > 0.99


def test_tversky_rejects_bad_scores(spark):
    with pytest.raises(ValueError):
        metric.validate(spark.createDataFrame(grid_rows(2, lambda r, c: 1.5), CELL))


def test_worked_example_and_threshold(spark):
    assert round(3 / (3 + 0.2 * 1.89 + 0.8 * 2), 2) == 0.60
    row = spark.range(1).select(*(F.round(fx.inclusion_threshold(F.lit(x)), 4).alias(f"t{i}") for i, x in enumerate((0.1563, 0.3168)))).first()
    assert row.t0 == pytest.approx(0.0313, abs=1e-4) and row.t1 == pytest.approx(0.0634, abs=1e-4)


def test_sanitize(spark):
    v = [float("nan"), float("inf"), float("-inf"), -0.3, 1.7, 0.4]
    rows = spark.createDataFrame(list(enumerate(v)), "i int, v double").select("i", fx.sanitize(F.col("v")).alias("v")).orderBy("i").collect()
    assert [r.v for r in rows] == [0, 1, 0, 0, 1, 0.4]


def test_git_blob(spark):
    row = spark.createDataFrame([("hello\n",)], "t string").select(forensics.git_blob_sha1(F.col("t")).alias("h")).first()
    assert row.h == "ce013625030ba8dba906f756967f9e9ca394464a"


@pytest.mark.parametrize("payload", [[128], [3], [0, 0, 4]])
def test_bad_runs(payload):
    with pytest.raises(ValueError):
        runs.decode_runs(bytes(payload), 4)


def test_runs_round_trip(spark):
    grid = GridSpec(20, 30)
    cells = {(r, c) for r in range(20) for c in range(30) if (r * 7 + c * 3) % 5 < 2} | {(3, c) for c in range(30)} | {(4, c) for c in range(30)}
    mask = spark.createDataFrame(sorted(cells), "r int, c int")
    payload = runs.encode_mask(mask, grid)
    assert {(x.r, x.c) for x in runs.mask_cells(spark, payload, grid).collect()} == cells
    flat = [(r, c) in cells for r in range(20) for c in range(30)]
    changes = 1 + sum(a != b for a, b in zip(flat, flat[1:], strict=False)) + flat[0]
    assert len(runs.decode_runs(payload, 600)) == changes


def conv(x, w, axis, mode):
    k = len(w) // 2
    pad = [(0, 0), (0, 0)]
    pad[axis] = (k, k)
    return np.apply_along_axis(lambda v: np.convolve(v, w, "valid"), axis, np.pad(x, pad, mode=mode))


@pytest.mark.parametrize(("border", "mode"), [("reflect", "symmetric"), ("nearest", "edge")])
@pytest.mark.parametrize("orders", [(0, 0), (0, 2), (1, 1)])
def test_gaussian(spark, border, mode, orders):
    x = np.random.default_rng(5).random((18, 23))
    cells = spark.createDataFrame([(r, c, float(x[r, c])) for r in range(18) for c in range(23)], "r int, c int, v double")
    got = np.zeros_like(x)
    for row in focal.gaussian(cells, "v", 18, 23, 1.0, orders, border).collect():
        got[row.r, row.c] = row.v
    want = conv(conv(x, focal.taps(1.0, orders[1]), 1, mode), focal.taps(1.0, orders[0]), 0, mode)
    assert np.allclose(got, want, atol=1e-9)


def test_box_mean(spark):
    x = np.random.default_rng(6).random((11, 9))
    cells = spark.createDataFrame([(r, c, float(x[r, c])) for r in range(11) for c in range(9)], "r int, c int, v double")
    wide = np.pad(x, 3, mode="symmetric")
    for row in focal.box_mean(cells, "v", 11, 9, 7).collect():
        assert row.v == pytest.approx(wide[row.r : row.r + 7, row.c : row.c + 7].mean())


def test_regions_and_distance(spark):
    grid = GridSpec(15, 17)
    snake = {(r, c) for r in range(15) for c in range(17) if r % 4 == 0} | {(r, 0 if r // 4 % 2 else 16) for r in range(13)}
    spots = {(2, 5), (3, 6), (10, 3)} - snake
    mask = spark.createDataFrame(sorted({x for x in snake if x[0] < 13} | spots), "r int, c int")
    got = {(x.r, x.c): x.component for x in regions.label(mask, grid).collect()}
    cells = set(got)
    seen, want = set(), {}
    for start in sorted(cells):
        if start in seen:
            continue
        todo, own = [start], set()
        while todo:
            x = todo.pop()
            if x in own:
                continue
            own.add(x)
            todo += [(x[0] + a, x[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (x[0] + a, x[1] + b) in cells]
        seen |= own
        want |= dict.fromkeys(own, min(r * 17 + c for r, c in own))
    assert got == want
    dist = {(x.r, x.c): x.d for x in regions.distance(mask, grid).collect()}
    assert all(dist[r, c] == pytest.approx(min(math.dist((r, c), x) for x in cells)) for r in range(15) for c in range(17))
    assert regions.distance(mask.limit(0), grid).where("d is not null").count() == 0


def test_thin_is_whole_and_seeded(spark):
    grid = GridSpec(40, 40)
    labelled = regions.label(spark.createDataFrame([(r, c) for r in range(0, 40, 3) for c in range(40) if c % 4 < 2], "r int, c int"), grid)
    a = regions.thin(labelled, 0.2, 1)
    size = {r.component: r["count"] for r in labelled.groupBy("component").count().collect()}
    kept = {r.component: r["count"] for r in a.groupBy("component").count().collect()}
    assert len(kept) == round(0.2 * len(size)) and all(size[k] == n for k, n in kept.items())
    assert {r.component for r in regions.thin(labelled, 0.2, 2).collect()} != set(kept)


def test_site_estimates(spark):
    rows = [(0, 0, "a", 140.0), (0, 0, "b", 160.0), (0, 0, "c", 130.0), (1, 1, "a", 100.0), (2, 2, "a", -5.0), (3, 3, "a", 400.0), (3, 3, "b", 350.0)]
    got = {(r.r, r.c): r for r in points.site_estimates(spark.createDataFrame(rows, "r int, c int, kind string, value double"), ["a", "b", "c"], 0, 350, 120).collect()}
    assert got[0, 0].n_est == 3 and got[0, 0].t_med == 140 and got[0, 0].spread_rel == pytest.approx(30 / 140) and got[0, 0].eligible
    assert got[1, 1].n_est == 1 and not got[1, 1].eligible and got[2, 2].n_est == 0 and got[3, 3].t_med == 350


def test_gate():
    report = lambda d, s: {"mean_dense_dti": sum(d) / 4, "mean_sparse_dti": sum(s) / 4, "fold_dense": d, "fold_sparse": s}
    base = report([0.2] * 4, [0.1] * 4)
    assert gate(report([0.21] * 4, [0.11] * 4), base)["promoted"]
    assert not gate(report([0.21] * 4, [0.13, 0.13, 0.095, 0.095]), base)["rules"]["sparse_wins"]
    assert not gate(report([0.3, 0.3, 0.3, 0.18], [0.11] * 4), base)["rules"]["no_large_fold_loss"]
    with pytest.raises(ValueError):
        gate(report([0.2] * 4, [0.1] * 4) | {"mean_dense_dti": 0.3}, base)
    old = report([0.31, 0.2, 0.2, 0.2], [0.1] * 4)
    assert gate(report([0.30, 0.3, 0.3, 0.3], [0.11] * 4), old)["promoted"]  # a loss of 0.01 as rounded
    assert not gate(report([0.2999, 0.3, 0.3, 0.3], [0.11] * 4), old)["promoted"]
    for bad in ([0.2] * 3, [0.2] * 5, [0.2, 0.2, 0.2, float("nan")], [1.2, 0.2, 0.2, 0.2], [-0.1, 0.3, 0.3, 0.3]):
        with pytest.raises(ValueError):
            gate(report(bad, [0.1] * 4) | {"mean_dense_dti": sum(bad) / len(bad)}, base)
    for loss in (-0.01, float("inf"), float("nan")):
        with pytest.raises(ValueError):
            gate(base, base, max_fold_loss=loss)


def test_signflip_and_holm(spark):
    p = stats.signflip(spark, [0.1, 0.2, 0.3, 0.4]).first().p_value
    assert p == 1 / 16
    tests = spark.createDataFrame([(str(k), p if k == 0 else 0.9) for k in range(5)], "id string, p double")
    assert stats.adjust(tests).where("id = '0'").first().holm == pytest.approx(0.3125)


def test_brier_identity(spark):
    df = spark.createDataFrame([(0.1, 0.0), (0.4, 1.0)], "p double, y double")
    row = stats.brier(df, "p", "y", bins=1).first()
    assert row.brier == pytest.approx(0.185) and row.within == pytest.approx(-0.1275)
    assert row.brier == pytest.approx(row.reliability - row.resolution + row.uncertainty + row.within)
    empty = stats.reliability(df, "p", "y").where("bin = 9").first()
    assert empty["count"] == 0 and empty.rate is None


def test_verdicts(spark):
    base = [("a", k) for k in range(100)]
    sup = spark.createDataFrame(base + [("b", k) for k in range(100)] + [("c", k) for k in range(90)] + [("d", k) for k in range(40, 140)] + [("e", k) for k in range(500, 510)], "artifact string, cell_id long")
    got = {(r.a, r.b): r.verdict for r in forensics.pair_overlap(sup).collect()}
    assert got["a", "b"] == "DUPLICATE" and got["a", "c"] == "NEAR_DUPLICATE" and got["a", "d"] == "DISTINCT" and ("a", "e") not in got


def test_emit_budget_and_ties(spark):
    rows = [(k // 10, k % 10, k, 0.5, k % 3 == 0, 0) for k in range(100)]
    out = partition.emit(spark.createDataFrame(rows, "r int, c int, cell_id long, p double, ridge boolean, fold int"), 0.045)
    assert [r.cell_id for r in out.orderBy("rank").collect()] == [0, 3, 6, 9]


def test_grids_must_match(spark):
    with pytest.raises(ValueError):
        require_same(GridSpec(2, 3), GridSpec(3, 2))
    assert dense(spark.createDataFrame([(0, 1, 2.0)], "r int, c int, v double"), GridSpec(2, 2), "v").count() == 4


def test_stream(spark, tmp_path):
    from gridloom.streaming.artifacts import watch

    history = spark.createDataFrame([("h", k) for k in range(50)], "artifact string, cell_id long")
    spark.createDataFrame([("n", k) for k in range(45)], "artifact string, cell_id long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("artifact string, cell_id long").parquet(str(tmp_path / "in"))
    watch(stream, history, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    row = spark.read.parquet(str(tmp_path / "out")).first()
    assert row.inter == 45 and row.jaccard == 0.9 and row.verdict == "NEAR_DUPLICATE"
