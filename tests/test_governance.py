import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.grid import GridSpec
from gridloom.operators import learning
from gridloom.plans import governance as gov
from gridloom.sources import tiff


def test_single_use(tmp_path):
    path = str(tmp_path / "run.json")
    with pytest.raises(ZeroDivisionError), gov.SingleUseRun(path, "x"):
        raise ZeroDivisionError
    assert json.load(open(path))["status"] == "failed"
    with pytest.raises(FileExistsError), gov.SingleUseRun(path, "x"):
        pass
    with gov.SingleUseRun(str(tmp_path / "b.json"), "y"):
        pass
    assert json.load(open(tmp_path / "b.json"))["status"] == "finished"


def test_vault_and_confirmation():
    vault = gov.Vault()
    assert vault.evaluate_once(lambda x: x + 1, 1) == 2
    with pytest.raises(RuntimeError):
        vault.evaluate_once(lambda: 1)
    good = gov.hashlib.sha256(b"x").hexdigest()
    gov.confirm({"a": good}, {"a": good}, {"a": b"x"})
    for files in ({"a": b"y"}, {}):
        with pytest.raises(ValueError):
            gov.confirm({"a": good}, {"a": good}, files)


def test_bundle(spark, tmp_path):
    m = gov.manifest({"a": b"1"}, {"s": b"2"}, {"k": 3}, {"spark": "4"})
    assert gov.load_bundle(spark, str(tmp_path / "b"), m) is None
    gov.save_bundle(spark.range(3), str(tmp_path / "b"), m)
    assert gov.load_bundle(spark, str(tmp_path / "b"), m).count() == 3
    assert gov.load_bundle(spark, str(tmp_path / "b"), m | {"parameters": {"k": 4}}) is None


def test_fingerprint_and_export(spark, tmp_path):
    rows = [(r, c, r * 5 + c, (r * c % 7) / 7) for r in range(6) for c in range(5) if (r + c) % 4]
    df = spark.createDataFrame(rows, "r int, c int, cell_id long, p double")
    x = np.array([p for *_, p in rows], dtype="<f4")
    assert gov.fingerprint(df, block=7) == gov.fingerprint(df.repartition(3), block=7)
    assert gov.fingerprint(df, block=4) == gov.hashlib.sha256(b"f4" + x.tobytes()).hexdigest()
    binary = df.withColumn("p", (F.col("p") > 0.4).cast("double"))
    assert gov.fingerprint(binary) != gov.fingerprint(df) and gov.fingerprint(df.withColumn("p", -F.col("p") * 0)) == gov.fingerprint(df.withColumn("p", F.lit(0.0)))
    path = str(tmp_path / "o.tif")
    assert gov.export(df, GridSpec(6, 5), path) == len(rows)
    back = {(r.r, r.c): r.v for r in tiff.read_tiff(spark, path).collect()}
    assert all(back[r, c] == pytest.approx(p, abs=1e-7) for r, c, _, p in rows) and math.isnan(back[0, 0])
    with pytest.raises(FileExistsError):
        gov.export(df, GridSpec(6, 5), path)
    with pytest.raises(ValueError):
        gov.export(df.withColumn("p", F.lit(2.0)), GridSpec(6, 5), str(tmp_path / "p.tif"))


def test_small_things():
    assert gov.zip_single("a.tif", b"x" * 99) == gov.zip_single("a.tif", b"x" * 99)
    assert gov.json_documents(' {"a": 1}[2]\n 3 ') == [{"a": 1}, [2], 3]
    with pytest.raises(ValueError):
        gov.strict_json({"a": float("nan")})


def test_student_and_blocks():
    assert learning.student_survival(0, 5) == pytest.approx(0.5)
    assert learning.student_survival(2.015, 5) == pytest.approx(0.05, abs=1e-4)
    assert learning.student_survival(1, 1) == pytest.approx(0.25)
    assert learning.student_survival(-1.812, 10) == pytest.approx(0.95, abs=1e-4)
    out = learning.paired_blocks([0.2, 0.22, 0.25, 0.21], [0.1, 0.12, 0.13, 0.12])
    assert out["p_value"] < 0.001 and out["low"] > 0.08 and out["bootstrap_p"] < 0.01
    assert learning.kendall([(1, 1), (2, 2), (3, 3)]) == 1 and learning.kendall([(1, 3), (2, 2), (3, 1)]) == -1


def test_nonnegative_head():
    rng = np.random.default_rng(1)
    pos, neg = rng.normal(1.5, 1, (400, 3)), rng.normal(-1, 1, (1600, 3))
    head = learning.NonNegativeHead(0.2, epochs=15).fit(pos[:200], np.concatenate([pos[200:], neg]))
    assert (head.decision(pos) > 0).mean() > 0.85 and (head.decision(neg) > 0).mean() < 0.1


def test_out_of_fold_scores(spark):
    rows = [(r, c, r * 20 + c, float(r % 5 == 0), float(c), r % 5 == 0 and c % 2 == 0, r // 10) for r in range(20) for c in range(20)]
    df = spark.createDataFrame(rows, "r int, c int, cell_id long, a double, b double, known boolean, fold int")
    out = learning.out_of_fold_scores(df, ["a", "b"], "fold", [0, 1], df.where("known"), trees=3, depth=2)
    got = {r.cell_id: r.score for r in out.collect()}
    assert len(got) == 400 and got[0] > got[20]
