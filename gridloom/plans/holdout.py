"""Spatially blocked evaluation and promotion."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.metric import tversky


def fold_scores(cells: DataFrame, alpha: float = 0.2, beta: float = 0.8) -> DataFrame:
    """tversky() of every fold in one plan; known cells cost nothing and nothing is credited across folds."""
    return tversky(cells, alpha, beta, by=("fold",))


def mean_score(folds: DataFrame) -> DataFrame:
    """(mean_dti, fold_dti): the mean and the vector in fold order."""
    v = F.transform(F.array_sort(F.collect_list(F.struct("fold", "dti"))), lambda x: F.round(x["dti"], 5))
    return folds.agg(F.round(F.avg("dti"), 5).alias("mean_dti"), v.alias("fold_dti"))


def gate(candidate: dict, baseline: dict, max_fold_loss: float = 0.01, tolerance: float = 5e-5) -> dict:
    """Promotion rules on reports of mean_dense_dti, mean_sparse_dti, fold_dense, fold_sparse; losses are compared after
    rounding to five digits. Raises ValueError where the bound isn't finite and at least 0, where a vector isn't four
    finite scores of 0 to 1, and where a mean isn't that of its vector."""
    if not (math.isfinite(max_fold_loss) and max_fold_loss >= 0):
        raise ValueError("max_fold_loss must be finite and at least 0")
    for report in (candidate, baseline):
        for kind in ("dense", "sparse"):
            v, mean = list(report[f"fold_{kind}"]), report[f"mean_{kind}_dti"]
            if len(v) != 4 or not all(math.isfinite(x) and 0 <= x <= 1 for x in v):
                raise ValueError(f"fold_{kind} is not four finite scores of 0 to 1")
            if not math.isfinite(mean) or abs(sum(v) / 4 - mean) > tolerance:
                raise ValueError(f"mean_{kind}_dti is not the mean of fold_{kind}")
    change = {k: [a - b for a, b in zip(candidate[f"fold_{k}"], baseline[f"fold_{k}"], strict=True)] for k in ("dense", "sparse")}
    worst = {k: round(min(v), 5) for k, v in change.items()}
    rules = {
        "dense_mean_improves": candidate["mean_dense_dti"] > baseline["mean_dense_dti"],
        "sparse_mean_improves": candidate["mean_sparse_dti"] > baseline["mean_sparse_dti"],
        "sparse_wins": sum(x > 0 for x in change["sparse"]) >= 3,
        "no_large_fold_loss": min(worst.values()) >= -max_fold_loss,
    }
    return {"rules": rules, "promoted": all(rules.values()), "worst_change": worst, "wins": {k: sum(x > 0 for x in v) for k, v in change.items()}}


def gate_table(scores: DataFrame, max_fold_loss: float = 0.01) -> DataFrame:
    """gate() as a plan, for scores (kind: dense or sparse, fold, candidate, baseline) of any number of folds: one row of
    the rules, the sparse wins and the worst changes, rounded to five digits. A missing score is a worst change of null,
    which promotes nothing."""
    d = F.col("candidate") - F.col("baseline")
    of = lambda kind, x: F.when(F.col("kind") == kind, x)
    worst = lambda kind: F.when(F.count(of(kind, d)) == F.count(of(kind, F.lit(1))), F.round(F.min(of(kind, d)), 5))
    improves = lambda kind: F.avg(of(kind, F.col("candidate"))) > F.avg(of(kind, F.col("baseline")))
    out = scores.agg(
        improves("dense").alias("dense_mean_improves"),
        improves("sparse").alias("sparse_mean_improves"),
        F.sum(of("sparse", (d > 0).cast("long"))).alias("sparse_wins"),
        worst("dense").alias("worst_dense"),
        worst("sparse").alias("worst_sparse"),
    )
    good = F.col("dense_mean_improves") & F.col("sparse_mean_improves") & (F.col("sparse_wins") >= 3) & (F.least("worst_dense", "worst_sparse") >= -max_fold_loss) & F.col("worst_dense").isNotNull() & F.col("worst_sparse").isNotNull()
    return out.withColumn("promoted", F.coalesce(good, F.lit(False)))


def build(footprint: DataFrame, labels: DataFrame, grid, share: float = 0.2, seed: int = 4242) -> DataFrame:
    """(r, c, cell_id, fold, dense, sparse): quadrant folds of the footprint, all label cells as dense truth, and of
    every fold a seeded `share` of its whole regions as sparse truth."""
    from gridloom.operators.partition import quadrants
    from gridloom.operators.regions import label, thin

    cells = quadrants(footprint.select("r", "c").distinct().withColumn("cell_id", grid.cell_id()))
    own = labels.select("r", "c").distinct().join(cells, ["r", "c"])
    kept = None
    for f in range(4):
        part = own.where(F.col("fold") == f)
        if part.isEmpty():
            continue
        few = thin(label(part, grid), share, seed + f).select("r", "c")
        kept = few if kept is None else kept.union(few)
    dense = own.select("r", "c", F.lit(True).alias("dense"))
    out = cells.join(dense, ["r", "c"], "left")
    out = out.join(kept.withColumn("sparse", F.lit(True)), ["r", "c"], "left") if kept is not None else out.withColumn("sparse", F.lit(None).cast("boolean"))
    return out.select("r", "c", "cell_id", "fold", F.coalesce("dense", F.lit(False)).alias("dense"), F.coalesce("sparse", F.lit(False)).alias("sparse"))


def evaluate(surface: DataFrame, holdout: DataFrame) -> DataFrame:
    """(kind, fold, tp_w, fp_w, n_truth, dti, coverage) of a surface (r, c, p) against dense and sparse truth in one
    plan; under sparse truth the other label cells are known and cost nothing."""
    cells = holdout.join(surface.select("r", "c", "p"), ["r", "c"], "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    kinds = F.array(F.struct(F.lit("dense").alias("kind"), F.col("dense").alias("truth"), F.lit(False).alias("known")), F.struct(F.lit("sparse").alias("kind"), F.col("sparse").alias("truth"), (F.col("dense") & ~F.col("sparse")).alias("known")))
    both = cells.select("r", "c", "fold", "p", F.lit(True).alias("valid"), F.inline(kinds))
    return tversky(both, by=("kind", "fold")).select("kind", "fold", "tp_w", "fp_w", "n_truth", "dti", "coverage")


def report(scores: DataFrame) -> dict:
    """The report that gate() takes, from the eight rows of evaluate()."""
    rows = {(r.kind, r.fold): r.dti for r in scores.collect()}
    out = {}
    for kind in ("dense", "sparse"):
        v = [rows.get((kind, f), 0.0) for f in range(4)]
        out |= {f"mean_{kind}_dti": sum(v) / 4, f"fold_{kind}": v}
    return out
