"""Distance-weighted Tversky index between a score surface and truth cells."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.focal import offsets

REACH = 3.0


def validate(cells: DataFrame) -> None:
    """Raises ValueError for scores inside the mask that are missing or outside [0, 1]."""
    bad = cells.where("valid").agg(F.count_if(F.col("p").isNull() | F.isnan("p") | ~F.col("p").between(0, 1)).alias("n")).first().n
    if bad:
        raise ValueError(f"{bad} scores are not in [0, 1]")


def tversky(cells: DataFrame, alpha: float = 0.2, beta: float = 0.8, reach: float = REACH, mask_predictions: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (one for each value of `by`): tp_w, fp_w, fn_w, n_truth, n_emitted, mass, dti, coverage.

    cells: r, c, p, truth, valid, known. A truth cell is credited the largest p x (1 - d / reach) around it; an emitted
    cell costs p x (1 - the largest such factor of a truth cell), nothing on known or invalid cells. With
    mask_predictions known cells lose both score and truth. Only truth cells are displaced by the kernel (25 rows each
    at reach 3), so the join grows with the truth and not with the grid. `by` columns belong to the join keys: nothing
    is credited across folds."""
    by = list(by)
    p = F.when(F.col("valid"), F.coalesce(F.nanvl("p", F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    truth = F.col("truth") & F.col("valid")
    if mask_predictions:
        p, truth = F.when(F.col("known"), 0.0).otherwise(p), truth & ~F.col("known")
    own = cells.select(*by, "r", "c", p.alias("p"), truth.alias("truth"), F.col("valid"), F.col("known"))
    span = math.ceil(reach) - 1 if float(reach).is_integer() else int(reach)
    kernel = F.greatest(F.lit(0.0), 1 - F.sqrt((F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")).cast("double")) / reach)
    spread = offsets(own.where("truth").select(*by, "r", "c", F.col("r").alias("tr"), F.col("c").alias("tc")), span, lambda a, b: math.hypot(a, b) < reach).withColumn("k", kernel)
    hit = spread.join(own.select(*by, "r", "c", "p"), [*by, "r", "c"], "left")
    credit = hit.groupBy(*by, "tr", "tc").agg(F.max(F.coalesce("p", F.lit(0.0)) * F.col("k")).alias("credit"))
    near = spread.groupBy(*by, "r", "c").agg(F.max("k").alias("k"))
    cost = own.join(near, [*by, "r", "c"], "left").groupBy(*by).agg(
        F.sum(F.when(F.col("known") | ~F.col("valid"), 0.0).otherwise(F.col("p") * (1 - F.coalesce("k", F.lit(0.0))))).alias("fp_w"),
        F.count_if("truth").alias("n_truth"),
        F.count_if(F.col("p") > 0).alias("n_emitted"),
        F.sum("p").alias("mass"),
    )
    gained = credit.groupBy(*by).agg(F.sum("credit").alias("tp_w"))
    both = cost.join(gained, by, "left") if by else cost.crossJoin(gained)  # one row each
    tp = F.coalesce("tp_w", F.lit(0.0))
    fn = F.col("n_truth") - tp
    return both.select(*by, tp.alias("tp_w"), "fp_w", fn.alias("fn_w"), "n_truth", "n_emitted", "mass", F.when(F.col("n_truth") == 0, 0.0).otherwise(tp / (tp + alpha * F.col("fp_w") + beta * fn + 1e-7)).alias("dti"), (tp / F.greatest(F.col("n_truth"), F.lit(1))).alias("coverage"))
