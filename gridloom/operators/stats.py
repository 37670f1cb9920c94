"""Multiple testing, calibration, positive-unlabelled risk and tail fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def adjust(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(id, p) with holm and bh adjusted p-values and whether each rejects; ties go by id. The tests are one family
    and are ordered as one."""
    m = tests.count()
    order = Window.orderBy("p", "id")
    ranked = tests.withColumn("rank", F.row_number().over(order))
    holm = F.least(F.lit(1.0), F.max(F.col("p") * (m - F.col("rank") + 1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    bh = F.least(F.lit(1.0), F.min(F.col("p") * m / F.col("rank")).over(order.rowsBetween(0, Window.unboundedFollowing)))
    out = ranked.withColumn("holm", holm).withColumn("bh", bh)
    return out.withColumn("holm_reject", F.col("holm") <= alpha).withColumn("bh_reject", F.col("bh") <= alpha)


def signflip(spark: SparkSession, differences: list[float]) -> DataFrame:
    """Exact one-sided p-value of the mean difference over all 2^n sign patterns (n at most 20)."""
    n = len(differences)
    if not 0 < n <= 20:
        raise ValueError("1 to 20 differences")
    pattern = F.lit(0.0)
    for k, d in enumerate(differences):
        pattern = pattern + F.when(F.shiftright("id", k).bitwiseAND(1) == 1, -d).otherwise(d)
    observed = sum(differences)
    return spark.range(1 << n).select(pattern.alias("s")).agg(F.avg((F.col("s") >= observed - 1e-12).cast("int")).alias("p_value"), F.count("*").alias("patterns"))


def reliability(df: DataFrame, prob: str, outcome: str, bins: int = 10, weight: Column | None = None) -> DataFrame:
    """A row for each bin of [0, 1] (1 belongs to the last): bin, count, weight, mean_pred, rate and gap, null where
    a bin is empty."""
    w = F.lit(1.0) if weight is None else weight
    own = df.select(F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1)).cast("int").alias("bin"), F.col(prob).alias("p"), F.col(outcome).cast("double").alias("y"), w.alias("w"))
    sums = own.groupBy("bin").agg(F.count("*").alias("count"), F.sum("w").alias("weight"), (F.sum(F.col("w") * F.col("p")) / F.sum("w")).alias("mean_pred"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("rate"))
    all_ = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return all_.join(sums, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("weight", F.lit(0.0)).alias("weight"), "mean_pred", "rate", (F.col("mean_pred") - F.col("rate")).alias("gap"))


def brier(df: DataFrame, prob: str, outcome: str, bins: int = 10) -> DataFrame:
    """One row: brier, reliability, resolution, uncertainty, within (what binning loses) and ece. brier equals
    reliability - resolution + uncertainty + within."""
    table = reliability(df, prob, outcome, bins).where("count > 0")
    raw = df.agg(F.avg(F.pow(F.col(prob) - F.col(outcome), 2)).alias("brier"), F.avg(F.col(outcome).cast("double")).alias("base"), F.count("*").alias("n"))
    own = table.crossJoin(F.broadcast(raw))
    return own.groupBy("brier", "base", "n").agg(
        (F.sum(F.col("weight") * F.pow("gap", 2)) / F.first("n")).alias("reliability"),
        (F.sum(F.col("weight") * F.pow(F.col("rate") - F.col("base"), 2)) / F.first("n")).alias("resolution"),
        (F.sum(F.col("weight") * F.abs("gap")) / F.first("n")).alias("ece"),
    ).select("brier", "reliability", "resolution", (F.col("base") * (1 - F.col("base"))).alias("uncertainty"), (F.col("brier") - F.col("reliability") + F.col("resolution") - F.col("base") * (1 - F.col("base"))).alias("within"), "ece")


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0))


def pu_risk(df: DataFrame, margin: str, positive: Column, prior: float, kind: str = "sigmoid") -> DataFrame:
    """One row: risk_pos, risk_neg (unlabelled as negative minus prior x positive as negative), nn_risk, clamped.
    positive marks the labelled rows; the others are unlabelled."""
    g = F.col(margin)
    pos, neg = (1 / (1 + F.exp(g)), 1 / (1 + F.exp(-g))) if kind == "sigmoid" else (softplus(-g), softplus(g))
    sums = df.agg(F.avg(F.when(positive, pos)).alias("pp"), F.avg(F.when(positive, neg)).alias("pn"), F.avg(F.when(~positive, neg)).alias("un"))
    rest = F.col("un") - prior * F.col("pn")
    return sums.select((prior * F.col("pp")).alias("risk_pos"), rest.alias("risk_neg"), (prior * F.col("pp") + F.greatest(rest, F.lit(0.0))).alias("nn_risk"), (rest < 0).alias("clamped"))


def pareto_tail(df: DataFrame, length: str, cutoff: float) -> DataFrame:
    """One row: n tail values at or above the cutoff, alpha (maximum likelihood), and the slope of the log-log
    survival counts (ols_alpha). Counts at distinct lengths are cumulated, so ties are one row."""
    tail = df.where(F.col(length) >= cutoff)
    fit = tail.agg(F.count("*").alias("n"), (F.count("*") / F.sum(F.log(F.col(length) / cutoff))).alias("alpha"))
    each = tail.groupBy(length).agg(F.count("*").alias("k"))
    at_least = each.withColumn("ge", F.sum("k").over(Window.orderBy(F.col(length).desc()).rowsBetween(Window.unboundedPreceding, 0)))
    line = at_least.agg((-F.regr_slope(F.log10("ge"), F.log10(length))).alias("ols_alpha"))
    return fit.crossJoin(line)


def band_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(band, n, missing, min, p25, median, p75, max, mean, std): population deviation, linear quantiles."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(x).alias("band"), F.col(x).cast("double").alias("v")) for x in columns))).alias("x")).select("x.band", F.when(F.isnan("x.v"), None).otherwise(F.col("x.v")).alias("v"))
    q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = long.groupBy("band").agg(F.count("v").alias("n"), F.count_if(F.col("v").isNull()).alias("missing"), F.min("v").alias("min"), q.alias("q"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    return out.select("band", "n", "missing", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p75"), "max", "mean", "std")
