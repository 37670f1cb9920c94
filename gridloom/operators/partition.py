"""Spatial partitions and budgeted emission within them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def quadrants(cells: DataFrame) -> DataFrame:
    """cells with fold 0..3, cut at the truncated median row and column."""
    m = cells.agg(F.floor(F.percentile("r", 0.5)).alias("rm"), F.floor(F.percentile("c", 0.5)).alias("cm"))
    return cells.crossJoin(F.broadcast(m)).withColumn("fold", ((F.col("r") >= F.col("rm")).cast("int") * 2 + (F.col("c") >= F.col("cm")).cast("int"))).drop("rm", "cm")


def oblique_bands(cells: DataFrame) -> DataFrame:
    """cells (with fold) and band 0..4 by quantiles of 0.6 y + 0.4 x, each scaled to the fold's box; band 2 is the
    vault, the others are development blocks fold * 4 + i."""
    box = cells.groupBy("fold").agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    one = lambda x, a, b: (F.col(x) - F.col(a)) / F.greatest(F.col(b) - F.col(a), F.lit(1))
    scored = cells.join(F.broadcast(box), "fold").withColumn("slant", 0.6 * one("r", "r0", "r1") + 0.4 * one("c", "c0", "c1")).drop("r0", "r1", "c0", "c1")
    edges = scored.groupBy("fold").agg(F.percentile("slant", F.array(*map(F.lit, (0.2, 0.4, 0.6, 0.8)))).alias("e"))
    band = F.size(F.filter("e", lambda x: x <= F.col("slant")))
    out = scored.join(F.broadcast(edges), "fold").withColumn("band", band.cast("int"))
    block = F.when(F.col("band") != 2, F.col("fold") * 4 + F.col("band") - (F.col("band") > 2).cast("int"))
    return out.withColumn("is_vault", F.col("band") == 2).withColumn("dev_block", block.cast("int")).drop("e", "slant")


def half_even(x: Column) -> Column:
    """Nearest integer, halves to even."""
    return F.rint(x).cast("long")


def emit(cells: DataFrame, budget: float, by: str = "fold") -> DataFrame:
    """In every fold the round(budget x cells) best cells: ridge cells (score + 1) before others (half the score);
    ties go to the smaller cell_id."""
    boosted = F.when(F.col("ridge"), F.col("p") + 1).otherwise(0.5 * F.col("p"))
    k = cells.groupBy(by).agg(half_even(F.count("*") * budget).alias("k"))
    ranked = cells.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(boosted.desc(), "cell_id")))
    return ranked.join(F.broadcast(k), by).where("rank <= k").drop("k")


def percentile_rank(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(average rank - 0.5) / n from counts of distinct values, so that ties and hot values cost one row."""
    by = list(by)
    n = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    below = F.sum("_n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    ranked = n.select(*by, value, ((F.coalesce(below, F.lit(0)) + (F.col("_n") + 1) / 2 - 0.5) / F.sum("_n").over(w)).alias("pct"))
    return df.join(ranked, [*by, value])


def quantile_map(df: DataFrame, source: str, target: str, by: str, knots: int = 1001) -> DataFrame:
    """source mapped onto target's distribution within each group: linear between `knots` quantiles of both."""
    at = F.array(*(F.lit(k / (knots - 1)) for k in range(knots)))
    q = df.groupBy(by).agg(F.percentile(source, at).alias("_s"), F.percentile(target, at).alias("_t"))
    i = F.least(F.greatest(F.size(F.filter("_s", lambda x: x <= F.col(source))), F.lit(1)), F.lit(knots - 1))
    s0, s1, t0, t1 = (F.element_at(a, i + d) for a, d in (("_s", 0), ("_s", 1), ("_t", 0), ("_t", 1)))
    x = F.least(F.greatest(F.col(source), F.element_at("_s", F.lit(1))), F.element_at("_s", F.lit(knots)))
    mapped = F.when(s1 == s0, t1).otherwise(t0 + (x - s0) / F.nullif(s1 - s0, F.lit(0.0)) * (t1 - t0))
    return df.join(F.broadcast(q), by).withColumn("mapped", mapped).drop("_s", "_t")
