"""Connected regions of a mask, whole-region sampling, and exact distance to a mask."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.grid import GridSpec
from gridloom.operators.focal import offsets
from gridloom.operators.partition import half_even
from gridloom.session import settle


def label(mask: DataFrame, grid: GridSpec, most: int = 64) -> DataFrame:
    """(r, c, cell_id, component): 8-connected regions, named by their smallest cell_id.

    Horizontal runs are the nodes, so a row of any length is one; runs that touch in the row above are the edges.
    Labels fall to the smallest neighbouring one and then jump along themselves, each round written out, until
    nothing changes."""
    row = Window.partitionBy("r").orderBy("c")
    cells = settle(mask.select("r", "c").distinct().withColumn("g", F.col("c") - F.row_number().over(row)).withColumn("run", F.min(grid.cell_id()).over(Window.partitionBy("r", "g"))).drop("g"), "label-runs")
    touch = offsets(cells, 1, lambda a, b: a == 1).select(F.col("run").alias("a"), "r", "c")
    pairs = touch.join(cells.withColumnRenamed("run", "b"), ["r", "c"]).select("a", "b").distinct()
    edges = settle(pairs.union(pairs.select("b", "a")), "label-edges")
    now = settle(cells.select(F.col("run").alias("node")).distinct().withColumn("label", F.col("node")), "label-0")
    for k in range(most):
        near = edges.join(now, edges.b == now.node).groupBy("a").agg(F.min("label").alias("m"))
        low = now.join(near, now.node == near.a, "left").select("node", F.least("label", F.coalesce("m", "label")).alias("new"), F.col("label").alias("old"))
        up = low.select(F.col("node").alias("at"), F.col("new").alias("up"))
        nxt = settle(low.join(up, low.new == up["at"]).select("node", F.least("new", "up").alias("label"), "old"), f"label-{k + 1}")
        now = nxt.select("node", "label")
        if nxt.where("label <> old").isEmpty():
            break
    else:
        raise RuntimeError(f"regions do not settle in {most} rounds")
    return cells.join(now.withColumnRenamed("node", "run"), "run").select("r", "c", grid.cell_id().alias("cell_id"), F.col("label").alias("component"))


def large_regions(labelled: DataFrame, least: int) -> DataFrame:
    kept = labelled.groupBy("component").count().where(F.col("count") >= least)
    return labelled.join(kept.select("component"), "component", "left_semi")


def thin(labelled: DataFrame, share: float, seed: int) -> DataFrame:
    """Cells of max(1, round(share x regions)) whole regions, chosen by a seeded hash of their name."""
    names = labelled.select("component").distinct()
    k = names.agg(F.greatest(F.lit(1).cast("long"), half_even(F.count("*") * share)).alias("k"))
    ranked = names.withColumn("rank", F.row_number().over(Window.orderBy(F.xxhash64("component", F.lit(seed)), "component")))
    return labelled.join(ranked.crossJoin(F.broadcast(k)).where("rank <= k").select("component"), "component", "left_semi")


def distance(mask: DataFrame, grid: GridSpec) -> DataFrame:
    """(r, c, d) for every cell of the rectangle: Euclidean distance in cells to the nearest mask cell, null where
    the mask is empty. Exact: the distance within each row by windows, then in each column the least of
    (row offset)^2 + (distance in that row)^2, a column at a time and in blocks of rows."""
    spine = grid.spine(mask.sparkSession)
    on = spine.join(mask.select("r", "c", F.lit(True).alias("on")).distinct(), ["r", "c"], "left")
    w = Window.partitionBy("r").orderBy("c")
    before = F.last(F.when(F.col("on"), F.col("c")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(F.when(F.col("on"), F.col("c")), ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = on.select("r", "c", F.least(F.col("c") - before, after - F.col("c")).cast("double").alias("g"))

    def column(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("r")
        r, g2 = pdf.r.to_numpy(), np.where(pdf.g.isna(), np.inf, pdf.g.to_numpy()) ** 2
        best = np.concatenate([((r[a : a + 256, None] - r[None, :]) ** 2 + g2[None, :]).min(axis=1) for a in range(0, len(r), 256)])
        return pd.DataFrame({"r": r, "c": pdf.c, "d2": best})

    near = rows.groupBy("c").applyInPandas(column, "r int, c int, d2 double")
    return near.select("r", "c", F.when(F.col("d2") < float("inf"), F.sqrt("d2")).alias("d"))
