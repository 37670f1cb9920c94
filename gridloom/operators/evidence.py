"""Tables that compare masks, points and artifacts with a catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.grid import GridSpec
from gridloom.operators.focal import offsets
from gridloom.operators.partition import percentile_rank
from gridloom.operators.regions import distance, thin


def _nearest(mask: DataFrame, to: DataFrame, reach: int) -> DataFrame:
    """Mask cells with d2, the squared distance to the nearest cell of `to`, null beyond reach."""
    near = offsets(to.select("r", "c"), reach, lambda a, b: a * a + b * b <= reach * reach)
    d2 = near.groupBy("r", "c").agg(F.min(F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")).alias("d2"))
    return mask.select("r", "c").distinct().join(d2, ["r", "c"], "left")


def agreement(mask: DataFrame, labels: DataFrame, reach: int = 3) -> DataFrame:
    """A row for each distance 0 to `reach`: how many cells of mask and labels there are, and the share of either that
    lies within the distance of the other (null where it has no cell). Sparse masks meet by displaced cells, so no
    distance field of the rectangle is made."""
    sides = []
    for name, a, b in (("mask", mask, labels), ("labels", labels, mask)):
        within = [F.avg(F.when(F.col("d2") <= k * k, 1.0).otherwise(0.0)).alias(f"w{k}") for k in range(reach + 1)]
        one = _nearest(a, b, reach).agg(F.count("*").alias(f"{name}_cells"), *within)
        rows = F.explode(F.array(*(F.struct(F.lit(k).alias("reach"), F.col(f"w{k}").alias(f"{name}_within")) for k in range(reach + 1))))
        sides.append(one.select(f"{name}_cells", rows.alias("x")).select("x.reach", f"{name}_cells", f"x.{name}_within"))
    return sides[0].join(sides[1], "reach")


def enrichment(positives: DataFrame, features: DataFrame, names: list[str]) -> DataFrame:
    """(artifact, feature, enrichment): mean percentile rank that a feature has, among all cells, at an artifact's
    cells. positives: artifact, cell_id; features: cell_id and the named columns (rows with a null are not ranked)."""
    long = features.select("cell_id", F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names))).alias("x")).select("cell_id", "x.*").where("value is not null")
    ranked = percentile_rank(long, "value", ("feature",)).select("cell_id", "feature", "pct")
    return positives.select("artifact", "cell_id").distinct().join(ranked, "cell_id").groupBy("artifact", "feature").agg(F.avg("pct").alias("enrichment"))


def orphans(points: DataFrame, catalogue: DataFrame, grid: GridSpec, by: str, limits: tuple[float, ...] = (5.0, 10.0)) -> DataFrame:
    """A row for each value of `by`: n points and, for every limit, how many and which share lie farther from the
    catalogue (all, where it is empty; points off the grid do not count)."""
    at = points.join(distance(catalogue, grid), ["r", "c"])
    far = lambda x: F.col("d").isNull() | (F.col("d") > x)
    cols = [c for x in limits for c in (F.count_if(far(x)).alias(f"beyond_{x:g}"), F.avg(far(x).cast("int")).alias(f"share_{x:g}"))]
    return at.groupBy(by).agg(F.count("*").alias("n"), *cols)


def with_distance(points: DataFrame, footprint: DataFrame, catalogue: DataFrame, grid: GridSpec) -> DataFrame:
    """points with inside (in the footprint) and d, the distance to the catalogue; both by cell, points off the grid
    are outside and have none."""
    cell = distance(catalogue, grid).join(footprint.select("r", "c").distinct().withColumn("inside", F.lit(True)), ["r", "c"], "left")
    return points.join(cell, ["r", "c"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def corridors(labelled: DataFrame, lines: DataFrame, limits: dict[str, float], step: float = 108.0) -> DataFrame:
    """A row for each component: cells, length, rounded centroid, the largest value of every line of evidence, and the
    names of the lines that reach their limit and that don't, in the order of limits."""
    names = list(limits)
    own = labelled.select("component", "r", "c").join(lines.select("r", "c", *names), ["r", "c"], "left")
    top = own.groupBy("component").agg(F.count("*").alias("cells"), F.rint(F.avg("r")).cast("int").alias("centroid_r"), F.rint(F.avg("c")).cast("int").alias("centroid_c"), *[F.max(n).alias(n) for n in names])
    met = {n: F.coalesce(F.col(n) >= x, F.lit(False)) for n, x in limits.items()}
    pick = lambda yes: F.filter(F.array(*(F.when(met[n] == F.lit(yes), F.lit(n)) for n in names)), lambda x: x.isNotNull())
    return top.withColumns({"length": F.col("cells") * step, "satisfied": pick(True), "missing": pick(False)}).withColumn("n_satisfied", F.size("satisfied"))


def draws(labelled: DataFrame, share: float, seed: int, n: int) -> DataFrame:
    """(draw, r, c): n samples of whole regions, with seeds from `seed` on."""
    out = None
    for k in range(n):
        one = thin(labelled, share, seed + k).select(F.lit(k).alias("draw"), "r", "c")
        out = one if out is None else out.unionByName(one)
    return out


def draw_scores(surface: DataFrame, labelled: DataFrame, share: float, seed: int, n: int) -> DataFrame:
    """(draw, dti) of a surface (r, c, p) against each of draws(); the other label cells are known and cost nothing."""
    from gridloom.operators.metric import tversky

    each = surface.select("r", "c", "p").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    cells = each.join(labelled.select("r", "c", F.lit(True).alias("label")).distinct(), ["r", "c"], "left").join(draws(labelled, share, seed, n).withColumn("truth", F.lit(True)), ["draw", "r", "c"], "left")
    truth = F.coalesce("truth", F.lit(False))
    cells = cells.select("draw", "r", "c", "p", truth.alias("truth"), F.lit(True).alias("valid"), (F.coalesce("label", F.lit(False)) & ~truth).alias("known"))
    return tversky(cells, by=("draw",)).select("draw", "dti")


def summary(df: DataFrame, value: str, by: str) -> DataFrame:
    """n, min, quartiles and max of the present values, by group."""
    q = F.percentile(value, F.array(*(F.lit(x) for x in (0.25, 0.5, 0.75))))
    return df.where(F.col(value).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.min(value).alias("min"), q.alias("q"), F.max(value).alias("max")).select(by, "n", "min", *[F.col("q")[k].alias(n) for k, n in enumerate(("p25", "median", "p75"))], "max")


def filled(*columns: Column) -> Column:
    """How many of the columns have a value."""
    return sum(x.isNotNull().cast("int") for x in columns)


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, missing, share): present values of every column, in one pass."""
    one = df.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in columns])
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("present")) for c in columns)))
    return one.select("n", rows.alias("x")).select("x.column", "n", (F.col("n") - F.col("x.present")).alias("missing"), (F.col("x.present") / F.nullif("n", F.lit(0))).alias("share"))


def admitted(files: DataFrame, path: str, size: str, ignored: list[str], largest: int, most: int) -> DataFrame:
    """Files whose path holds no ignored token and which are not over the size limit: at most `most`, in path order,
    each with cap_reached (whether there were more)."""
    low = F.lower(path)
    ok = files.where((F.col(size) <= largest) & ~F.array_contains(F.array(*(low.contains(x) for x in ignored)), True))
    top = ok.orderBy(path).limit(most + 1)  # one more tells whether there are more; the windows see only these
    every = Window.partitionBy(F.lit(0))
    numbered = top.withColumns({"cap_reached": F.count("*").over(every) > most, "_k": F.row_number().over(every.orderBy(path))})
    return numbered.where(F.col("_k") <= most).drop("_k")
