"""Comparison and identity of artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def git_blob_sha1(content: Column) -> Column:
    """Object name that git gives these bytes."""
    raw = content.cast("binary")
    return F.sha1(F.concat(F.concat(F.lit("blob "), F.length(raw).cast("string")).cast("binary"), F.lit(b"\0"), raw))


def pair_overlap(supports: DataFrame, near: float = 0.8, some: float = 0.5) -> DataFrame:
    """(a, b, n_a, n_b, inter, jaccard, a_in_b, b_in_a, verdict) for artifacts a < b that share a cell.

    Artifacts (a bounded registry) meet by cell: each cell's sorted artifacts are gathered once and equal gatherings
    counted before any pair is made, so pairs grow with the distinct gatherings, not with the cells."""
    size = supports.groupBy("artifact").agg(F.count("*").alias("n"))
    sets = supports.groupBy("cell_id").agg(F.array_sort(F.collect_set("artifact")).alias("who")).groupBy("who").agg(F.count("*").alias("cells"))
    pair = sets.select("cells", F.posexplode("who").alias("i", "a"), "who").select("cells", "a", F.explode(F.expr("slice(who, i + 2, size(who))")).alias("b"))
    inter = pair.groupBy("a", "b").agg(F.sum("cells").alias("inter"))
    out = inter.join(size.select(F.col("artifact").alias("a"), F.col("n").alias("n_a")), "a").join(size.select(F.col("artifact").alias("b"), F.col("n").alias("n_b")), "b")
    j = F.col("inter") / (F.col("n_a") + F.col("n_b") - F.col("inter"))
    out = out.withColumn("jaccard", F.round(j, 5)).withColumn("a_in_b", F.round(F.col("inter") / F.col("n_a"), 5)).withColumn("b_in_a", F.round(F.col("inter") / F.col("n_b"), 5))
    return out.withColumn("verdict", verdict(F.col("inter") == F.greatest("n_a", "n_b"), j, near, some))


def verdict(identical: Column, jaccard: Column, near: float = 0.8, some: float = 0.5) -> Column:
    return F.when(identical, "DUPLICATE").when(jaccard >= near, "NEAR_DUPLICATE").when(jaccard >= some, "OVERLAP").otherwise("DISTINCT")


def identical_groups(artifacts: DataFrame, id_col: str, content: Column) -> DataFrame:
    """(digest, copies, first_id) of every content."""
    return artifacts.groupBy(F.sha2(content.cast("binary"), 256).alias("digest")).agg(F.count("*").alias("copies"), F.min(id_col).alias("first_id"))


def mask_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: only_a, only_b, both (cells)."""
    both = a.select("r", "c", F.lit(1).alias("a")).join(b.select("r", "c", F.lit(1).alias("b")), ["r", "c"], "full")
    return both.agg(F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"))


def surface_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row over cells of either surface (missing counts as 0): mae, max_diff, share_changed, jaccard of the
    supports above a half."""
    j = a.select("cell_id", F.col("p").alias("a")).join(b.select("cell_id", F.col("p").alias("b")), "cell_id", "full").select(F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))
    d = F.abs(F.col("a") - F.col("b"))
    on_a, on_b = F.col("a") > 0.5, F.col("b") > 0.5
    union = F.count_if(on_a | on_b)
    return j.agg(F.avg(d).alias("mae"), F.max(d).alias("max_diff"), F.avg((d > 0).cast("int")).alias("share_changed"), F.when(union == 0, 1.0).otherwise(F.count_if(on_a & on_b) / F.greatest(union, F.lit(1))).alias("jaccard"), (union > 0).alias("union_nonempty"))


def describe_surface(cells: DataFrame) -> DataFrame:
    """One row of statistics of a score surface p."""
    p = F.col("p")
    ok = ~F.isnan("p") & p.isNotNull()
    return cells.agg(
        F.count("*").alias("cells"), F.count_if(~ok).alias("missing"), F.count_if(ok & ~p.between(0, 1)).alias("out_of_range"), F.count_if(ok & (p == 0)).alias("zeros"), F.count_if(ok & (p == 1)).alias("ones"),
        F.count_if(ok & (p > 0.5)).alias("above_half"), F.count_distinct(F.when(ok, p)).alias("distinct_values"), F.min(F.when(ok, p)).alias("min"), F.max(F.when(ok, p)).alias("max"), F.sum(F.when(ok, p)).alias("mass"),
    )


def against_history(candidate: DataFrame, history: DataFrame, near: float = 0.8, top: int = 5) -> DataFrame:
    """(artifact, inter, jaccard, verdict) of the `top` artifacts of history (artifact, cell_id) most like the candidate
    (cell_id); an empty candidate is like none. The candidate is one support and history's cells meet it by key."""
    own = candidate.select("cell_id").distinct().withColumn("_in", F.lit(1))
    n = own.agg(F.count("*").alias("n_c"))
    sizes = history.join(own, "cell_id", "left").groupBy("artifact").agg(F.count("*").alias("n_h"), F.coalesce(F.sum("_in"), F.lit(0)).alias("inter"))
    out = sizes.crossJoin(F.broadcast(n))
    union = F.col("n_c") + F.col("n_h") - F.col("inter")
    j = F.col("inter") / F.greatest(union, F.lit(1))
    told = F.when((F.col("inter") == F.col("n_c")) & (F.col("inter") == F.col("n_h")) & (union > 0), "DUPLICATE").when((j >= near) & (union > 0), "NEAR_DUPLICATE").otherwise("DISTINCT")
    return out.select("artifact", "inter", F.round(j, 5).alias("jaccard"), told.alias("verdict")).orderBy(F.desc("jaccard"), "artifact").limit(top)


def lineage(entries: DataFrame) -> DataFrame:
    """(sha, n, repos, first_id) of every blob of a registry (id, repo, sha): which repositories hold it."""
    return entries.groupBy("sha").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("repo")).alias("repos"), F.min("id").alias("first_id"))


def with_representative(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """entries (id, ...) with rep: the representative that groups (id, rep) name, else the id itself."""
    return entries.join(groups.select("id", F.col("rep").alias("_rep")), "id", "left").withColumn("rep", F.coalesce("_rep", "id")).drop("_rep")


def best_scores(ledger: DataFrame) -> DataFrame:
    """(id, best, latest, n) of an append-only ledger (id, score, recorded_utc)."""
    return ledger.groupBy("id").agg(F.max("score").alias("best"), F.max_by("score", "recorded_utc").alias("latest"), F.count("*").alias("n"))
