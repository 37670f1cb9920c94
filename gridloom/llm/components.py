"""Connected components of a graph given by its edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import materialize


#: A node is a hub if it has more than this share of all edge ends, so there are at most 1 / HUB hubs.
HUB = 1 / 256


def _with_least(rows: DataFrame, least: DataFrame, ends: int | None) -> DataFrame:
    """rows (a, b) with m of their a. The rows of hubs stay where they are and meet the hubs, at most 1 / HUB rows, by
    broadcast; all others are joined by a, so that no task gets a hub's rows. Without `ends`, all are joined by a."""
    if ends is None:
        return rows.join(least.select("a", "m"), "a")
    hub = F.col("n") > ends * HUB
    hubs = F.broadcast(least.where(hub).select("a", "m"))
    return rows.join(hubs, "a").unionByName(rows.join(hubs, "a", "left_anti").join(least.where(~hub).select("a", "m"), "a"))


def _large_star(edges: DataFrame, n: int | None) -> DataFrame:
    """Every node links its larger neighbours to its smallest neighbour (itself included)."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    return _with_least(both.where("b > a"), least, n and 2 * n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, n: int | None) -> DataFrame:
    """Every node links its smaller neighbours and itself to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    linked = _with_least(down, least, n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, tag: str = "components", most: int = 60, hubs: bool = True) -> DataFrame:
    """(node, root) for every node of edges (a, b), root being the smallest node that it reaches; roots are nodes too.

    Each round is written to the shared folder, and the rounds end when the edges stay as they are. Edges to itself,
    repeated edges and null ends do no harm (null ends are left out); without edges the result is empty. `hubs` splits
    the rows of hubs off, for larger plans; the result is the same."""
    now = materialize(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    told = None
    for _ in range(most):
        sums = now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if sums == told or not sums[0]:
            break
        told = sums
        n = sums[0] if hubs else None
        now = materialize(_small_star(_large_star(now, n), n).distinct(), tag)
    else:
        raise RuntimeError(f"no end after {most} rounds")
    pairs = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return pairs.union(pairs.select(F.col("root"), F.col("root")).distinct())
