"""Artifacts that arrive as files, compared with history as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.forensics import verdict


def compare_with_history(batch: DataFrame, history: DataFrame) -> DataFrame:
    """(artifact, known, inter, jaccard, verdict): each arriving support (artifact, cell_id) against every one of
    history that shares a cell with it."""
    size = lambda df, name: df.groupBy("artifact").agg(F.count("*").alias(name))
    known = history.withColumnRenamed("artifact", "known")
    inter = batch.join(known, "cell_id").groupBy("artifact", "known").agg(F.count("*").alias("inter"))
    out = inter.join(size(batch, "n_a"), "artifact").join(size(history, "n_b").withColumnRenamed("artifact", "known"), "known")
    j = F.col("inter") / (F.col("n_a") + F.col("n_b") - F.col("inter"))
    return out.select("artifact", "known", "inter", F.round(j, 5).alias("jaccard"), verdict(F.col("inter") == F.greatest("n_a", "n_b"), j).alias("verdict"))


def watch(stream: DataFrame, history: DataFrame, sink: str, checkpoint: str):
    """Starts a query that appends the verdicts of every micro-batch to a Parquet folder."""

    def step(batch: DataFrame, _: int) -> None:
        compare_with_history(batch.distinct(), history).write.mode("append").parquet(sink)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
