"""Files shared by driver and executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def settle(df: DataFrame, tag: str) -> DataFrame:
    """df written below spark.checkpoint.dir (a temporary folder only where the session names none) and read again,
    which ends its lineage."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"file://{tempfile.gettempdir()}/gridloom-shared"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base}/gridloom/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
