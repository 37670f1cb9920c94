"""Typed readers of point tables and registries; schemas are stated, never inferred."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SITES = "layer string, name string, thermalclass string, row int, col int, utm_x double, utm_y double, dist_known_fault_px double, temp_c double, geothermquartz_c double, geothermchalc_c double, geothermcat_c double"
REGISTRY = "entries array<struct<id:string,display_name:string,github_repo:string,repo_path:string,git_blob_sha1:string,bytes:bigint,label:string,site_url:string,lb_score:double,status:string>>"


def read_points(spark: SparkSession, path: str, schema: str = SITES) -> DataFrame:
    """A CSV with a header; empty fields and the text nan are null, a row that doesn't fit fails the read."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "nan").option("mode", "FAILFAST").csv(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """One row for each entry of a JSON registry."""
    return spark.read.schema(REGISTRY).option("multiLine", True).json(path).select(F.inline("entries"))


def json_pages(df: DataFrame, text: str, element: str) -> DataFrame:
    """Rows of `element` (DDL of a struct) from texts that hold JSON arrays or objects one after the other."""
    from gridloom.plans.governance import json_documents

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for pdf in batches:
            docs = [d for t in pdf.t for d in json_documents(t or "")]
            yield pd.DataFrame({"d": [json.dumps(d if isinstance(d, list) else [d]) for d in docs]}, dtype="object")

    pages = df.select(F.col(text).alias("t")).mapInPandas(split, "d string")
    return pages.select(F.inline(F.from_json("d", f"array<struct<{element}>>")))
