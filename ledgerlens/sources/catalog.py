"""SQL over loaded datasets through temporary views (no copy of the data)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def view_name(name: str) -> str:
    """The words of ``name`` as one identifier."""
    return "_".join(w for w in re.findall(r"[^\W_]+", name.lower())) or "dataset"


def register_dataset(spark: SparkSession, name: str, df: DataFrame, replace: bool = False) -> str:
    """Register ``df`` as a temp view named after ``name``; a clash raises unless ``replace``."""
    v = view_name(name)
    if not replace and spark.catalog.tableExists(v):
        raise ValueError(f"a view named {v!r} already exists")
    df.createOrReplaceTempView(v)
    return v


def run_sql(spark: SparkSession, query: str) -> DataFrame:
    return spark.sql(query)
