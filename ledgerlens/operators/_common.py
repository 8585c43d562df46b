"""Small shared helpers for operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.exprs import as_number, as_timestamp


def dtypes(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def num(df: DataFrame, c: str) -> Column:
    return as_number(F.col(c), dtypes(df)[c])


def ts(df: DataFrame, c: str) -> Column:
    return as_timestamp(F.col(c), dtypes(df)[c])


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def q(name: str) -> str:
    """Back-quote a column name for SQL expressions."""
    return "`" + name.replace("`", "``") + "`"


AGG_FUNCS = ("sum", "mean", "median", "count", "min", "max", "nunique")


def agg_expr(fn: str, c: Column) -> Column:
    """pandas-named aggregation over a column expression (medians need :func:`ranking.grouped_quantiles`)."""
    if fn == "sum":
        return F.coalesce(F.sum(c), F.lit(0))
    if fn == "mean":
        return F.avg(c)
    if fn == "count":
        return F.count(c)
    if fn == "min":
        return F.min(c)
    if fn == "max":
        return F.max(c)
    if fn in ("nunique",):
        return F.count_distinct(c)
    raise ValueError(f"unknown aggregation {fn!r}")


def attach(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row result (a global aggregate) to every row of ``df``.

    The row travels as one struct-valued scalar subquery: Spark runs it once,
    reuses it wherever it is referenced and inlines the value -- no join, and
    nothing that grows with the data is broadcast.
    """
    names = row.columns
    value = row.select(F.struct(*[F.col(c) for c in names])).scalar()
    return df.withColumn("_attached", value).withColumns(
        {c: F.col("_attached").getField(c) for c in names}).drop("_attached")
