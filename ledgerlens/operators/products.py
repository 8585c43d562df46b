"""Product analytics: ABC classification and performance tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.exprs import np_round, sum0
from ledgerlens.operators import ranking
from ledgerlens.operators._common import attach, empty, num
from ledgerlens.session import cut_lineage


def abc_classification(df: DataFrame, mapping: dict, checkpoint: bool = True) -> DataFrame:
    """Revenue per product (null product kept), cumulative share in revenue-desc order.

    A <= 80 %, B <= 95 %, else C; a single product above 80 % is therefore B.
    The cumulative sum is the distributed running sum (bucketed on the order key).
    """
    prod, rev = mapping.get("product"), mapping.get("revenue")
    if not prod or not rev:
        return empty(df.sparkSession, "product STRING, revenue DOUBLE, cum_pct DOUBLE, class STRING, revenue_share_pct DOUBLE")
    grouped = df.groupBy(F.col(prod)).agg(sum0(num(df, rev)).alias("revenue"))
    if checkpoint:  # read by the range sampling, the shuffle and the total
        grouped = cut_lineage(grouped)
    total = grouped.agg(F.sum("revenue").alias("_tot")).select(
        F.when(F.coalesce(F.col("_tot"), F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("_tot")).alias("_tot"))
    run = ranking.running_sum(grouped, [("revenue", "desc"), prod], "revenue", "_cum")
    j = attach(run, total)
    cum = F.col("_cum") / F.col("_tot") * 100
    return j.select(F.col(prod), "revenue", cum.alias("cum_pct"),
                    F.when(cum <= 80, "A").when(cum <= 95, "B").otherwise("C").alias("class"),
                    np_round(F.col("revenue") / F.col("_tot") * 100, 2).alias("revenue_share_pct"))


def product_performance(df: DataFrame, mapping: dict) -> DataFrame:
    """Per product revenue / profit / units / distinct orders for the mapped roles."""
    prod = mapping.get("product")
    if not prod:
        return empty(df.sparkSession, "product STRING")
    aggs = []
    if mapping.get("revenue"):
        aggs.append(sum0(num(df, mapping["revenue"])).alias("revenue"))
    if mapping.get("profit"):
        aggs.append(sum0(num(df, mapping["profit"])).alias("profit"))
    if mapping.get("quantity"):
        aggs.append(sum0(num(df, mapping["quantity"])).alias("units_sold"))
    if mapping.get("order_id"):
        aggs.append(F.count_distinct(F.col(mapping["order_id"])).alias("orders"))
    if not aggs:
        aggs.append(F.count(F.col(prod)).alias("rows"))
    out = df.groupBy(F.col(prod)).agg(*aggs)
    sort_col = "revenue" if mapping.get("revenue") else out.columns[-1]
    return out.orderBy(F.desc(sort_col), F.col(prod).asc_nulls_first())


def category_performance(df: DataFrame, mapping: dict) -> DataFrame:
    """Revenue and count of non-null revenue per category."""
    cat, rev = mapping.get("category"), mapping.get("revenue")
    if not cat or not rev:
        return empty(df.sparkSession, "category STRING, revenue DOUBLE, orders BIGINT")
    r = num(df, rev)
    return (df.groupBy(F.col(cat)).agg(sum0(r).alias("revenue"), F.count(r).alias("orders"))
              .orderBy(F.desc("revenue"), F.col(cat).asc_nulls_first()))


def abc_counts(abc: DataFrame) -> DataFrame:
    """Number of products per ABC class."""
    return abc.groupBy("class").agg(F.count("*").alias("products"))
