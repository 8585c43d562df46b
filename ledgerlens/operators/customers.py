"""Customer analytics: RFM, lifetime value, churn, segment summary.

Plan: groupBy(customer) (one shuffle, map-side combined) -> quartile edges of
recency from one exact ``percentile`` aggregate -> frequency/monetary ranks by
the distributed row number (no single-partition window) -> CASE rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.exprs import sum0
from ledgerlens.operators import ranking
from ledgerlens.operators._common import attach, empty, num, ts
from ledgerlens.session import cut_lineage

RFM_SCHEMA = ("customer STRING, recency BIGINT, frequency BIGINT, monetary DOUBLE, R INT, F INT, M INT, "
              "rfm_score INT, segment STRING")


def rfm_base(df: DataFrame, mapping: dict) -> DataFrame | None:
    """Customer, recency (whole days to max date + 1 day), frequency, monetary."""
    cust, date, rev, order = (mapping.get("customer_id"), mapping.get("date"), mapping.get("revenue"),
                              mapping.get("order_id"))
    if not cust or not date or not rev:
        return None
    work = df.select(F.col(cust).alias("customer"), ts(df, date).alias("_d"), num(df, rev).alias("_rev"),
                     *([F.col(order).alias("_order")] if order else []))
    work = work.where(F.col("_d").isNotNull() & F.col("customer").isNotNull())
    if order:
        # two-level aggregate instead of a grouped count_distinct (no Expand):
        # (customer, order) first, then customer; null orders are not counted
        per_order = work.groupBy("customer", "_order").agg(F.max("_d").alias("_d"), F.sum("_rev").alias("_rev"))
        per = per_order.groupBy("customer").agg(F.max("_d").alias("_last"), F.count("_order").alias("frequency"),
                                                sum0(F.col("_rev")).alias("monetary"))
    else:
        per = work.groupBy("customer").agg(F.max("_d").alias("_last"), F.count("*").alias("frequency"),
                                           sum0(F.col("_rev")).alias("monetary"))
    snap = work.agg((F.max("_d") + F.expr("INTERVAL 1 DAY")).alias("_snap"))
    return (attach(per, snap)
               .select("customer", F.timestamp_diff("DAY", F.col("_last"), F.col("_snap")).alias("recency"),
                       F.col("frequency").cast("long").alias("frequency"), "monetary"))


def _rank_quartile(rn: Column, n: Column) -> Column:
    """qcut of ranks 1..n into 4 right-closed bins with edges 1 + p(n-1)."""
    e = [F.lit(1.0) + F.lit(p) * (n - 1) for p in (0.25, 0.5, 0.75)]
    return (F.lit(1) + (rn > e[0]).cast("int") + (rn > e[1]).cast("int") + (rn > e[2]).cast("int")).cast("int")


def segment_expr(r: Column, f: Column, m: Column, score: Column) -> Column:
    return (F.when(score >= 10, "Champions")
             .when((r >= 3) & (f >= 3), "Loyal Customers")
             .when((r >= 3) & (f < 3), "Potential Loyalists")
             .when((r <= 2) & (f >= 3), "At Risk")
             .when((r <= 2) & (f <= 2) & (m >= 3), "Cannot Lose Them")
             .otherwise("Hibernating"))


def rfm_analysis(df: DataFrame, mapping: dict, checkpoint: bool = True) -> DataFrame:
    """RFM table with quartile scores and segments (unordered; sort by monetary to display).

    The per-customer table is read by two rankings and a quantile aggregate;
    with ``checkpoint`` it is computed once and stored in the checkpoint folder.
    """
    base = rfm_base(df, mapping)
    if base is None:
        return empty(df.sparkSession, RFM_SCHEMA)
    if checkpoint:
        base = cut_lineage(base)
    stats = base.agg(F.percentile("recency", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"),
                     F.count("*").alias("_n"))
    ranked = ranking.row_number(base, ["frequency", "customer"], out="_rf")
    ranked = ranking.row_number(ranked, ["monetary", "customer"], out="_rm")
    j = attach(ranked, stats)
    q = F.col("_q")
    r = (F.when(F.col("recency") <= q[0], 4).when(F.col("recency") <= q[1], 3)
          .when(F.col("recency") <= q[2], 2).otherwise(1)).cast("int")
    out = j.select("customer", "recency", "frequency", "monetary", r.alias("R"),
                   _rank_quartile(F.col("_rf"), F.col("_n")).alias("F"),
                   _rank_quartile(F.col("_rm"), F.col("_n")).alias("M"))
    out = out.withColumn("rfm_score", (F.col("R") + F.col("F") + F.col("M")).cast("int"))
    return out.withColumn("segment", segment_expr(F.col("R"), F.col("F"), F.col("M"), F.col("rfm_score")))


def customer_lifetime_value(rfm: DataFrame, avg_lifespan_years: float = 2.0) -> DataFrame:
    """AOV x annual frequency x lifespan (equals monetary when lifespan >= 1)."""
    aov = F.col("monetary") / F.when(F.col("frequency") == 0, F.lit(1)).otherwise(F.col("frequency"))
    annual = F.col("frequency") / max(1.0, avg_lifespan_years)
    return rfm.withColumn("avg_order_value", aov).withColumn("estimated_clv", F.col("avg_order_value") * annual * avg_lifespan_years)


def churn_risk(rfm: DataFrame, recency_threshold_days: int = 90) -> DataFrame:
    """Flag customers whose last purchase is older than the threshold."""
    return rfm.withColumn("churn_risk", F.col("recency") > recency_threshold_days)


def segment_summary(rfm: DataFrame) -> DataFrame:
    """Customers, total value, mean recency per segment, by total value desc."""
    return (rfm.groupBy("segment").agg(F.count("customer").alias("customers"), sum0(F.col("monetary")).alias("total_value"),
                                       F.avg("recency").alias("avg_recency"))
               .orderBy(F.desc("total_value"), "segment"))


def customer_counts(rfm: DataFrame) -> DataFrame:
    """Total customers, champions, at risk, churn risk (needs churn_risk)."""
    return rfm.agg(F.count("*").alias("total_customers"), F.count_if(F.col("segment") == "Champions").alias("champions"),
                   F.count_if(F.col("segment") == "At Risk").alias("at_risk"),
                   F.count_if(F.col("churn_risk")).alias("churn_risk"))


def top_clv(rfm: DataFrame, n: int = 20) -> DataFrame:
    """Top-n customers by estimated CLV (ties by customer)."""
    return rfm.orderBy(F.desc("estimated_clv"), "customer").limit(n)
