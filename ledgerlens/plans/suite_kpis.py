"""Registered KPI / trend / ranking queries (K1-K9) over orders_fact."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import kpis
from ledgerlens.plans.facts import FACT_ROLES, FACT_ROLES_WITH_PROFIT, orders_fact
from ledgerlens.plans.registry import register, rounded, sig, with_fact

FACT_COLS = ["order_id", "customer_id", "order_date", "revenue", "cost", "profit", "quantity",
             "product", "category", "region", "courier", "shipping_mode", "rto",
             "delivery_days", "discount"]

_MONTH_DELTA = """
SELECT CASE WHEN count(*) >= 2 AND min_by(v, m) <> 0
            THEN (max_by(v, m) - min_by(v, m)) / abs(min_by(v, m)) * 100 END AS {alias}
FROM (SELECT date_trunc('month', order_date) AS m, coalesce(sum({col}), 0) AS v
      FROM f WHERE order_date IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 2) t
"""


def _kpi_rows(rows):
    parts = []
    for i, (name, val, delta) in enumerate(rows, start=1):
        parts.append(f"SELECT {i} AS seq, '{name}' AS name, {sig(val)} AS value, "
                     f"{sig(delta or 'NULL')} AS delta_pct FROM a")
    return "\nUNION ALL\n".join(parts)


K1_SQL = with_fact(f"""
, a0 AS (SELECT count(*) AS n_rows, coalesce(sum(revenue), 0) AS rev, coalesce(sum(revenue - cost), 0) AS profit,
               count(DISTINCT order_id) AS orders, count(DISTINCT customer_id) AS customers,
               coalesce(sum(quantity), 0) AS units FROM f)
, d AS ({_MONTH_DELTA.format(alias='d_rev', col='revenue')})
, a AS (SELECT a0.*, d.d_rev,
               CASE WHEN rev <> 0 THEN profit / rev * 100 END AS margin,
               rev / greatest(orders, 1) AS aov, rev / greatest(customers, 1) AS rpc
        FROM a0, d)
{_kpi_rows([("Total Rows", "n_rows", None), ("Total Revenue", "rev", "d_rev"),
            ("Total Profit (est.)", "profit", None), ("Profit Margin % (est.)", "margin", None),
            ("Total Orders", "orders", None), ("Avg Order Value", "aov", None),
            ("Unique Customers", "customers", None), ("Revenue / Customer", "rpc", None),
            ("Units Sold", "units", None)])}
""")


@register("k1_core_kpis", K1_SQL)
def k1_core_kpis(spark, sf_dir):
    return rounded(kpis.compute_core_kpis(orders_fact(spark, sf_dir), FACT_ROLES))


K1P_SQL = with_fact(f"""
, a0 AS (SELECT count(*) AS n_rows, coalesce(sum(revenue), 0) AS rev, coalesce(sum(profit), 0) AS profit,
               count(DISTINCT order_id) AS orders, count(DISTINCT customer_id) AS customers,
               coalesce(sum(quantity), 0) AS units FROM f)
, d1 AS ({_MONTH_DELTA.format(alias='d_rev', col='revenue')})
, d2 AS ({_MONTH_DELTA.format(alias='d_profit', col='profit')})
, a AS (SELECT a0.*, d1.d_rev, d2.d_profit,
               CASE WHEN rev <> 0 THEN profit / rev * 100 END AS margin,
               rev / greatest(orders, 1) AS aov, rev / greatest(customers, 1) AS rpc
        FROM a0, d1, d2)
{_kpi_rows([("Total Rows", "n_rows", None), ("Total Revenue", "rev", "d_rev"),
            ("Total Profit", "profit", "d_profit"), ("Profit Margin %", "margin", None),
            ("Total Orders", "orders", None), ("Avg Order Value", "aov", None),
            ("Unique Customers", "customers", None), ("Revenue / Customer", "rpc", None),
            ("Units Sold", "units", None)])}
""")


@register("k1_core_kpis_with_profit", K1P_SQL)
def k1_core_kpis_with_profit(spark, sf_dir):
    return rounded(kpis.compute_core_kpis(orders_fact(spark, sf_dir), FACT_ROLES_WITH_PROFIT))


@register("k2_period_over_period", with_fact(
    f"SELECT {sig('d_rev')} AS delta_pct FROM (" + _MONTH_DELTA.format(alias="d_rev", col="revenue") + ") t"))
def k2_period_over_period(spark, sf_dir):
    return rounded(kpis.period_over_period(orders_fact(spark, sf_dir), FACT_ROLES))


def _period_sql(unit):
    return with_fact(f"""
SELECT CAST(date_trunc('{unit}', order_date) AS TIMESTAMP) AS period, {sig('coalesce(sum(revenue), 0)')} AS value
FROM f WHERE order_date IS NOT NULL GROUP BY 1 ORDER BY 1""")


def _period_query(freq):
    return lambda spark, sf_dir: rounded(kpis.revenue_by_period(orders_fact(spark, sf_dir), FACT_ROLES, freq))


register("k3_revenue_daily", _period_sql("day"))(_period_query("D"))
register("k3_revenue_weekly", _period_sql("week"))(_period_query("W"))
register("k3_revenue_monthly", _period_sql("month"))(_period_query("M"))


def _top_sql(group, agg_sql, n, desc=True):
    order = "DESC NULLS LAST" if desc else "ASC NULLS LAST"
    return with_fact(f"""
SELECT {group}, {agg_sql} AS revenue FROM f GROUP BY {group}
ORDER BY revenue {order}, {group} ASC NULLS FIRST LIMIT {n}""")


@register("k4_top_n_category", _top_sql("category", sig("coalesce(sum(revenue), 0)"), 10))
def k4_top_n_category(spark, sf_dir):
    return rounded(kpis.top_n(orders_fact(spark, sf_dir), "category", "revenue", n=10))


@register("k4_top_n_region_mean", _top_sql("region", sig("avg(revenue)"), 5))
def k4_top_n_region_mean(spark, sf_dir):
    return rounded(kpis.top_n(orders_fact(spark, sf_dir), "region", "revenue", n=5, agg="mean"))


@register("k4_top_n_customer", _top_sql("customer_id", sig("coalesce(sum(revenue), 0)"), 15))
def k4_top_n_customer(spark, sf_dir):
    return rounded(kpis.top_n(orders_fact(spark, sf_dir), "customer_id", "revenue", n=15))


@register("k5_bottom_n_product", _top_sql("product", sig("coalesce(sum(revenue), 0)"), 10, desc=False))
def k5_bottom_n_product(spark, sf_dir):
    return rounded(kpis.bottom_n(orders_fact(spark, sf_dir), "product", "revenue", n=10))


@register("k6_profit_by_category", with_fact(
    "SELECT category, " + sig("coalesce(sum(profit), 0)") + " AS profit FROM f GROUP BY category"))
def k6_profit_by_category(spark, sf_dir):
    return rounded(kpis.profit_by_category(orders_fact(spark, sf_dir), FACT_ROLES_WITH_PROFIT))


@register("k7_head", with_fact(
    "SELECT * FROM f ORDER BY " + ", ".join(f"{c} ASC NULLS FIRST" for c in FACT_COLS) + " LIMIT 50"))
def k7_head(spark, sf_dir):
    return kpis.head(orders_fact(spark, sf_dir), 50, [F.col(c).asc_nulls_first() for c in FACT_COLS])


@register("k9_quick_cards", with_fact(f"""
SELECT 'Total Revenue' AS label, {sig('coalesce(sum(revenue), 0)')} AS value FROM f
UNION ALL SELECT 'Total Profit', {sig('coalesce(sum(profit), 0)')} FROM f"""))
def k9_quick_cards(spark, sf_dir):
    return rounded(kpis.quick_cards(orders_fact(spark, sf_dir), FACT_ROLES_WITH_PROFIT))
