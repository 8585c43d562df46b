"""Registered customer / product / logistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import customers, kpis, logistics, products
from ledgerlens.plans.facts import (FACT_RETAIL_ROLES, FACT_ROLES, FACT_ROLES_WITH_PROFIT, ORDERS_FACT_SQL,
                                    orders_fact)
from ledgerlens.plans.registry import np_round_sql, register, rounded, sig


def _rfm_ctes(customer_col: str = "customer_id") -> str:
    rank = lambda rn: "CAST(1 + CAST({0} > 1 + 0.25 * (n - 1) AS INTEGER) + CAST({0} > 1 + 0.5 * (n - 1) AS INTEGER) + CAST({0} > 1 + 0.75 * (n - 1) AS INTEGER) AS INTEGER)".format(rn)
    return f"""WITH f AS ({ORDERS_FACT_SQL})
, w AS (SELECT {customer_col} AS customer, order_date AS d, revenue, order_id FROM f
        WHERE order_date IS NOT NULL AND {customer_col} IS NOT NULL)
, s AS (SELECT max(d) + INTERVAL 1 DAY AS snap FROM w)
, b AS (SELECT customer, max(d) AS last_d, count(DISTINCT order_id) AS frequency, coalesce(sum(revenue), 0) AS monetary
        FROM w GROUP BY customer)
, b2 AS (SELECT customer, CAST(floor((epoch(snap) - epoch(last_d)) / 86400) AS BIGINT) AS recency,
                CAST(frequency AS BIGINT) AS frequency, monetary FROM b, s)
, q AS (SELECT quantile_cont(recency, 0.25) AS q1, quantile_cont(recency, 0.5) AS q2, quantile_cont(recency, 0.75) AS q3,
               count(*) AS n FROM b2)
, rk AS (SELECT b2.*, row_number() OVER (ORDER BY frequency, customer) AS rf,
                row_number() OVER (ORDER BY monetary, customer) AS rm FROM b2)
, sc AS (SELECT customer, recency, frequency, monetary,
                CAST(CASE WHEN recency <= q1 THEN 4 WHEN recency <= q2 THEN 3 WHEN recency <= q3 THEN 2 ELSE 1 END AS INTEGER) AS "R",
                {rank('rf')} AS "F", {rank('rm')} AS "M" FROM rk, q)
, rfm AS (SELECT sc.*, CAST("R" + "F" + "M" AS INTEGER) AS rfm_score,
                 CASE WHEN "R" + "F" + "M" >= 10 THEN 'Champions'
                      WHEN "R" >= 3 AND "F" >= 3 THEN 'Loyal Customers'
                      WHEN "R" >= 3 AND "F" < 3 THEN 'Potential Loyalists'
                      WHEN "R" <= 2 AND "F" >= 3 THEN 'At Risk'
                      WHEN "R" <= 2 AND "F" <= 2 AND "M" >= 3 THEN 'Cannot Lose Them'
                      ELSE 'Hibernating' END AS segment FROM sc)
, clv AS (SELECT rfm.*, {sig('monetary')} / CASE WHEN frequency = 0 THEN 1 ELSE frequency END AS avg_order_value FROM rfm)
, clv2 AS (SELECT clv.*, avg_order_value * (frequency / 2.0) * 2.0 AS estimated_clv, recency > 90 AS churn_risk FROM clv)
"""


def _rfm(spark, sf_dir):
    return customers.rfm_analysis(orders_fact(spark, sf_dir), FACT_ROLES)


def _clv(spark, sf_dir):
    # CLV over the displayed (cent-rounded) RFM table, so both engines divide the same numbers
    return customers.churn_risk(customers.customer_lifetime_value(rounded(_rfm(spark, sf_dir))), 90)


@register("r1_rfm_base", _rfm_ctes() + f"SELECT customer, recency, frequency, {sig('monetary')} AS monetary FROM b2")
def r1_rfm_base(spark, sf_dir):
    return rounded(customers.rfm_base(orders_fact(spark, sf_dir), FACT_ROLES))


@register("r2_recency_score", _rfm_ctes() + 'SELECT customer, recency, "R" FROM rfm')
def r2_recency_score(spark, sf_dir):
    return _rfm(spark, sf_dir).select("customer", "recency", "R")


@register("r3_frequency_monetary_scores", _rfm_ctes() + 'SELECT customer, frequency, "F", "M" FROM rfm')
def r3_frequency_monetary_scores(spark, sf_dir):
    return _rfm(spark, sf_dir).select("customer", "frequency", "F", "M")


@register("r4_rfm_segments", _rfm_ctes() + f'SELECT customer, recency, frequency, {sig("monetary")} AS monetary, "R", "F", "M", rfm_score, segment FROM rfm')
def r4_rfm_segments(spark, sf_dir):
    return rounded(_rfm(spark, sf_dir))


@register("r5_customer_lifetime_value", _rfm_ctes() +
          f"SELECT customer, {sig('avg_order_value')} AS avg_order_value, {sig('estimated_clv')} AS estimated_clv FROM clv2")
def r5_customer_lifetime_value(spark, sf_dir):
    return rounded(_clv(spark, sf_dir).select("customer", "avg_order_value", "estimated_clv"))


@register("r6_churn_risk", _rfm_ctes() + "SELECT customer, recency, churn_risk FROM clv2")
def r6_churn_risk(spark, sf_dir):
    return _clv(spark, sf_dir).select("customer", "recency", "churn_risk")


@register("r7_segment_summary", _rfm_ctes() +
          f"SELECT segment, count(customer) AS customers, {sig('coalesce(sum(monetary), 0)')} AS total_value, "
          f"{sig('avg(recency)')} AS avg_recency FROM rfm GROUP BY segment")
def r7_segment_summary(spark, sf_dir):
    return rounded(customers.segment_summary(_rfm(spark, sf_dir)))


@register("r8_customer_counts", _rfm_ctes() +
          "SELECT count(*) AS total_customers, CAST(count_if(segment = 'Champions') AS BIGINT) AS champions, "
          "CAST(count_if(segment = 'At Risk') AS BIGINT) AS at_risk, CAST(count_if(churn_risk) AS BIGINT) AS churn_risk FROM clv2")
def r8_customer_counts(spark, sf_dir):
    return customers.customer_counts(_clv(spark, sf_dir))


@register("r8_top_clv", _rfm_ctes() +
          f"SELECT customer, {sig('estimated_clv')} AS estimated_clv, segment FROM clv2 ORDER BY estimated_clv DESC, customer LIMIT 20")
def r8_top_clv(spark, sf_dir):
    return rounded(customers.top_clv(_clv(spark, sf_dir), 20).select("customer", "estimated_clv", "segment"))


@register("k8_report_rfm_top20", _rfm_ctes() +
          f'SELECT customer, recency, frequency, {sig("monetary")} AS monetary, "R", "F", "M", rfm_score, segment '
          "FROM rfm ORDER BY monetary DESC, customer LIMIT 20")
def k8_report_rfm_top20(spark, sf_dir):
    return rounded(_rfm(spark, sf_dir).orderBy(F.desc("monetary"), "customer").limit(20))


def _abc_sql(col: str, tail: str = "SELECT * FROM abc") -> str:
    return f"""WITH f AS ({ORDERS_FACT_SQL})
, g AS (SELECT {col}, coalesce(sum(revenue), 0) AS revenue FROM f GROUP BY {col})
, t AS (SELECT CASE WHEN coalesce(sum(revenue), 0) = 0 THEN 1.0 ELSE sum(revenue) END AS tot FROM g)
, c AS (SELECT {col}, revenue, sum(revenue) OVER (ORDER BY revenue DESC, {col} ASC NULLS FIRST
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM g)
, abc AS (SELECT {col}, {sig('revenue')} AS revenue, {sig('cum / tot * 100')} AS cum_pct,
                 CASE WHEN cum / tot * 100 <= 80 THEN 'A' WHEN cum / tot * 100 <= 95 THEN 'B' ELSE 'C' END AS class,
                 {sig(np_round_sql('revenue / tot * 100', 2))} AS revenue_share_pct FROM c, t)
{tail}"""


@register("p1_abc_products", _abc_sql("product"))
def p1_abc_products(spark, sf_dir):
    return rounded(products.abc_classification(orders_fact(spark, sf_dir), FACT_ROLES))


@register("p1_abc_customers", _abc_sql("customer_id"))
def p1_abc_customers(spark, sf_dir):
    # the same operator with customers in the product role (1,500 groups at sf0.01)
    return rounded(products.abc_classification(orders_fact(spark, sf_dir), {**FACT_ROLES, "product": "customer_id"}))


@register("p4_abc_class_counts", _abc_sql("product", "SELECT class, count(*) AS products FROM abc GROUP BY class"))
def p4_abc_class_counts(spark, sf_dir):
    return products.abc_counts(products.abc_classification(orders_fact(spark, sf_dir), FACT_ROLES))


@register("k8_report_abc_top20", _abc_sql("product", "SELECT * FROM abc ORDER BY revenue DESC, product LIMIT 20"))
def k8_report_abc_top20(spark, sf_dir):
    abc = products.abc_classification(orders_fact(spark, sf_dir), FACT_ROLES)
    return rounded(abc.orderBy(F.desc("revenue"), "product").limit(20))


@register("p2_product_performance", f"WITH f AS ({ORDERS_FACT_SQL})\n"
          f"SELECT product, {sig('coalesce(sum(revenue), 0)')} AS revenue, {sig('coalesce(sum(profit), 0)')} AS profit, "
          f"{sig('coalesce(sum(quantity), 0)')} AS units_sold, count(DISTINCT order_id) AS orders FROM f GROUP BY product")
def p2_product_performance(spark, sf_dir):
    return rounded(products.product_performance(orders_fact(spark, sf_dir), FACT_ROLES_WITH_PROFIT))


@register("p3_category_performance", f"WITH f AS ({ORDERS_FACT_SQL})\n"
          f"SELECT category, {sig('coalesce(sum(revenue), 0)')} AS revenue, count(revenue) AS orders FROM f GROUP BY category")
def p3_category_performance(spark, sf_dir):
    return rounded(products.category_performance(orders_fact(spark, sf_dir), FACT_ROLES))


_RTO = "coalesce(lower(CAST(rto AS VARCHAR)) IN ('1', 'true', 'yes', 'y'), false)"


@register("l1_courier_performance", f"WITH f AS ({ORDERS_FACT_SQL})\n"
          f"SELECT courier, count(courier) AS orders, {sig('avg(delivery_days)')} AS avg_delivery_days, "
          f"CAST(count_if({_RTO}) AS BIGINT) AS rto_count, {sig('coalesce(sum(revenue), 0)')} AS revenue, "
          f"{sig(np_round_sql(f'count_if({_RTO}) / nullif(count(courier), 0) * 100', 2))} AS rto_rate_pct FROM f GROUP BY courier")
def l1_courier_performance(spark, sf_dir):
    return rounded(logistics.courier_performance(orders_fact(spark, sf_dir), FACT_ROLES, FACT_RETAIL_ROLES))


@register("l2_rto_flag", f"WITH f AS ({ORDERS_FACT_SQL})\nSELECT order_id, product, {_RTO} AS rto_flag FROM f")
def l2_rto_flag(spark, sf_dir):
    f = orders_fact(spark, sf_dir)
    return f.select("order_id", "product", logistics.rto_flag(f, "rto").alias("rto_flag"))


@register("l3_rto_analysis", f"WITH f AS ({ORDERS_FACT_SQL})\n"
          f"SELECT count(*) AS total_orders, CAST(count_if({_RTO}) AS BIGINT) AS rto_orders, "
          f"{sig(np_round_sql(f'avg(CAST({_RTO} AS DOUBLE)) * 100', 2))} AS rto_rate_pct FROM f")
def l3_rto_analysis(spark, sf_dir):
    return rounded(logistics.rto_analysis(orders_fact(spark, sf_dir), FACT_RETAIL_ROLES))


@register("l4_shipping_mode_breakdown", f"WITH f AS ({ORDERS_FACT_SQL})\n"
          f"SELECT shipping_mode, count(shipping_mode) AS orders, {sig('avg(delivery_days)')} AS avg_delivery_days "
          "FROM f GROUP BY shipping_mode")
def l4_shipping_mode_breakdown(spark, sf_dir):
    return rounded(logistics.shipping_mode_breakdown(orders_fact(spark, sf_dir), FACT_RETAIL_ROLES))


@register("l5_delivery_time_distribution", f"WITH f AS ({ORDERS_FACT_SQL})\n"
          "SELECT CAST(delivery_days AS DOUBLE) AS delivery_days FROM f WHERE delivery_days IS NOT NULL")
def l5_delivery_time_distribution(spark, sf_dir):
    return logistics.delivery_time_distribution(orders_fact(spark, sf_dir), FACT_RETAIL_ROLES)
