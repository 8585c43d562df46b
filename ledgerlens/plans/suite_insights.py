"""Registered chart aggregates, insights and named questions."""

from __future__ import annotations

from ledgerlens.operators import charts, insights
from ledgerlens.plans.facts import (DIRTY_FACT_SQL, EVENTS_FACT_SQL, FACT_ROLES, FACT_ROLES_WITH_PROFIT,
                                    ORDERS_FACT_SQL, dirty_fact, events_fact, orders_fact)
from ledgerlens.plans.registry import register, rounded, sig
from ledgerlens.plans.suite_quality import _DUPS


def EV(body):
    return f"WITH e AS ({EVENTS_FACT_SQL})\n{body}"


def FF(body):
    return f"WITH f AS ({ORDERS_FACT_SQL})\n{body}"


def D(body):
    return f"WITH d AS ({DIRTY_FACT_SQL})\n{body}"


@register("h1_histogram", EV(f"""
, s AS (SELECT min(revenue) AS mn, max(revenue) AS mx FROM e)
, c AS (SELECT CASE WHEN (mx - mn) / 30 = 0 THEN 0
                    ELSE least(29, CAST(floor((revenue - mn) / ((mx - mn) / 30)) AS INTEGER)) END AS bin,
               count(*) AS count FROM e, s WHERE revenue IS NOT NULL GROUP BY 1)
, sp AS (SELECT CAST(unnest(range(0, 30)) AS INTEGER) AS bin, mn, mx FROM s)
SELECT sp.bin, {sig('mn + (mx - mn) / 30 * sp.bin')} AS lower, {sig('mn + (mx - mn) / 30 * (sp.bin + 1)')} AS upper,
       coalesce(c.count, 0) AS count FROM sp LEFT JOIN c ON sp.bin = c.bin"""))
def h1_histogram(spark, sf_dir):
    return rounded(charts.histogram(events_fact(spark, sf_dir), "revenue", 30))


@register("l5_delivery_histogram", FF(f"""
, s AS (SELECT min(CAST(delivery_days AS DOUBLE)) AS mn, max(CAST(delivery_days AS DOUBLE)) AS mx FROM f)
, c AS (SELECT CASE WHEN (mx - mn) / 20 = 0 THEN 0
                    ELSE least(19, CAST(floor((delivery_days - mn) / ((mx - mn) / 20)) AS INTEGER)) END AS bin,
               count(*) AS count FROM f, s WHERE delivery_days IS NOT NULL GROUP BY 1)
, sp AS (SELECT CAST(unnest(range(0, 20)) AS INTEGER) AS bin, mn, mx FROM s)
SELECT sp.bin, {sig('mn + (mx - mn) / 20 * sp.bin')} AS lower, {sig('mn + (mx - mn) / 20 * (sp.bin + 1)')} AS upper,
       coalesce(c.count, 0) AS count FROM sp LEFT JOIN c ON sp.bin = c.bin"""))
def l5_delivery_histogram(spark, sf_dir):
    return rounded(charts.histogram(orders_fact(spark, sf_dir), "delivery_days", 20))


_BOXQ = """, q AS (SELECT category, quantile_cont(revenue, 0.25) AS q1, quantile_cont(revenue, 0.5) AS median,
                      quantile_cont(revenue, 0.75) AS q3 FROM e WHERE revenue IS NOT NULL GROUP BY category)
, qf AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
"""


@register("h2_box_summary", EV(_BOXQ + f"""
SELECT e.category, {sig('q1')} AS q1, {sig('median')} AS median, {sig('q3')} AS q3,
       {sig('min(revenue) FILTER (WHERE revenue >= lo AND revenue <= hi)')} AS whisker_low,
       {sig('max(revenue) FILTER (WHERE revenue >= lo AND revenue <= hi)')} AS whisker_high,
       CAST(count_if(NOT (revenue >= lo AND revenue <= hi)) AS BIGINT) AS outliers
FROM e JOIN qf ON e.category IS NOT DISTINCT FROM qf.category WHERE revenue IS NOT NULL
GROUP BY e.category, q1, median, q3"""))
def h2_box_summary(spark, sf_dir):
    return rounded(charts.box_summary(events_fact(spark, sf_dir), "revenue", "category"))


@register("h2_box_outliers", EV(_BOXQ + f"""
SELECT e.event_id, e.category, {sig('revenue')} AS revenue FROM e JOIN qf ON e.category IS NOT DISTINCT FROM qf.category
WHERE revenue < lo OR revenue > hi"""))
def h2_box_outliers(spark, sf_dir):
    ev = events_fact(spark, sf_dir).select("event_id", "category", "revenue")
    return rounded(charts.box_outliers(ev, "revenue", "category"))


@register("h3_pie_shares", EV(f"""
, g AS (SELECT category, coalesce(sum(revenue), 0) AS revenue FROM e GROUP BY category)
SELECT category, {sig('revenue')} AS revenue, {sig('revenue / (SELECT sum(revenue) FROM g) * 100', 6)} AS share_pct FROM g"""))
def h3_pie_shares(spark, sf_dir):
    return rounded(charts.pie_shares(events_fact(spark, sf_dir), "category", "revenue"), share_pct=6)


@register("h4_hierarchy", FF(f"""
SELECT region, shipping_mode, {sig('coalesce(sum(revenue), 0)')} AS revenue,
       CAST(2 - (grouping(region) + grouping(shipping_mode)) AS INTEGER) AS level
FROM f GROUP BY ROLLUP (region, shipping_mode)"""))
def h4_hierarchy(spark, sf_dir):
    return rounded(charts.hierarchy(orders_fact(spark, sf_dir), ["region", "shipping_mode"], "revenue"))


@register("h5_waterfall", FF(f"""
, t AS (SELECT category, coalesce(sum(revenue), 0) AS revenue FROM f GROUP BY category
        ORDER BY revenue DESC NULLS LAST, category ASC NULLS FIRST LIMIT 12)
, r AS (SELECT CAST(row_number() OVER (ORDER BY revenue DESC, category) AS INTEGER) AS seq, category, revenue FROM t)
SELECT seq, category, {sig('revenue')} AS value,
       {sig('sum(revenue) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS running,
       CASE WHEN seq = max(seq) OVER () THEN 'total' ELSE 'relative' END AS measure FROM r
UNION ALL SELECT 13, 'Total', {sig('coalesce(sum(revenue), 0)')}, {sig('coalesce(sum(revenue), 0)')}, 'grand_total' FROM f"""))
def h5_waterfall(spark, sf_dir):
    return rounded(charts.waterfall(orders_fact(spark, sf_dir), "category", "revenue", 12))


@register("h7_bar_data", FF(
    f"SELECT region, shipping_mode, {sig('coalesce(sum(revenue), 0)')} AS revenue FROM f GROUP BY region, shipping_mode"))
def h7_bar_data(spark, sf_dir):
    return rounded(charts.chart_data(orders_fact(spark, sf_dir), "region", "revenue", "shipping_mode", agg="sum"))


@register("h7_scatter_data", FF(
    f"SELECT {sig('cost')} AS cost, {sig('revenue')} AS revenue, category, {sig('quantity')} AS quantity FROM f"))
def h7_scatter_data(spark, sf_dir):
    return rounded(charts.chart_data(orders_fact(spark, sf_dir), "cost", "revenue", "category", "quantity"))


# ---------------------------------------------------------------- insights on the defective fact
_MONTHLY = ", m AS (SELECT date_trunc('month', order_date) AS period, coalesce(sum(revenue), 0) AS value FROM d WHERE order_date IS NOT NULL GROUP BY 1)\n"
_I1 = f"""SELECT 1 AS seq, 'momentum' AS kind, CASE WHEN chg >= 0 THEN 'grew' ELSE 'declined' END AS subject, {sig('chg')} AS value,
 printf('%.2f', {sig('prev')}) || ' -> ' || printf('%.2f', {sig('last')}) AS detail
FROM (SELECT min_by(value, period) AS prev, max_by(value, period) AS last, (max_by(value, period) - min_by(value, period)) / abs(CASE WHEN min_by(value, period) = 0 THEN 1.0 ELSE min_by(value, period) END) * 100 AS chg,
             count(*) AS n FROM (SELECT * FROM m ORDER BY period DESC LIMIT 2) x) y WHERE n >= 2"""
_I2 = f"""SELECT 2, 'peak_period', strftime(period, '%b %Y'), {sig('value')}, CAST(NULL AS VARCHAR) FROM (SELECT * FROM m ORDER BY value DESC, period ASC LIMIT 1) x
WHERE (SELECT count(*) FROM m) >= 3"""
_LEAD = "(SELECT category, coalesce(sum(revenue), 0) AS revenue FROM d GROUP BY category ORDER BY revenue DESC NULLS LAST, category ASC NULLS FIRST LIMIT 1)"
_I3 = f"""SELECT 3, 'category_leader', category, {sig('revenue')}, CAST(NULL AS VARCHAR) FROM {_LEAD} x
UNION ALL SELECT 4, 'category_share_pct', category, {sig('CASE WHEN tot <> 0 THEN revenue / tot * 100 ELSE 0 END')}, CAST(NULL AS VARCHAR)
FROM {_LEAD} x, (SELECT coalesce(sum(revenue), 0) AS tot FROM d) t"""


def _top(col, seq, kind):
    return (f"SELECT {seq}, '{kind}', CAST({col} AS VARCHAR), {sig('revenue')}, CAST(NULL AS VARCHAR) FROM (SELECT {col}, coalesce(sum(revenue), 0) AS revenue "
            f"FROM d GROUP BY {col} ORDER BY revenue DESC NULLS LAST, {col} ASC NULLS FIRST LIMIT 1) x")


_I5 = f"""SELECT 7, 'profitability', CASE WHEN mg >= 20 THEN 'healthy' WHEN mg >= 5 THEN 'thin' ELSE 'concerning' END, {sig('mg')}, CAST(NULL AS VARCHAR)
FROM (SELECT coalesce(sum(profit), 0) / greatest(coalesce(sum(revenue), 0), 1) * 100 AS mg FROM d) x"""
_I6 = f"SELECT 8, 'duplicates', 'rows', CAST(duplicate_rows AS DOUBLE), CAST(NULL AS VARCHAR) FROM {_DUPS} x WHERE duplicate_rows > 0"


@register("i1_revenue_momentum", D(_MONTHLY + _I1))
def i1_revenue_momentum(spark, sf_dir):
    return rounded(insights.revenue_momentum(dirty_fact(spark, sf_dir), FACT_ROLES_WITH_PROFIT))


def _named(part: str) -> str:
    return f"SELECT * FROM ({part}) AS x(seq, kind, subject, value, detail)"


@register("i2_peak_period", D(_MONTHLY + _named(_I2)))
def i2_peak_period(spark, sf_dir):
    return rounded(insights.peak_period(dirty_fact(spark, sf_dir), FACT_ROLES_WITH_PROFIT))


@register("i3_category_concentration", D(_named(_I3)))
def i3_category_concentration(spark, sf_dir):
    return rounded(insights.category_concentration(dirty_fact(spark, sf_dir), FACT_ROLES_WITH_PROFIT))


@register("i4_top_region_product", D(_named(_top("region", 5, "top_region") + "\nUNION ALL\n" + _top("product", 6, "top_product"))))
def i4_top_region_product(spark, sf_dir):
    d = dirty_fact(spark, sf_dir)
    sums = insights.summary(d, FACT_ROLES_WITH_PROFIT)
    return rounded(insights.top_entity(d, FACT_ROLES_WITH_PROFIT, "region", 5, sums)
                   .unionByName(insights.top_entity(d, FACT_ROLES_WITH_PROFIT, "product", 6, sums)))


@register("i5_profitability", D(_named(_I5)))
def i5_profitability(spark, sf_dir):
    return rounded(insights.profitability(dirty_fact(spark, sf_dir), FACT_ROLES_WITH_PROFIT))


@register("i6_duplicate_finding", D(_named(_I6)))
def i6_duplicate_finding(spark, sf_dir):
    return rounded(insights.duplicate_finding(dirty_fact(spark, sf_dir)))


@register("i7_all_insights", D(_MONTHLY + "\nUNION ALL\n".join(
    [_I1, _I2, _I3, _top("region", 5, "top_region"), _top("product", 6, "top_product"), _I5, _I6])))
def i7_all_insights(spark, sf_dir):
    return rounded(insights.rule_based_insights(dirty_fact(spark, sf_dir), FACT_ROLES_WITH_PROFIT))


# ---------------------------------------------------------------- named questions
def _n1(intent, sql, **kw):
    def q(spark, sf_dir):
        return rounded(insights.question(dirty_fact(spark, sf_dir), FACT_ROLES_WITH_PROFIT, intent, **kw))
    register(f"n1_{intent}", D(sql))(q)


_n1("total_revenue", f"SELECT {sig('coalesce(sum(revenue), 0)')} AS total_revenue FROM d")
_n1("average_revenue", f"SELECT {sig('avg(revenue)')} AS average_revenue FROM d")
_n1("margin", f"SELECT {sig('r')} AS revenue, {sig('p')} AS profit, {sig('CASE WHEN r <> 0 THEN p / r * 100 ELSE 0 END')} AS margin_pct "
              "FROM (SELECT coalesce(sum(revenue), 0) AS r, coalesce(sum(profit), 0) AS p FROM d) x")
_n1("unique_customers", "SELECT count(DISTINCT customer_id) AS unique_customers FROM d")
_n1("top_n", f"SELECT product, {sig('coalesce(sum(revenue), 0)')} AS revenue FROM d GROUP BY product "
             "ORDER BY coalesce(sum(revenue), 0) DESC NULLS LAST, product ASC NULLS FIRST LIMIT 5")
_n1("trend", f"SELECT CAST(date_trunc('month', order_date) AS TIMESTAMP) AS period, {sig('coalesce(sum(revenue), 0)')} AS value "
             "FROM d WHERE order_date IS NOT NULL GROUP BY 1")
_n1("shape", "SELECT count(*) AS rows, 15 AS columns FROM d")
_n1("missing", "SELECT CAST(" + " + ".join(f"(count(*) - count({c}))" for c in (
    "order_id customer_id order_date revenue cost profit quantity product category region courier shipping_mode rto "
    "delivery_days discount").split()) + " AS BIGINT) AS missing_cells FROM d")
_n1("duplicates", f"SELECT * FROM {_DUPS} x")
_n1("column_total", f"SELECT {sig('coalesce(sum(quantity), 0)')} AS total_quantity FROM d", column="quantity")
