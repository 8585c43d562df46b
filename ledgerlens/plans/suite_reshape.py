"""Registered reshape / join / feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import reshape
from ledgerlens.plans.facts import DIRTY_FACT_SQL, ORDERS_FACT_SQL, dirty_fact, orders_fact, table
from ledgerlens.plans.registry import register, rounded, sig
from ledgerlens.plans.suite_cleaning import ORDER

MODES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def D(body):
    return f"WITH d AS ({DIRTY_FACT_SQL})\n{body}"


def FF(body):
    return f"WITH f AS ({ORDERS_FACT_SQL})\n{body}"


@register("t1_group_aggregate", D(f"""
SELECT region, shipping_mode, {sig('coalesce(sum(revenue), 0)')} AS revenue_sum, {sig('avg(quantity)')} AS quantity_mean,
       count(DISTINCT order_id) AS order_id_nunique, {sig('median(cost)')} AS cost_median,
       {sig('max(discount)')} AS discount_max, count(product) AS product_count, min(order_date) AS order_date_min
FROM d GROUP BY region, shipping_mode"""))
def t1_group_aggregate(spark, sf_dir):
    return rounded(reshape.group_and_aggregate(
        dirty_fact(spark, sf_dir), ["region", "shipping_mode"],
        {"revenue": "sum", "quantity": "mean", "order_id": "nunique", "cost": "median", "discount": "max",
         "product": "count", "order_date": "min"}))


@register("t2_pivot_sum", D("SELECT region, " + ", ".join(
    f"{sig(f'coalesce(sum(revenue) FILTER (WHERE shipping_mode = {chr(39)}{m}{chr(39)}), 0)')} AS \"{m}\"" for m in MODES)
    + " FROM d WHERE region IS NOT NULL AND shipping_mode IS NOT NULL GROUP BY region"))
def t2_pivot_sum(spark, sf_dir):
    return rounded(reshape.pivot(dirty_fact(spark, sf_dir), "region", "shipping_mode", "revenue", "sum"))


@register("t2_pivot_mean", D("SELECT shipping_mode, " + ", ".join(
    f"{sig(f'coalesce(avg(quantity) FILTER (WHERE region = {chr(39)}NATION_{i}{chr(39)}), 0)')} AS \"NATION_{i}\""
    for i in range(1, 25)) + " FROM d WHERE region IS NOT NULL AND shipping_mode IS NOT NULL GROUP BY shipping_mode"))
def t2_pivot_mean(spark, sf_dir):
    return rounded(reshape.pivot(dirty_fact(spark, sf_dir), "shipping_mode", "region", "quantity", "mean"))


# two frames with null keys on both sides and clashing columns
_LEFT_SQL = "SELECT o_orderkey, nullif(o_custkey, 1) AS custkey, o_totalprice AS amount, o_orderstatus AS status FROM orders"
_RIGHT_SQL = ("SELECT nullif(c_custkey, 2) AS custkey, c_name AS name, c_acctbal AS amount, c_mktsegment AS status "
              "FROM customer")


def _join_frames(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    left = o.select("o_orderkey", F.nullif(F.col("o_custkey"), F.lit(1)).alias("custkey"),
                    F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("status"))
    right = c.select(F.nullif(F.col("c_custkey"), F.lit(2)).alias("custkey"), F.col("c_name").alias("name"),
                     F.col("c_acctbal").alias("amount"), F.col("c_mktsegment").alias("status"))
    return left, right


def _join_sql(how: str, key: str):
    return (f"WITH l AS ({_LEFT_SQL}), r AS ({_RIGHT_SQL})\n"
            f"SELECT l.o_orderkey, {key} AS custkey, l.amount AS amount_x, l.status AS status_x, r.name, "
            f"r.amount AS amount_y, r.status AS status_y FROM l {how} JOIN r ON l.custkey IS NOT DISTINCT FROM r.custkey")


for _name, _how, _key in (("j1_merge_inner", "inner", "l.custkey"), ("j2_merge_left", "left", "l.custkey"),
                          ("j3_merge_right", "right", "r.custkey"),
                          ("j4_merge_outer", "outer", "coalesce(l.custkey, r.custkey)")):
    def _mk(how):
        def q(spark, sf_dir):
            left, right = _join_frames(spark, sf_dir)
            return reshape.merge_datasets(left, right, "custkey", how)
        return q
    register(_name, _join_sql({"outer": "FULL OUTER"}.get(_how, _how.upper()), _key))(_mk(_how))


@register("t3_split_column", FF(
    "SELECT order_id, product, revenue, str_split(product, ' ')[1] AS product_1, str_split(product, ' ')[2] AS product_2 FROM f"))
def t3_split_column(spark, sf_dir):
    return reshape.split_column(orders_fact(spark, sf_dir).select("order_id", "product", "revenue"), "product", " ")


@register("t4_date_parts", FF("""
SELECT order_id, order_date, CAST(year(order_date) AS INTEGER) AS order_date_year,
       CAST(month(order_date) AS INTEGER) AS order_date_month, monthname(order_date) AS order_date_month_name,
       CAST(quarter(order_date) AS INTEGER) AS order_date_quarter, dayname(order_date) AS order_date_weekday,
       coalesce(isodow(order_date) IN (6, 7), false) AS order_date_is_weekend FROM f"""))
def t4_date_parts(spark, sf_dir):
    return reshape.add_date_parts(orders_fact(spark, sf_dir).select("order_id", "order_date"), "order_date")


def _bin_sql(labels=None):
    idx = ("CASE WHEN revenue IS NULL THEN NULL WHEN mx = mn THEN 3 ELSE "
           "least(5, greatest(1, CAST(ceil((revenue - mn) / ((mx - mn) / 5)) AS INTEGER))) END")
    out = f"CAST({idx} AS INTEGER)" if not labels else \
        f"([{', '.join(repr(s) for s in labels)}])[{idx}]"
    return FF(f", s AS (SELECT min(revenue) AS mn, max(revenue) AS mx FROM f)\n"
              f"SELECT order_id, {sig('revenue')} AS revenue, {out} AS revenue_bin FROM f, s")


@register("t5_bin_column", _bin_sql())
def t5_bin_column(spark, sf_dir):
    return rounded(reshape.bin_column(orders_fact(spark, sf_dir).select("order_id", "revenue"), "revenue", 5))


_LABELS = ["very low", "low", "mid", "high", "very high"]


@register("t5_bin_column_labels", _bin_sql(_LABELS))
def t5_bin_column_labels(spark, sf_dir):
    return rounded(reshape.bin_column(orders_fact(spark, sf_dir).select("order_id", "revenue"), "revenue", 5, _LABELS))


@register("t6_normalize_minmax", FF(
    ", s AS (SELECT min(revenue) AS a, max(revenue) - min(revenue) AS b FROM f)\n"
    f"SELECT order_id, {sig('revenue')} AS revenue, {sig('(revenue - a) / CASE WHEN b = 0 THEN 1.0 ELSE b END', 6)} AS revenue_norm FROM f, s"))
def t6_normalize_minmax(spark, sf_dir):
    return rounded(reshape.normalize_column(orders_fact(spark, sf_dir).select("order_id", "revenue"), "revenue"), revenue_norm=6)


@register("t6_normalize_zscore", FF(
    ", s AS (SELECT avg(revenue) AS a, stddev_samp(revenue) AS b FROM f)\n"
    f"SELECT order_id, {sig('revenue')} AS revenue, {sig('(revenue - a) / CASE WHEN b = 0 THEN 1.0 ELSE b END', 6)} AS revenue_norm FROM f, s"))
def t6_normalize_zscore(spark, sf_dir):
    return rounded(reshape.normalize_column(orders_fact(spark, sf_dir).select("order_id", "revenue"), "revenue", "zscore"), revenue_norm=6)


@register("t7_calculated_column", FF(
    f"SELECT order_id, {sig('revenue')} AS revenue, {sig('cost')} AS cost, {sig('revenue - cost')} AS margin_value, "
    f"{sig('revenue / quantity')} AS unit_price FROM f"))
def t7_calculated_column(spark, sf_dir):
    f = orders_fact(spark, sf_dir).select("order_id", "revenue", "cost", "quantity")
    f = reshape.create_calculated_column(f, "margin_value", "revenue - cost")
    return rounded(reshape.create_calculated_column(f, "unit_price", "revenue / quantity").drop("quantity"))


@register("t8_one_hot", FF("SELECT order_id, shipping_mode, " + ", ".join(
    f"coalesce(shipping_mode = '{m}', false) AS \"shipping_mode_{m}\"" for m in MODES) + " FROM f"))
def t8_one_hot(spark, sf_dir):
    return reshape.encode_categorical(orders_fact(spark, sf_dir).select("order_id", "shipping_mode"), "shipping_mode")


_ORD = ", ".join(f"{c} ASC NULLS FIRST" for c in ORDER)


@register("t9_label_encode", D(f"""
, r AS (SELECT *, row_number() OVER (ORDER BY {_ORD}) AS rn FROM d)
, c AS (SELECT region AS v, row_number() OVER (ORDER BY min(rn)) - 1 AS code FROM r WHERE region IS NOT NULL GROUP BY region)
SELECT d.order_id, d.region, CAST(coalesce(c.code, -1) AS BIGINT) AS region_encoded FROM d LEFT JOIN c ON d.region = c.v"""))
def t9_label_encode(spark, sf_dir):
    d = dirty_fact(spark, sf_dir)
    return reshape.encode_categorical(d, "region", "label", ORDER).select("order_id", "region", "region_encoded")


@register("t9_label_codes", D(f"""
, r AS (SELECT region, row_number() OVER (ORDER BY {_ORD}) AS rn FROM d)
, c AS (SELECT region, row_number() OVER (ORDER BY min(rn)) - 1 AS code, count(*) AS rows FROM r WHERE region IS NOT NULL GROUP BY region)
SELECT region, CAST(code AS BIGINT) AS region_encoded, rows FROM c UNION ALL SELECT NULL, -1, count(*) FROM d WHERE region IS NULL HAVING count(*) > 0"""))
def t9_label_codes(spark, sf_dir):
    """One row per code: the value it stands for and how often it occurs."""
    coded = reshape.encode_categorical(dirty_fact(spark, sf_dir), "region", "label", ORDER)
    return coded.groupBy("region", "region_encoded").agg(F.count("*").alias("rows"))
