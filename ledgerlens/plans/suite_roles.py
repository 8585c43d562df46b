"""Registered role-detection and coercion queries (M1-M6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens import roles
from ledgerlens.operators import cleaning
from ledgerlens.plans.facts import ORDERS_FACT_SQL, orders_fact, table
from ledgerlens.plans.registry import register, rounded, sig


_MESSY_SQL = """t AS (SELECT o_orderkey AS "Invoice No",
  CASE WHEN o_orderkey % 10 = 0 THEN 'n/a' WHEN o_orderkey % 10 = 1 THEN strftime(o_orderdate, '%d/%m/%Y')
       ELSE strftime(o_orderdate, '%Y-%m-%d') END AS "Order Date",
  CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'open' END AS "Period End",
  strftime(o_orderdate, '%Y/%m/%d') AS "Booked",
  'C' || CAST(o_custkey AS VARCHAR) AS "Client Code", o_totalprice AS "Total Sales", o_totalprice * 2 AS "Ledger Value",
  CAST(o_custkey AS DOUBLE) AS "Weight", o_orderpriority AS "Customer Segment", o_orderstatus AS "Returned",
  CAST(o_custkey % 30 AS DOUBLE) AS "Discount Pct", o_custkey % 9 AS "Transit Time", o_orderpriority AS "Carrier" FROM orders)"""


def messy_orders(spark, sf_dir):
    """Orders with headers as people write them; dates as text, some of them missing or in another format."""
    o = table(spark, sf_dir, "orders")
    day = lambda f: F.date_format("o_orderdate", f)
    k = F.col("o_orderkey")
    return o.select(
        k.alias("Invoice No"),
        F.when(k % 10 == 0, "n/a").when(k % 10 == 1, day("dd/MM/yyyy")).otherwise(day("yyyy-MM-dd")).alias("Order Date"),
        F.when(k % 2 == 0, day("yyyy-MM-dd")).otherwise("open").alias("Period End"), day("yyyy/MM/dd").alias("Booked"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("Client Code"), F.col("o_totalprice").alias("Total Sales"),
        (F.col("o_totalprice") * 2).alias("Ledger Value"), F.col("o_custkey").cast("double").alias("Weight"),
        F.col("o_orderpriority").alias("Customer Segment"), F.col("o_orderstatus").alias("Returned"),
        (F.col("o_custkey") % 30).cast("double").alias("Discount Pct"), (F.col("o_custkey") % 9).alias("Transit Time"),
        F.col("o_orderpriority").alias("Carrier"))


def _mapping_frame(spark, mapping: dict):
    return spark.createDataFrame(list(mapping.items()), "role STRING, column STRING")


def _values(rows, names: str) -> str:
    """Fixed rows as SQL; they hold for any contents of the table on which all dates are set."""
    text = ", ".join("(" + ", ".join("CAST(NULL AS VARCHAR)" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
                                     for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {text}) v({names})"


@register("m1_auto_map", _values([
    ("date", "Order Date"), ("revenue", "Total Sales"), ("profit", None), ("cost", None), ("quantity", None),
    ("order_id", "Invoice No"), ("customer_id", "Client Code"), ("product", None), ("category", "Customer Segment"),
    ("region", None)], "role, \"column\""))
def m1_auto_map(spark, sf_dir):
    """Roles of a table with text dates: half of "Period End" is no date, so it cannot be the date."""
    return _mapping_frame(spark, roles.auto_map(messy_orders(spark, sf_dir)))


@register("m2_scores", _values([
    ("date", "Order Date", 40), ("revenue", "Total Sales", 30), ("order_id", "Invoice No", 30), ("customer_id", "Client Code", 30),
    ("customer_id", "Customer Segment", 26), ("category", "Customer Segment", 16)], "role, \"column\", score"))
def m2_scores(spark, sf_dir):
    scores = roles.score_table(roles.column_facts(messy_orders(spark, sf_dir)), roles.ROLE_PATTERNS)
    return spark.createDataFrame([(r, c, s) for (r, c), s in scores.items()], "role STRING, column STRING, score INT")


_TEXT_COLUMNS = ("Order Date", "Period End", "Booked", "Client Code", "Customer Segment", "Returned", "Carrier")


@register("m3_date_share", f"WITH {_MESSY_SQL}\n" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count("{c}") AS n_values, count(CASE WHEN "{c}" LIKE '____-__-__' OR "{c}" LIKE '__/__/____'
  OR "{c}" LIKE '____/__/__' THEN 1 END) AS dates, count(CASE WHEN "{c}" LIKE '____-__-__' OR "{c}" LIKE '__/__/____'
  OR "{c}" LIKE '____/__/__' THEN 1 END) > 0.8 * count("{c}") AS date_like FROM t""" for c in _TEXT_COLUMNS))
def m3_date_share(spark, sf_dir):
    """How many values of each text column parse as dates, over all rows."""
    facts = [f for f in roles.column_facts(messy_orders(spark, sf_dir)) if f.name in _TEXT_COLUMNS]
    return spark.createDataFrame([(f.name, f.values, f.dates, f.date_like) for f in facts],
                                 "column STRING, n_values BIGINT, dates BIGINT, date_like BOOLEAN")


@register("m4_fallbacks", _values([("date", "Booked"), ("revenue", "Ledger Value")], "role, \"column\""))
def m4_fallbacks(spark, sf_dir):
    """No header names a date or a revenue: the first date-like column and the largest sum of absolute values."""
    t = messy_orders(spark, sf_dir).select("Booked", "Weight", "Ledger Value", "Carrier")
    mapping = roles.auto_map(t)
    return _mapping_frame(spark, {r: mapping[r] for r in ("date", "revenue")})


@register("m5_auto_map_retail", _values([
    ("courier", "Carrier"), ("shipping_mode", None), ("delivery_days", "Transit Time"), ("rto", "Returned"),
    ("discount", "Discount Pct")], "role, \"column\""))
def m5_auto_map_retail(spark, sf_dir):
    t = messy_orders(spark, sf_dir)
    return _mapping_frame(spark, roles.auto_map_retail(t, {c for c in roles.auto_map(t).values() if c}))


_TEXT_SQL = f"""WITH f AS ({ORDERS_FACT_SQL})
, t AS (SELECT order_id, shipping_mode, strftime(order_date, '%Y-%m-%d') AS order_date, CAST(revenue AS VARCHAR) AS revenue,
               CASE WHEN shipping_mode = '5-LOW' THEN 'n/a' ELSE ' ' || CAST(quantity AS VARCHAR) || ' ' END AS quantity FROM f)
SELECT order_id, CAST(TRY_CAST(order_date AS DATE) AS TIMESTAMP) AS order_date, {sig('TRY_CAST(revenue AS DOUBLE)')} AS revenue,
       TRY_CAST(trim(quantity) AS DOUBLE) AS quantity FROM t"""


@register("m6_coerce_types", _TEXT_SQL)
def m6_coerce_types(spark, sf_dir):
    """Text columns coerced by role: dates parsed, numbers cast, junk ('n/a') -> NULL."""
    f = orders_fact(spark, sf_dir)
    t = f.select("order_id", "shipping_mode", F.date_format("order_date", "yyyy-MM-dd").alias("order_date"),
                 F.col("revenue").cast("string").alias("revenue"),
                 F.when(F.col("shipping_mode") == "5-LOW", F.lit("n/a"))
                  .otherwise(F.concat(F.lit(" "), F.col("quantity").cast("string"), F.lit(" "))).alias("quantity"))
    return rounded(roles.coerce_types(t, {"date": "order_date", "revenue": "revenue", "quantity": "quantity"})
                   .drop("shipping_mode"))



@register("m6_coerce_ambiguous", """SELECT o_orderkey, CAST(CASE WHEN day(o_orderdate) <= 12 THEN
    make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) ELSE CAST(o_orderdate AS DATE) END AS TIMESTAMP) AS order_date,
    CASE WHEN o_orderkey % 3 = 1 THEN CAST(o_custkey AS DOUBLE) END AS revenue FROM orders""")
def m6_coerce_ambiguous(spark, sf_dir):
    """Day-first dates: read month first while that is a date; codes with a letter suffix are no numbers."""
    return roles.coerce_types(_ambiguous(spark, sf_dir), {"date": "order_date", "revenue": "revenue"})


def _ambiguous(spark, sf_dir):
    o, k, c = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 3, F.col("o_custkey").cast("string")
    return o.select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("order_date"),
                    F.when(k == 0, F.concat(c, F.lit("D"))).when(k == 1, c).otherwise(F.concat(c, F.lit("f"))).alias("revenue"))


@register("c8_dates_ambiguous", """SELECT o_orderkey, CAST(CASE WHEN day(o_orderdate) <= 12 THEN
    make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) ELSE CAST(o_orderdate AS DATE) END AS TIMESTAMP) AS order_date
    FROM orders""")
def c8_dates_ambiguous(spark, sf_dir):
    return cleaning.standardize_dates(_ambiguous(spark, sf_dir).drop("revenue"), ["order_date"])


@register("c15_convert_suffixed", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN CAST(o_custkey AS DOUBLE) END AS revenue
    FROM orders""")
def c15_convert_suffixed(spark, sf_dir):
    return cleaning.convert_types(_ambiguous(spark, sf_dir).drop("order_date"), "revenue", "numeric")


#: Ways in which people write a date; each names it without doubt.
_FORMS = ("M/d/yyyy", "yyyy/M/d", "d-MMM-yyyy", "MMM d yyyy", "EEE, d MMM yyyy", "MM/dd/yyyy hh:mm:ss a", "dd-MMM-yy", "EEEE, MMMM d, yyyy", "yyyyMMdd",
          "yyyy.M.d HH:mm")


def _as_written(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    text = F.lit(None).cast("string")
    for i, form in enumerate(_FORMS):
        text = F.when(F.col("o_orderkey") % (len(_FORMS) + 1) == i, F.date_format("o_orderdate", form)).otherwise(text)
    return o.select("o_orderkey", F.coalesce(text, F.lit("no date")).alias("order_date"))


@register("c8_dates_as_written", f"SELECT o_orderkey, CASE WHEN o_orderkey % {len(_FORMS) + 1} < {len(_FORMS)} THEN "
          "CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS order_date FROM orders")
def c8_dates_as_written(spark, sf_dir):
    """Ten forms in one column, and texts that are none."""
    return cleaning.standardize_dates(_as_written(spark, sf_dir), ["order_date"])


@register("c8_date_shapes", f"""SELECT 'order_date' AS "column", sum(n)::BIGINT AS rows, sum(CASE WHEN k < {len(_FORMS)} THEN n END)::BIGINT AS parsed FROM
    (SELECT o_orderkey % {len(_FORMS) + 1} AS k, count(*) AS n FROM orders GROUP BY 1)""")
def c8_date_shapes(spark, sf_dir):
    """Counts by shape, added up: every value has a shape, and all but the texts that are no date are read."""
    shapes = cleaning.date_shapes(_as_written(spark, sf_dir), ["order_date"])
    return shapes.groupBy("column").agg(F.sum("rows").alias("rows"), F.sum("parsed").alias("parsed"))


@register("m4_store_codes", _values([("date", "posted"), ("revenue", "ledger")], "role, \"column\""))
def m4_store_codes(spark, sf_dir):
    """Four-digit codes are no dates; the column of written dates behind them is."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 50 + 1000).cast("string").alias("branch"),
                                              F.col("o_totalprice").cast("double").alias("ledger"))
    dated = o.join(_as_written(spark, sf_dir).withColumnRenamed("order_date", "posted"), "o_orderkey").drop("o_orderkey")
    mapping = roles.auto_map(dated.select("branch", "posted", "ledger"))
    return _mapping_frame(spark, {r: mapping[r] for r in ("date", "revenue")})
