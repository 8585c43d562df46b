"""Fact tables built from the TPC-H-like star schema.

``orders_fact`` denormalises lineitem with its order, customer, nation, part
and supplier.  ``nation`` (25 rows by definition) and up to ``SUPPLIERS``
suppliers are broadcast explicitly; the other joins are left to Catalyst/AQE,
which broadcasts a side only when its measured size is under
``spark.sql.autoBroadcastJoinThreshold`` and otherwise plans a sort-merge join
on the key.  Rows of lineitem are shuffled while they are narrow, twice at most
with that few suppliers: what a row gives alone is computed first, the price
becomes the cost where the part is met, orders meet customers before lineitem,
and names of suppliers and nations come last.  The fact ends up dealt and sorted
by order, so that stored copies are small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.exprs import np_round
from ledgerlens.session import scratch_path

# role -> column of orders_fact (profit is present but deliberately unmapped)
FACT_ROLES = {
    "date": "order_date", "revenue": "revenue", "profit": None, "cost": "cost",
    "quantity": "quantity", "order_id": "order_id", "customer_id": "customer_id",
    "product": "product", "category": "category", "region": "region",
}
FACT_ROLES_WITH_PROFIT = {**FACT_ROLES, "profit": "profit"}
FACT_RETAIL_ROLES = {
    "courier": "courier", "shipping_mode": "shipping_mode", "delivery_days": "delivery_days",
    "rto": "rto", "discount": "discount",
}
EVENTS_ROLES = {
    "date": "date", "revenue": "revenue", "profit": None, "cost": None, "quantity": None,
    "order_id": None, "customer_id": "customer_id", "product": None, "category": "category",
    "region": None,
}

#: Suppliers (key and name, some tens of bytes each) that are sent to every task; with more, lineitem is shuffled for them, too.
SUPPLIERS = 500_000


def cents(expr: str) -> str:
    """Money rounded to cents, binary half-even (same arithmetic as ``np_round(x, 2)``)."""
    return f"(round_even(CAST(({expr}) AS DOUBLE) * CAST(100 AS DOUBLE), 0) / CAST(100 AS DOUBLE))"


# Money columns are kept in cents so that sums are exact up to float noise far
# below half a cent; this makes the Spark/DuckDB comparison independent of the
# order of addition.
ORDERS_FACT_SQL = f"""
SELECT l.l_orderkey AS order_id,
       o.o_custkey AS customer_id,
       o.o_orderdate AS order_date,
       {cents('l.l_extendedprice * (1 - l.l_discount)')} AS revenue,
       {cents('l.l_quantity * p.p_retailprice')} AS cost,
       {cents('l.l_extendedprice * (1 - l.l_discount)')} - {cents('l.l_quantity * p.p_retailprice')} AS profit,
       l.l_quantity AS quantity,
       p.p_name AS product,
       p.p_brand AS category,
       n.n_name AS region,
       s.s_name AS courier,
       o.o_orderpriority AS shipping_mode,
       l.l_returnflag = 'R' AS rto,
       CAST(date_diff('day', CAST(o.o_orderdate AS DATE), CAST(l.l_shipdate AS DATE)) AS INTEGER) AS delivery_days,
       round_even(l.l_discount * CAST(100 AS DOUBLE), 0) AS discount
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN part p ON l.l_partkey = p.p_partkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey
"""

EVENTS_FACT_SQL = """
SELECT event_id, date_trunc('day', ts) AS date, value AS revenue, user_id AS customer_id,
       event_type AS category, ts
FROM events
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def orders_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
        "l_returnflag", "l_shipdate")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    na = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    pa = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_retailprice")
    su = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    lines = li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity",
        np_round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 2).alias("rev"),
        (F.col("l_returnflag") == "R").alias("rto"), F.to_date("l_shipdate").alias("shipped"),
        F.rint(F.col("l_discount") * 100.0).alias("discount"))
    if few := su.count() <= SUPPLIERS:
        su = F.broadcast(su)
    else:
        lines = lines.join(su, lines.l_suppkey == su.s_suppkey)
    priced = lines.join(pa, lines.l_partkey == pa.p_partkey).withColumn(
        "cost", np_round(F.col("l_quantity") * F.col("p_retailprice"), 2)).drop("l_partkey", "p_partkey", "p_retailprice")
    placed = od.join(cu, od.o_custkey == cu.c_custkey)
    j = priced.join(placed, priced.l_orderkey == placed.o_orderkey)
    if few:
        j = j.join(su, j.l_suppkey == su.s_suppkey)
    j = j.join(F.broadcast(na), j.c_nationkey == na.n_nationkey)
    return j.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("order_date"),
        F.col("rev").alias("revenue"),
        "cost",
        (F.col("rev") - F.col("cost")).alias("profit"),
        F.col("l_quantity").alias("quantity"),
        F.col("p_name").alias("product"),
        F.col("p_brand").alias("category"),
        F.col("n_name").alias("region"),
        F.col("s_name").alias("courier"),
        F.col("o_orderpriority").alias("shipping_mode"),
        "rto",
        F.datediff("shipped", F.to_date("o_orderdate")).alias("delivery_days"),
        "discount",
    )


def events_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        "event_id",
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("date"),
        F.col("value").alias("revenue"),
        F.col("user_id").alias("customer_id"),
        F.col("event_type").alias("category"),
        "ts",
    )


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet under the shared checkpoint folder and read it back.

    This cuts the lineage (a lost executor re-reads the table instead of
    recomputing the joins) without ``localCheckpoint``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# A defective copy of orders_fact for the null / duplicate rules: discount is
# missing where it is zero, region where the nation is NATION_0, and urgent
# returned lines were posted twice.
DIRTY_FACT_SQL = f"""
SELECT * FROM (
  SELECT order_id, customer_id, order_date, revenue, cost, profit, quantity, product, category,
         nullif(region, 'NATION_0') AS region, courier, shipping_mode, rto, delivery_days,
         nullif(discount, 0) AS discount
  FROM ({ORDERS_FACT_SQL}) x) b
UNION ALL
SELECT * FROM (
  SELECT order_id, customer_id, order_date, revenue, cost, profit, quantity, product, category,
         nullif(region, 'NATION_0') AS region, courier, shipping_mode, rto, delivery_days,
         nullif(discount, 0) AS discount
  FROM ({ORDERS_FACT_SQL}) x) b2
WHERE shipping_mode = '1-URGENT' AND rto
"""


def dirty_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = orders_fact(spark, sf_dir).withColumns({
        "region": F.nullif(F.col("region"), F.lit("NATION_0")),
        "discount": F.nullif(F.col("discount"), F.lit(0.0)),
    })
    posted = F.when((F.col("shipping_mode") == "1-URGENT") & F.col("rto"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return f.withColumn("_posted", F.explode(posted)).drop("_posted")  # twice from one join


# Static schema of orders_fact (Spark simple type names), used to generate
# per-column oracle SQL.
FACT_SCHEMA = [
    ("order_id", "bigint"), ("customer_id", "bigint"), ("order_date", "timestamp_ntz"),
    ("revenue", "double"), ("cost", "double"), ("profit", "double"), ("quantity", "double"),
    ("product", "string"), ("category", "string"), ("region", "string"), ("courier", "string"),
    ("shipping_mode", "string"), ("rto", "boolean"), ("delivery_days", "int"), ("discount", "double"),
]
FACT_NUMERIC = [c for c, t in FACT_SCHEMA if t in ("bigint", "int", "double", "boolean")]
FACT_TEXT = [c for c, t in FACT_SCHEMA if t == "string"]
FACT_NUMBERS = [c for c, t in FACT_SCHEMA if t in ("bigint", "int", "double")]  # numpy number: no booleans


# Text with whitespace runs, mixed case and pandas null tokens, derived from the
# fact for the text-cleaning rules.
TEXT_FACT_SQL = f"""
SELECT order_id, customer_id, order_date, revenue, quantity,
       '  ' || replace(product, ' ', chr(9) || '  ') || chr(10) AS product,
       lower(courier) || ' ' || product || '-x1y' AS courier,
       CASE WHEN region = 'NATION_1' THEN 'nan' WHEN region = 'NATION_2' THEN 'None'
            WHEN region = 'NATION_3' THEN NULL ELSE region END AS region,
       shipping_mode
FROM ({ORDERS_FACT_SQL}) x
"""


def text_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = orders_fact(spark, sf_dir)
    region = (F.when(F.col("region") == "NATION_1", F.lit("nan"))
               .when(F.col("region") == "NATION_2", F.lit("None"))
               .when(F.col("region") == "NATION_3", F.lit(None).cast("string"))
               .otherwise(F.col("region")))
    return f.select(
        "order_id", "customer_id", "order_date", "revenue", "quantity",
        F.concat(F.lit("  "), F.replace(F.col("product"), F.lit(" "), F.lit("\t  ")), F.lit("\n")).alias("product"),
        F.concat(F.lower("courier"), F.lit(" "), F.col("product"), F.lit("-x1y")).alias("courier"),
        region.alias("region"), "shipping_mode")
