"""Registered source / sink round trips.

Each query writes a driver table with the sink under the shared checkpoint
folder and reads it back with the matching reader, so the whole table goes
through both.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import cleaning, kpis
from ledgerlens.plans.facts import FACT_ROLES_WITH_PROFIT, ORDERS_FACT_SQL, orders_fact, table
from ledgerlens.plans.registry import register, rounded, sig
from ledgerlens.plans.suite_kpis import K1P_SQL
from ledgerlens.session import scratch_path
from ledgerlens.sources import catalog, readers, sinks


#: Rows of a JSON document, and of an archive, that the queries write.
DOCUMENT_ROWS, ARCHIVE_ROWS = 100_000, 100_000


@register("s1_csv_read", "SELECT * FROM orders")
def s1_csv_read(spark, sf_dir):
    """Every column goes through the file; the date comes back as text and is parsed again."""
    path = scratch_path(spark, "orders-csv")
    src = table(spark, sf_dir, "orders")
    sinks.write_csv(src, path, sep=";")
    return _dates_again(readers.read_csv(spark, path, sep=";"), src)


@register("s1_csv_line_breaks", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, replace(o_orderpriority, '-', chr(10) || '\"') AS "
          "o_orderpriority FROM orders")
def s1_csv_line_breaks(spark, sf_dir):
    """Every priority holds a line break and a quote, so no split of the file begins at a known place."""
    path = scratch_path(spark, "orders-breaks-csv")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    sinks.write_csv(o.withColumn("o_orderpriority", F.replace("o_orderpriority", F.lit("-"), F.lit('\n"'))), path)
    kinds = dict(o.dtypes)
    return readers.read_csv(spark, path).select(*[F.col(c).cast(kinds[c]).alias(c) for c in o.columns])


def _dates_again(read, src):
    """Text columns that were dates are parsed, whole-number columns get their width back."""
    kinds = dict(src.dtypes)
    return read.select(*[cleaning.as_timestamp(F.col(c)).cast(kinds[c]).alias(c) if kinds[c].startswith("timestamp")
                         else F.col(c).cast(kinds[c]) for c in src.columns])


@register("w1_csv_write", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment "
          "FROM customer")
def w1_csv_write(spark, sf_dir):
    path = scratch_path(spark, "customer-csv")
    sinks.write_csv(table(spark, sf_dir, "customer"), path)
    return readers.read_csv(spark, path)


@register("w2_json_write", "SELECT * FROM events")
def w2_json_write(spark, sf_dir):
    path = scratch_path(spark, "events-json")
    src = table(spark, sf_dir, "events")
    sinks.write_json(src, path)
    return _dates_again(readers.read_json(spark, path), src)


@register("s4_json_flatten", 'SELECT o_orderkey AS "order.key", o_custkey AS "order.customer", o_orderdate AS "order.date", '
          'o_totalprice AS price, o_orderstatus AS "meta.status", o_orderpriority AS "meta.priority" FROM orders')
def s4_json_flatten(spark, sf_dir):
    path = scratch_path(spark, "orders-nested-json")
    o = table(spark, sf_dir, "orders")
    nested = o.select(F.struct(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("customer"),
                               F.col("o_orderdate").alias("date")).alias("order"),
                      F.col("o_totalprice").alias("price"),
                      F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).alias("meta"))
    sinks.write_json(nested, path)
    kind = dict(o.dtypes)["o_orderdate"]
    return readers.read_json(spark, path).withColumn("order.date", cleaning.as_timestamp(F.col("`order.date`")).cast(kind))


@register("s4_json_documents", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment "
          "FROM customer")
def s4_json_documents(spark, sf_dir):
    """Documents of a nation's customers; the key that holds the rows and its place differ from document to document."""
    path = scratch_path(spark, "customer-documents")
    c = table(spark, sf_dir, "customer")
    parts = 1 + c.count() // DOCUMENT_ROWS  # a nation's share may be the whole table
    docs = (c.groupBy("c_nationkey", F.pmod(F.xxhash64("c_custkey"), F.lit(parts)).alias("part"))
            .agg(F.collect_list(F.struct(*c.columns)).alias("rows")))
    one = F.to_json(F.struct(F.lit(1).alias("meta"), F.col("rows"), F.array(F.lit(0)).alias("spare")))
    other = F.to_json(F.struct(F.col("rows").alias("items"), F.array(F.lit("x")).alias("rows")))
    text = docs.select(F.col("c_nationkey").alias("nation"), "part", F.when(F.col("c_nationkey") % 2 == 0, one).otherwise(other).alias("value"))
    text.write.partitionBy("nation", "part").text(path)
    return readers.read_json(spark, f"{path}/*/*", multi_line=True).select(*c.columns)


@register("s4_json_large_documents", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS DOUBLE) AS l_quantity, l_returnflag, "
          "'a, \"b\" [{' AS note FROM lineitem")
def s4_json_large_documents(spark, sf_dir):
    """The whole table as the lists of a few documents, each of which many tasks read."""
    path = scratch_path(spark, "lineitem-document")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("double").alias("l_quantity"),
                                                 "l_returnflag", F.lit('a, "b" [{').alias("note"))
    sinks.write_json_documents(li, path, "rows")
    kinds = dict(li.dtypes)
    return readers.read_json(spark, path, multi_line=True).select(*[F.col(x).cast(kinds[x]).alias(x) for x in li.columns])


@register("s5_archive_tables", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment "
          "FROM customer")
def s5_archive_tables(spark, sf_dir):
    """The table goes into archives of a bounded number of rows; every archive has a member of the same name."""
    path = scratch_path(spark, "customer-archives")
    c = table(spark, sf_dir, "customer")
    sinks.write_archives(c.repartition(4 + c.count() // ARCHIVE_ROWS, "c_custkey"), path, "customer.csv").collect()
    return readers.archive_table(spark, path, "customer.csv")


@register("s8_sql_over_views", f"WITH orders_fact_2 AS ({ORDERS_FACT_SQL})\n"
          f"SELECT region, count(*) AS lines, {sig('sum(revenue)')} AS revenue FROM orders_fact_2 GROUP BY region")
def s8_sql_over_views(spark, sf_dir):
    spark.catalog.dropTempView(catalog.view_name("Orders Fact (2)"))  # of an earlier run
    view = catalog.register_dataset(spark, "Orders Fact (2)", orders_fact(spark, sf_dir))
    return rounded(catalog.run_sql(spark, f"SELECT region, count(*) AS lines, sum(revenue) AS revenue FROM {view} GROUP BY region"))


_FMT = """CASE WHEN name LIKE '%\\%%' ESCAPE '\\' THEN format('{:,.1f}', value) || '%'
     WHEN name LIKE '%Revenue%' OR name LIKE '%Profit%' OR name LIKE '%Value%' THEN '₹' || format('{:,.0f}', value)
     WHEN value = floor(value) THEN format('{:,.0f}', value) ELSE format('{:,.2f}', value) END"""


@register("w3_kpi_sheet", f"WITH k AS ({K1P_SQL})\nSELECT name AS kpi, {_FMT} AS value, {sig('delta_pct')} AS change_pct "
          "FROM k WHERE value IS NOT NULL")
def w3_kpi_sheet(spark, sf_dir):
    return rounded(sinks.kpi_sheet(rounded(kpis.compute_core_kpis(orders_fact(spark, sf_dir), FACT_ROLES_WITH_PROFIT))))
