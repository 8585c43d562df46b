"""Registered cleaning queries."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ledgerlens.operators import cleaning
from ledgerlens.plans.facts import (DIRTY_FACT_SQL, FACT_SCHEMA, ORDERS_FACT_SQL, TEXT_FACT_SQL, dirty_fact,
                                    orders_fact, text_fact)
from ledgerlens.plans.registry import register, rounded, sig
from ledgerlens.session import stored

COLS = [c for c, _ in FACT_SCHEMA]
TYPES = dict(FACT_SCHEMA)
# a total order over the non-identical rows of the defective fact
ORDER = ["order_id", "product", "customer_id", "order_date", "revenue", "cost", "profit", "quantity", "courier",
         "shipping_mode", "rto", "delivery_days", "category"]


def D(body):
    return f"WITH d AS ({DIRTY_FACT_SQL})\n{body}"


def TX(body):
    return f"WITH t AS ({TEXT_FACT_SQL})\n{body}"


def sel(override: dict | None = None, cols=COLS, types=TYPES) -> str:
    """Select list over the fact columns, doubles rounded to significant digits."""
    override = override or {}
    out = []
    for c in cols:
        e = override.get(c, c)
        out.append(f"{sig(e)} AS {c}" if types.get(c) == "double" else f"{e} AS {c}")
    return ", ".join(out)


_ALL = ", ".join(COLS)


@register("c1_dedupe_all", D(f"SELECT DISTINCT {sel()} FROM d"))
def c1_dedupe_all(spark, sf_dir):
    return rounded(cleaning.remove_duplicates(dirty_fact(spark, sf_dir)))


@register("c1_dedupe_keep_none", D(f"SELECT {sel()} FROM d GROUP BY ALL HAVING count(*) = 1"))
def c1_dedupe_keep_none(spark, sf_dir):
    return rounded(cleaning.remove_duplicates(dirty_fact(spark, sf_dir), keep=False))


def _dedupe_subset_sql(last: bool):
    d = "DESC NULLS LAST" if last else "ASC NULLS FIRST"
    order = ", ".join(f"{c} {d}" for c in ORDER + ["region", "discount"])
    return D(f"SELECT {sel()} FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY {order}) AS rn FROM d) w WHERE rn = 1")


@register("c1_dedupe_subset_first", _dedupe_subset_sql(False))
def c1_dedupe_subset_first(spark, sf_dir):
    return rounded(cleaning.remove_duplicates(dirty_fact(spark, sf_dir), ["customer_id"], "first",
                                              ORDER + ["region", "discount"]))


@register("c1_dedupe_subset_last", _dedupe_subset_sql(True))
def c1_dedupe_subset_last(spark, sf_dir):
    return rounded(cleaning.remove_duplicates(dirty_fact(spark, sf_dir), ["customer_id"], "last",
                                              ORDER + ["region", "discount"]))


@register("c1_dedupe_subset_keep_none", D(
    f"SELECT {sel()} FROM (SELECT *, count(*) OVER (PARTITION BY order_id, product) AS n FROM d) w WHERE n = 1"))
def c1_dedupe_subset_keep_none(spark, sf_dir):
    return rounded(cleaning.remove_duplicates(dirty_fact(spark, sf_dir), ["order_id", "product"], False))


@register("c2_drop_null_rows", D(f"SELECT {sel()} FROM d WHERE region IS NOT NULL AND discount IS NOT NULL"))
def c2_drop_null_rows(spark, sf_dir):
    return rounded(cleaning.handle_missing(dirty_fact(spark, sf_dir), "drop_rows", ["region", "discount"]))


@register("c3_drop_null_columns", D(
    f"SELECT {sel(cols=[c for c in COLS if c not in ('region', 'discount')])} FROM d"))
def c3_drop_null_columns(spark, sf_dir):
    return rounded(cleaning.handle_missing(dirty_fact(spark, sf_dir), "drop_columns"))


def _fill_sql(expr_discount: str, expr_region: str = "region"):
    return D(f"SELECT {sel({'discount': expr_discount, 'region': expr_region})} FROM d")


@register("c4_fill_mean", _fill_sql("coalesce(discount, (SELECT avg(discount) FROM d))"))
def c4_fill_mean(spark, sf_dir):
    return rounded(cleaning.handle_missing(dirty_fact(spark, sf_dir), "mean", ["discount", "region"]))


@register("c4_fill_median", _fill_sql("coalesce(discount, (SELECT median(discount) FROM d))"))
def c4_fill_median(spark, sf_dir):
    return rounded(cleaning.handle_missing(dirty_fact(spark, sf_dir), "median", ["discount", "region"]))


_MODE = "(SELECT {c} FROM d WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} ASC LIMIT 1)"


@register("c5_fill_mode", _fill_sql(f"coalesce(discount, {_MODE.format(c='discount')})",
                                    f"coalesce(region, {_MODE.format(c='region')})"))
def c5_fill_mode(spark, sf_dir):
    return rounded(cleaning.handle_missing(dirty_fact(spark, sf_dir), "mode", ["discount", "region"]))


@register("c6_fill_zero", _fill_sql("coalesce(discount, 0)"))
def c6_fill_zero(spark, sf_dir):
    return rounded(cleaning.handle_missing(dirty_fact(spark, sf_dir), "zero", ["discount", "region"]))


@register("c6_fill_constant", _fill_sql("discount", "coalesce(region, 'UNKNOWN')"))
def c6_fill_constant(spark, sf_dir):
    return rounded(cleaning.handle_missing(dirty_fact(spark, sf_dir), "constant", ["region"], fill_value="UNKNOWN"))


def _ffill_sql(backward: bool, part: str | None):
    d = "DESC NULLS LAST" if backward else "ASC NULLS FIRST"
    order = ", ".join(f"{c} {d}" for c in ORDER)
    p = f"PARTITION BY {part} " if part else ""
    w = f"OVER ({p}ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return D(f"SELECT {sel({'discount': f'last_value(discount IGNORE NULLS) {w}', 'region': f'last_value(region IGNORE NULLS) {w}'})} FROM d")


@register("c7_ffill", _ffill_sql(False, None))
def c7_ffill(spark, sf_dir):
    return rounded(cleaning.handle_missing(dirty_fact(spark, sf_dir), "ffill", ["discount", "region"], order_by=ORDER))


@register("c7_bfill", _ffill_sql(True, None))
def c7_bfill(spark, sf_dir):
    return rounded(cleaning.handle_missing(dirty_fact(spark, sf_dir), "bfill", ["discount", "region"], order_by=ORDER))


@register("c7_ffill_per_customer", _ffill_sql(False, "customer_id"))
def c7_ffill_per_customer(spark, sf_dir):
    return rounded(cleaning.handle_missing(dirty_fact(spark, sf_dir), "ffill", ["discount", "region"], order_by=ORDER,
                                           partition_by=["customer_id"]))


@register("c8_standardize_dates", f"WITH f AS ({ORDERS_FACT_SQL})\n"
          f"SELECT order_id, product, revenue, strftime(order_date, '%d/%m/%Y') AS order_date FROM f")
def c8_standardize_dates(spark, sf_dir):
    f = orders_fact(spark, sf_dir).select("order_id", "product", "revenue", "order_date")
    return cleaning.standardize_dates(f, ["order_date"], output="string", fmt="%d/%m/%Y")


_TXT_COLS = ["order_id", "customer_id", "order_date", "revenue", "quantity", "product", "courier", "region",
             "shipping_mode"]
_TXT_TYPES = {"revenue": "double", "quantity": "double"}


def _py_title(e):
    return (f"array_to_string(list_transform(regexp_extract_all({e}, '(\\p{{L}}+|\\P{{L}}+)'), "
            f"lambda x: upper(x[1:1]) || lower(x[2:])), '')")


def _case_sql(fn):
    def expr(c):
        return f"CASE WHEN {c} IN ('nan', 'None') THEN NULL ELSE {fn(c)} END"
    return TX(f"SELECT {sel({'courier': expr('courier'), 'region': expr('region')}, _TXT_COLS, _TXT_TYPES)} FROM t")


for _mode, _fn in (("title", _py_title), ("upper", lambda c: f"upper({c})"), ("lower", lambda c: f"lower({c})"),
                   ("capitalize", lambda c: f"upper({c}[1:1]) || lower({c}[2:])")):
    def _mk(mode):
        def q(spark, sf_dir):
            return rounded(cleaning.fix_text_case(text_fact(spark, sf_dir), ["courier", "region"], mode))
        return q
    register(f"c9_text_case_{_mode}", _case_sql(_fn))(_mk(_mode))


def _trim(c):
    return f"CASE WHEN trim(regexp_replace({c}, '\\s+', ' ', 'g')) IN ('nan', 'None') THEN NULL ELSE trim(regexp_replace({c}, '\\s+', ' ', 'g')) END"


@register("c10_trim_whitespace", TX(
    f"SELECT {sel({c: _trim(c) for c in ('product', 'courier', 'region', 'shipping_mode')}, _TXT_COLS, _TXT_TYPES)} FROM t"))
def c10_trim_whitespace(spark, sf_dir):
    return rounded(cleaning.trim_whitespace(text_fact(spark, sf_dir)))


def _outlier_sql(method: str, action: str, factor: float):
    cols = ["revenue", "cost"]
    if method == "iqr":
        b = ", ".join(
            f"quantile_cont({c}, 0.25) - {factor} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo_{c}, "
            f"quantile_cont({c}, 0.75) + {factor} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi_{c}"
            for c in cols)
    else:
        b = ", ".join(f"avg({c}) - {factor} * stddev_samp({c}) AS lo_{c}, avg({c}) + {factor} * stddev_samp({c}) AS hi_{c}"
                      for c in cols)
    if action == "clip":
        body = f"SELECT {sel({c: f'least(greatest({c}, lo_{c}), hi_{c})' for c in cols})} FROM d, b"
    else:
        bad = " OR ".join(f"coalesce({c} < lo_{c} OR {c} > hi_{c}, false)" for c in cols)
        body = f"SELECT {sel()} FROM d, b WHERE NOT ({bad})"
    return D(f", b AS (SELECT {b} FROM d)\n{body}")


@register("c11_outliers_iqr_remove", _outlier_sql("iqr", "remove", 1.5))
def c11_outliers_iqr_remove(spark, sf_dir):
    return rounded(cleaning.remove_outliers(dirty_fact(spark, sf_dir), ["revenue", "cost"], "iqr", 1.5, "remove"))


@register("c11_outliers_iqr_clip", _outlier_sql("iqr", "clip", 1.5))
def c11_outliers_iqr_clip(spark, sf_dir):
    return rounded(cleaning.remove_outliers(dirty_fact(spark, sf_dir), ["revenue", "cost"], "iqr", 1.5, "clip"))


@register("c12_outliers_zscore_remove", _outlier_sql("zscore", "remove", 2.0))
def c12_outliers_zscore_remove(spark, sf_dir):
    return rounded(cleaning.remove_outliers(dirty_fact(spark, sf_dir), ["revenue", "cost"], "zscore", 2.0, "remove"))


@register("c13_rename_columns", D(
    f"SELECT {sel().replace(' AS revenue', ' AS sales').replace(' AS region', ' AS market')} FROM d"))
def c13_rename_columns(spark, sf_dir):
    return rounded(cleaning.rename_columns(dirty_fact(spark, sf_dir), {"revenue": "sales", "region": "market",
                                                                       "cost": "", "profit": "profit"}))


_MESSY = {"order_id": "Order ID", "customer_id": "Customer-ID!!", "order_date": "  Order Date ", "revenue": "Revenue (₹)",
          "cost": "__cost__", "profit": "Profit%", "quantity": "QTY", "product": "Product Name", "category": "Category/Brand",
          "region": "Region", "courier": "courier", "shipping_mode": "Shipping  Mode", "rto": "RTO?", "delivery_days": "Delivery Days",
          "discount": "!!!"}


@register("c14_clean_column_names", D("SELECT " + ", ".join(
    (f"{sig(c)}" if TYPES[c] == "double" else c) + " AS " + cleaning.clean_name(_MESSY[c]) for c in COLS) + " FROM d"))
def c14_clean_column_names(spark, sf_dir):
    d = dirty_fact(spark, sf_dir)
    return rounded(cleaning.clean_column_names(d.toDF(*[_MESSY[c] for c in d.columns])))


@register("c15_convert_types", D(
    "SELECT order_id, CAST(delivery_days AS VARCHAR) AS delivery_days, "
    "CASE WHEN discount = floor(discount) THEN CAST(discount AS BIGINT) END AS discount, "
    "rto AS rto, CAST(CAST(order_date AS VARCHAR) AS TIMESTAMP) AS order_date, "
    "TRY_CAST(shipping_mode AS DOUBLE) AS shipping_mode FROM d"))
def c15_convert_types(spark, sf_dir):
    d = dirty_fact(spark, sf_dir).select("order_id", "delivery_days", "discount", "rto",
                                         F.col("order_date").cast("string").alias("order_date"), "shipping_mode")
    d = cleaning.convert_types(d, "delivery_days", "string")
    d = cleaning.convert_types(d, "discount", "integer")
    d = cleaning.convert_types(d, "rto", "boolean")
    d = cleaning.convert_types(d, "order_date", "datetime")
    return cleaning.convert_types(d, "shipping_mode", "numeric")


@register("c16_drop_columns", D(f"SELECT {sel(cols=[c for c in COLS if c not in ('courier', 'rto')])} FROM d"))
def c16_drop_columns(spark, sf_dir):
    return rounded(cleaning.drop_columns(dirty_fact(spark, sf_dir), ["courier", "rto"]))


def _auto_clean_sql(report: bool):
    text = ["product", "category", "region", "courier", "shipping_mode"]
    nums = [c for c, t in FACT_SCHEMA if t in ("bigint", "int", "double")]
    trim = ", ".join(f"{_trim(c)} AS {c}" if c in text else c for c in COLS)
    fill = {}
    for c in nums:
        fill[c] = f"coalesce(CAST({c} AS DOUBLE), (SELECT median(CAST({c} AS DOUBLE)) FROM tr))" if c in ("region",) else \
            (f"coalesce({c}, (SELECT median({c}) FROM tr))" if TYPES[c] == "double" else c)
    for c in text:
        fill[c] = f"coalesce({c}, (SELECT {c} FROM tr WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1))"
    miss = " + ".join(f"(count(*) - count({c}))" for c in COLS)
    body = f"""WITH d AS ({DIRTY_FACT_SQL})
, dd AS (SELECT DISTINCT * FROM d)
, tr AS (SELECT {trim} FROM dd)
, fl AS (SELECT {', '.join(f'{fill.get(c, c)} AS {c}' for c in COLS)} FROM tr)
"""
    if report:
        return body + f"""SELECT (SELECT count(*) FROM d) AS rows_before, (SELECT count(*) FROM d) - (SELECT count(*) FROM tr) AS duplicates_removed,
       CAST((SELECT {miss} FROM tr) - (SELECT {miss} FROM fl) AS BIGINT) AS missing_values_filled, (SELECT count(*) FROM tr) AS rows_after"""
    return body + f"SELECT {sel()} FROM fl"


@register("c17_auto_clean", _auto_clean_sql(False))
def c17_auto_clean(spark, sf_dir):
    return rounded(cleaning.auto_clean(dirty_fact(spark, sf_dir))[0])


@register("c17_auto_clean_report", _auto_clean_sql(True))
def c17_auto_clean_report(spark, sf_dir):
    return cleaning.auto_clean(dirty_fact(spark, sf_dir))[1]


@register("c18_step_message", D(
    "SELECT 'Removed ' || format('{:,}', (SELECT count(*) FROM d) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d) x)) "
    "|| ' duplicate rows.' AS message"))
def c18_step_message(spark, sf_dir):
    d = dirty_fact(spark, sf_dir)
    return cleaning.step_message(d, cleaning.remove_duplicates(d), "Removed {n} duplicate rows.")


@register("c18_step_message_imputed", D(
    "SELECT 'Imputed ' || format('{:,}', count(*) - count(discount) + count(*) - count(region)) || ' cells.' AS message FROM d"))
def c18_step_message_imputed(spark, sf_dir):
    d = dirty_fact(spark, sf_dir)
    filled = cleaning.handle_missing(cleaning.handle_missing(d, "zero", ["discount"]), "constant", ["region"], fill_value="x")
    return cleaning.step_message(d, filled, "Imputed {cells} cells.")


_BOUNDS = """, b AS (SELECT quantile_cont(revenue, 0.25) - 1.5 * (quantile_cont(revenue, 0.75) - quantile_cont(revenue, 0.25)) AS lo,
  quantile_cont(revenue, 0.75) + 1.5 * (quantile_cont(revenue, 0.75) - quantile_cont(revenue, 0.25)) AS hi FROM d)
"""


@register("c18_observed_messages", D(_BOUNDS + """SELECT 1 AS step, 'Clipped ' || format('{:,}', count(*)) || ' cells.' AS message FROM d, b WHERE revenue < lo OR revenue > hi
UNION ALL SELECT 2, 'Removed ' || format('{:,}', count(*)) || ' rows.' FROM d, b WHERE revenue < lo OR revenue > hi
UNION ALL SELECT 3, 'Imputed ' || format('{:,}', count(*) - count(discount)) || ' missing values.' FROM d
UNION ALL SELECT 4, 'Removed ' || format('{:,}', (SELECT count(*) FROM d) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d) x)) || ' duplicates.'"""))
def c18_observed_messages(spark, sf_dir):
    """The fact is stored once; each step runs once over it, and its message is what was observed on the way."""
    d = stored(dirty_fact(spark, sf_dir))
    steps = [(lambda o: cleaning.remove_outliers(d, ["revenue"], "iqr", 1.5, "clip", seen=o, keep=False), "Clipped {cells} cells."),
             (lambda o: cleaning.remove_outliers(d, ["revenue"], "iqr", 1.5, "remove", seen=o, keep=False), "Removed {n} rows."),
             (lambda o: cleaning.handle_missing(d, "mean", ["discount"], seen=o, keep=False), "Imputed {cells} missing values."),
             (lambda o: cleaning.remove_duplicates(d, seen=o), "Removed {n} duplicates.")]
    said = []
    for i, (step, template) in enumerate(steps, start=1):
        seen = Observation()
        step(seen).write.format("noop").mode("overwrite").save()
        said.append((i, cleaning.step_text(seen, template)))
    return spark.createDataFrame(said, "step INT, message STRING")


@register("c4_fill_mean_totals", D("""SELECT region, count(*) AS rows, count(discount) AS given,
    """ + sig("sum(coalesce(discount, (SELECT avg(discount) FROM d)))") + " AS discount FROM d GROUP BY region"))
def c4_fill_mean_totals(spark, sf_dir):
    """The filled column, summed per region: few rows whatever the table's size."""
    d = dirty_fact(spark, sf_dir)
    filled = cleaning.handle_missing(d.withColumn("before", F.col("discount")), "mean", ["discount"])
    return rounded(filled.groupBy("region").agg(F.count("*").alias("rows"), F.count("before").alias("given"), F.sum("discount").alias("discount")))


@register("c12_outliers_zscore_totals", D(""", s AS (SELECT avg(revenue) AS m, stddev_samp(revenue) AS v, avg(cost) AS mc, stddev_samp(cost) AS vc FROM d)
SELECT category, count(*) AS rows, """ + sig("sum(revenue)") + """ AS revenue FROM d, s
WHERE NOT coalesce(abs(revenue - m) > 2 * v, false) AND NOT coalesce(abs(cost - mc) > 2 * vc, false) GROUP BY category"""))
def c12_outliers_zscore_totals(spark, sf_dir):
    kept = cleaning.remove_outliers(dirty_fact(spark, sf_dir), ["revenue", "cost"], "zscore", 2.0, "remove")
    return rounded(kept.groupBy("category").agg(F.count("*").alias("rows"), F.sum("revenue").alias("revenue")))
