"""Rule-based insights (I1-I7) and named questions (N1) as computed tables.

No prose engine: each insight is a row (seq, kind, subject, value); a caller
phrases it.  Every row is a small aggregate over the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.exprs import np_round, sum0
from ledgerlens.operators import kpis, profiling
from ledgerlens.operators._common import attach, empty, num, q, ts
from ledgerlens.session import cut_lineage

DETAIL = "%.2f -> %.2f"


def summary(df: DataFrame, mapping: dict) -> DataFrame:
    """(dim, key, revenue, profit): sums per month, category, region and product, and over all; one scan, stored."""
    rev, profit = (num(df, mapping[r]) if mapping.get(r) else F.lit(None).cast("double") for r in ("revenue", "profit"))
    keys = {"all": F.lit("")}
    if mapping.get("date"):
        keys["month"] = F.date_trunc("month", ts(df, mapping["date"])).cast("string")
    keys |= {r: F.col(q(mapping[r])).cast("string") for r in ("category", "region", "product") if mapping.get(r)}
    records = [F.struct(F.lit(d).alias("dim"), k.alias("key"), rev.alias("revenue"), profit.alias("profit")) for d, k in keys.items()]
    sums = (df.select(F.explode(F.array(*records)).alias("r")).select("r.*").groupBy("dim", "key")
            .agg(sum0(F.col("revenue")).alias("revenue"), sum0(F.col("profit")).alias("profit")))
    return cut_lineage(sums)


def _row(frame: DataFrame, seq: int, kind: str, subject, value, detail=None) -> DataFrame:
    return frame.select(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), subject.cast("string").alias("subject"),
                        value.cast("double").alias("value"),
                        (F.lit(None) if detail is None else detail).cast("string").alias("detail"))


def _months(s: DataFrame) -> DataFrame:
    return s.where("dim = 'month' AND key IS NOT NULL")


def revenue_momentum(df: DataFrame, mapping: dict, sums: DataFrame | None = None) -> DataFrame:
    """MoM % of the last two months (denominator |prev|, 1 when prev is 0), grew / declined; detail: both values."""
    s = sums if sums is not None else summary(df, mapping)
    a = _months(s).orderBy(F.desc("key")).limit(2).agg(
        F.max_by("revenue", "key").alias("_last"), F.min_by("revenue", "key").alias("_prev"), F.count("*").alias("_n"))
    prev = F.col("_prev")
    change = (F.col("_last") - prev) / F.abs(F.when(prev == 0, F.lit(1.0)).otherwise(prev)) * 100
    out = a.where(F.col("_n") >= 2).withColumn("_chg", change)
    return _row(out, 1, "momentum", F.when(F.col("_chg") >= 0, "grew").otherwise("declined"), F.col("_chg"),
                F.format_string(DETAIL, np_round(prev, 2), np_round(F.col("_last"), 2)))


def peak_period(df: DataFrame, mapping: dict, sums: DataFrame | None = None) -> DataFrame:
    """The month with the most revenue (earliest on ties); needs >= 3 months."""
    s = sums if sums is not None else summary(df, mapping)
    a = _months(s).agg(F.count("*").alias("_n"),
                       F.min_by(F.struct("key", "revenue"), F.struct(-F.col("revenue"), F.col("key"))).alias("_best"))
    return _row(a.where(F.col("_n") >= 3), 2, "peak_period", F.date_format(F.to_timestamp("_best.key"), "MMM yyyy"),
                F.col("_best.revenue"))


def _leader(s: DataFrame, dim: str) -> DataFrame:
    return s.where(F.col("dim") == dim).orderBy(F.desc("revenue"), F.col("key").asc_nulls_first()).limit(1)


def category_concentration(df: DataFrame, mapping: dict, sums: DataFrame | None = None) -> DataFrame:
    """Leading category, its revenue and share of the total (%)."""
    s = sums if sums is not None else summary(df, mapping)
    j = attach(_leader(s, "category"), s.where("dim = 'all'").agg(F.sum("revenue").alias("_tot")))
    share = F.when(F.col("_tot") != 0, F.col("revenue") / F.col("_tot") * 100).otherwise(F.lit(0.0))
    return (_row(j, 3, "category_leader", F.col("key"), F.col("revenue"))
            .unionByName(_row(j, 4, "category_share_pct", F.col("key"), share)))


def top_entity(df: DataFrame, mapping: dict, role: str, seq: int, sums: DataFrame | None = None) -> DataFrame:
    """I4: highest-revenue region / product."""
    s = sums if sums is not None else summary(df, mapping)
    return _row(_leader(s, role), seq, f"top_{role}", F.col("key"), F.col("revenue"))


def profitability(df: DataFrame, mapping: dict, sums: DataFrame | None = None) -> DataFrame:
    """margin = profit / max(revenue, 1) * 100 with a tone."""
    s = sums if sums is not None else summary(df, mapping)
    a = s.where("dim = 'all'").agg(sum0(F.col("profit")).alias("_p"), sum0(F.col("revenue")).alias("_r"))
    m = F.col("_p") / F.greatest(F.col("_r"), F.lit(1.0)) * 100
    tone = F.when(m >= 20, "healthy").when(m >= 5, "thin").otherwise("concerning")
    return _row(a, 7, "profitability", tone, m)


def duplicate_finding(df: DataFrame) -> DataFrame:
    """Duplicate rows, when there are any."""
    d = profiling.duplicate_rows(df)
    return _row(d.where(F.col("duplicate_rows") > 0), 8, "duplicates", F.lit("rows"), F.col("duplicate_rows"))


def rule_based_insights(df: DataFrame, mapping: dict) -> DataFrame:
    """All applicable insights (seq, kind, subject, value, detail) from one summary, or one hint row when none apply."""
    has = lambda *r: all(mapping.get(x) for x in r)
    parts = []
    if has("revenue"):
        s = summary(df, mapping)
        if has("date"):
            parts += [revenue_momentum(df, mapping, s), peak_period(df, mapping, s)]
        if has("category"):
            parts.append(category_concentration(df, mapping, s))
        parts += [top_entity(df, mapping, role, seq, s) for role, seq in (("region", 5), ("product", 6)) if has(role)]
        if has("profit"):
            parts.append(profitability(df, mapping, s))
    parts.append(duplicate_finding(df))
    found = reduce(DataFrame.unionByName, parts)
    none = found.agg(F.count("*").alias("_n")).where(F.col("_n") == 0)
    return found.unionByName(_row(none, 9, "hint", F.lit("map revenue, date, category"), F.lit(None)))


# ---------------------------------------------------------------- N1
QUESTIONS = ("total_revenue", "average_revenue", "margin", "unique_customers", "top_n", "trend", "shape",
             "columns", "missing", "duplicates", "column_total")


def question(df: DataFrame, mapping: dict, intent: str, n: int = 5, column: str | None = None,
             order_by: list | None = None) -> DataFrame:
    """The table behind each named question.

    ``average_revenue`` is the mean revenue per row (not K1's order value);
    ``top_n`` groups by product, else category, else region, else returns the
    first n rows in ``order_by`` order.
    """
    rev, profit, cust = mapping.get("revenue"), mapping.get("profit"), mapping.get("customer_id")
    if intent == "total_revenue" and rev:
        return df.agg(sum0(num(df, rev)).alias("total_revenue"))
    if intent == "average_revenue" and rev:
        return df.agg(F.avg(num(df, rev)).alias("average_revenue"))
    if intent == "margin" and rev and profit:
        a = df.agg(sum0(num(df, rev)).alias("revenue"), sum0(num(df, profit)).alias("profit"))
        return a.withColumn("margin_pct", F.when(F.col("revenue") != 0, F.col("profit") / F.col("revenue") * 100)
                            .otherwise(F.lit(0.0)))
    if intent == "unique_customers" and cust:
        return df.agg(F.count_distinct(F.col(cust)).alias("unique_customers"))
    if intent == "top_n":
        group = mapping.get("product") or mapping.get("category") or mapping.get("region")
        if group and rev:
            return kpis.top_n(df, group, rev, n=n)
        return kpis.head(df, n, order_by or df.columns)
    if intent == "trend" and rev and mapping.get("date"):
        return kpis.revenue_by_period(df, mapping, "M")
    if intent == "shape":
        return df.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(df.columns)))
    if intent == "columns":
        spark = df.sparkSession
        return spark.createDataFrame([(i + 1, c) for i, c in enumerate(df.columns)], "seq INT, column STRING")
    if intent == "missing":
        return profiling.overview(df).select("missing_cells")
    if intent == "duplicates":
        return profiling.duplicate_rows(df)
    if intent == "column_total" and column:
        return df.agg(sum0(num(df, column)).alias(f"total_{column}"))
    return empty(df.sparkSession, "answer STRING")
