"""Aggregates behind charts (H1-H7); rendering is out of scope."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.exprs import as_number, sum0
from ledgerlens.operators import ranking
from ledgerlens.operators._common import attach, dtypes
from ledgerlens.operators.kpis import top_n


def histogram(df: DataFrame, column: str, nbins: int = 30) -> DataFrame:
    """H1: equal-width bins over min..max (last bin closed), empty bins included."""
    x = as_number(F.col(column), dtypes(df)[column])
    stats = df.agg(F.min(x).alias("_mn"), F.max(x).alias("_mx"))
    w = (F.col("_mx") - F.col("_mn")) / nbins
    b = F.when(w == 0, F.lit(0)).otherwise(F.least(F.lit(nbins - 1), F.floor((x - F.col("_mn")) / w).cast("int")))
    counts = (attach(df, stats).where(x.isNotNull())
                .groupBy(b.alias("bin")).agg(F.count("*").alias("count")))
    spine = stats.select("_mn", "_mx", F.explode(F.sequence(F.lit(0), F.lit(nbins - 1))).alias("bin"))
    width = (F.col("_mx") - F.col("_mn")) / nbins
    return (spine.join(counts, "bin", "left")
                 .select("bin", (F.col("_mn") + width * F.col("bin")).alias("lower"),
                         (F.col("_mn") + width * (F.col("bin") + 1)).alias("upper"),
                         F.coalesce(F.col("count"), F.lit(0)).alias("count")))


def box_summary(df: DataFrame, y: str, x: str | None = None, factor: float = 1.5) -> DataFrame:
    """H2: quartiles, whiskers (furthest points inside the fences) and outlier count per group."""
    v = as_number(F.col(y), dtypes(df)[y])
    keys = [F.col(x)] if x else []
    work = df.select(*keys, v.alias("_v")).where(F.col("_v").isNotNull())
    q = ranking.grouped_quantiles(work, [x] if x else [], "_v", [0.25, 0.5, 0.75])
    q = q.select(*keys, F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    q = q.withColumn("_lo", F.col("q1") - factor * (F.col("q3") - F.col("q1"))).withColumn(
        "_hi", F.col("q3") + factor * (F.col("q3") - F.col("q1")))
    # null-safe: a null category is a group of its own, as with groupBy
    j = (work.join(q.withColumnRenamed(x, "_qk"), F.col(x).eqNullSafe(F.col("_qk")), "left").drop("_qk")
         if x else attach(work, q))
    inside = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
    return j.groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"))


def box_outliers(df: DataFrame, y: str, x: str | None = None, factor: float = 1.5) -> DataFrame:
    """H2: the outlier points themselves (rows outside the fences of their group)."""
    v = as_number(F.col(y), dtypes(df)[y])
    keys = [x] if x else []
    q = ranking.grouped_quantiles(df.select(*keys, v.alias("_v")), keys, "_v", [0.25, 0.75])
    q = q.select(*keys, F.array("q0", "q1").alias("_q"))
    lo = F.col("_q")[0] - factor * (F.col("_q")[1] - F.col("_q")[0])
    hi = F.col("_q")[1] + factor * (F.col("_q")[1] - F.col("_q")[0])
    j = (df.join(q.withColumnRenamed(x, "_qk"), F.col(x).eqNullSafe(F.col("_qk")), "left").drop("_qk")
         if keys else attach(df, q))
    return j.where((v < lo) | (v > hi)).drop("_q")


def pie_shares(df: DataFrame, names: str, values: str) -> DataFrame:
    """H3: sum per category and its share of the total (%)."""
    v = as_number(F.col(values), dtypes(df)[values])
    g = df.groupBy(F.col(names)).agg(sum0(v).alias(values))
    tot = g.agg(F.sum(values).alias("_tot"))
    return (attach(g, tot)
             .withColumn("share_pct", F.try_divide(F.col(values), F.col("_tot")) * 100).drop("_tot"))


def hierarchy(df: DataFrame, path: Sequence[str], values: str) -> DataFrame:
    """H4: sums at every level of a column path (treemap / sunburst), level 0 = total."""
    v = as_number(F.col(values), dtypes(df)[values])
    g = df.rollup(*path).agg(sum0(v).alias(values), F.grouping_id().alias("_gid"))
    n = len(path)
    # grouping_id bit i (from the right) is 1 when path[n-1-i] is rolled up
    lvl = F.lit(n) - F.bit_count(F.col("_gid"))
    return g.withColumn("level", lvl.cast("int")).drop("_gid")


def waterfall(df: DataFrame, category: str, value: str, n: int = 12) -> DataFrame:
    """H5: top-n categories by sum with running total; the last bar is flagged ``total``
    as the reference does, and a row with the total over all categories is appended."""
    top = top_n(df, category, value, n=n)
    w = Window.orderBy(F.desc(value), F.col(category).asc_nulls_first())  # n rows
    ranked = top.withColumn("seq", F.row_number().over(w))
    cnt = Window.partitionBy(F.lit(1))
    bars = ranked.select(
        "seq", F.col(category).cast("string").alias("category"), F.col(value).alias("value"),
        F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running"),
        F.when(F.col("seq") == F.max("seq").over(cnt), "total").otherwise("relative").alias("measure"))
    whole = sum0(as_number(F.col(value), dtypes(df)[value]))
    total = df.agg(F.lit(n + 1).alias("seq"), F.lit("Total").alias("category"), whole.alias("value"), whole.alias("running"),
                   F.lit("grand_total").alias("measure"))
    return bars.unionByName(total)


def chart_data(df: DataFrame, x: str, y: str, color: str | None = None, size: str | None = None,
               agg: str | None = None) -> DataFrame:
    """H7: the columns a bar/line/area/scatter/bubble chart plots, optionally aggregated per (x, color)."""
    cols = [c for c in (x, color) if c]
    if agg:
        v = as_number(F.col(y), dtypes(df)[y])
        fn = {"sum": sum0, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max}[agg]
        return df.groupBy(*cols).agg(fn(v).alias(y))
    return df.select(*[c for c in (x, y, color, size) if c])

