"""Registered anomaly and forecast queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import anomalies, forecast
from ledgerlens.operators._common import attach
from ledgerlens.plans.facts import (EVENTS_FACT_SQL, EVENTS_ROLES, FACT_ROLES, ORDERS_FACT_SQL, events_fact,
                                    orders_fact)
from ledgerlens.plans.registry import np_round_sql, register, rounded, sig


def FF(body):
    return f"WITH f AS ({ORDERS_FACT_SQL})\n{body}"


def EV(body):
    return f"WITH e AS ({EVENTS_FACT_SQL})\n{body}"


def _rows(spark, sf_dir):
    return events_fact(spark, sf_dir).select("event_id", "category", "revenue")


_Z = ", s AS (SELECT avg(revenue) AS m, stddev_samp(revenue) AS sd FROM e)\n"
_ZE = "(revenue - m) / CASE WHEN sd = 0 THEN 1.0 ELSE sd END"


@register("a1_zscore_anomalies", EV(
    _Z + f"SELECT event_id, category, {sig('revenue')} AS revenue, {sig(_ZE, 6)} AS _zscore FROM e, s WHERE abs({_ZE}) > 3"))
def a1_zscore_anomalies(spark, sf_dir):
    return rounded(anomalies.detect_zscore(_rows(spark, sf_dir), "revenue", 3.0), _zscore=6)


_IQR = ", q AS (SELECT quantile_cont(revenue, 0.25) AS q1, quantile_cont(revenue, 0.75) AS q3 FROM e)\n"
_IQRP = "coalesce(revenue < q1 - 1.5 * (q3 - q1) OR revenue > q3 + 1.5 * (q3 - q1), false)"


@register("a2_iqr_anomalies", EV(
    _IQR + f"SELECT event_id, category, {sig('revenue')} AS revenue FROM e, q WHERE {_IQRP}"))
def a2_iqr_anomalies(spark, sf_dir):
    return rounded(anomalies.detect_iqr(_rows(spark, sf_dir), "revenue", 1.5))


@register("a3_isolation_forest")
def a3_isolation_forest(spark, sf_dir):
    f = orders_fact(spark, sf_dir).select("order_id", "product", "revenue", "cost")
    return anomalies.detect_isolation_forest(f, ["revenue", "cost"], contamination=0.03)


@register("a3_isolation_forest_properties", f"""WITH f AS ({ORDERS_FACT_SQL})
SELECT count(*) + 1 AS rows_scored, true AS share_flagged, true AS planted_found FROM f""")
def a3_isolation_forest_properties(spark, sf_dir):
    """A far-off row is planted: it is flagged, and about the wanted share of all rows is."""
    f = orders_fact(spark, sf_dir).select("order_id", "revenue", "cost")
    odd = f.agg(F.lit(-1).cast("long").alias("order_id"), (F.max("revenue") * 50).alias("revenue"), F.lit(-1e6).alias("cost"))
    rows = f.unionByName(odd)
    found = anomalies.detect_isolation_forest(rows, ["revenue", "cost"], contamination=0.03)
    total = rows.agg(F.count("*").alias("rows_scored"))
    return (attach(found.agg(F.count("*").alias("_n"), F.count_if(F.col("order_id") == -1).alias("_p")), total)
            .select("rows_scored", F.abs(F.col("_n") / F.col("rows_scored") - 0.03).__lt__(0.003).alias("share_flagged"),
                    (F.col("_p") == 1).alias("planted_found")))


def _daily_sql(src: str, alias: str, threshold: float) -> str:
    return f"""WITH {alias} AS ({src})
, d AS (SELECT {'order_date' if alias == 'f' else 'date'} AS date, coalesce(sum(revenue), 0) AS value FROM {alias}
        WHERE {'order_date' if alias == 'f' else 'date'} IS NOT NULL GROUP BY 1)
, r AS (SELECT date, value, count(value) OVER w AS n, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s,
               count(*) OVER () AS dates FROM d
        WINDOW w AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
, z AS (SELECT date, value, CASE WHEN n >= 3 THEN (value - m) / nullif(s, 0) END AS z_score, dates FROM r)
SELECT date, {sig('value')} AS value, {sig('z_score', 6)} AS z_score FROM z WHERE dates >= 8 AND abs(z_score) > {threshold}"""


@register("a4_daily_anomalies_events", _daily_sql(EVENTS_FACT_SQL, "e", 2.0))
def a4_daily_anomalies_events(spark, sf_dir):
    return rounded(anomalies.detect_time_series_anomalies(events_fact(spark, sf_dir), EVENTS_ROLES, 2.0), z_score=6)


@register("a4_daily_anomalies_orders", _daily_sql(ORDERS_FACT_SQL, "f", 2.0))
def a4_daily_anomalies_orders(spark, sf_dir):
    return rounded(anomalies.detect_time_series_anomalies(orders_fact(spark, sf_dir), FACT_ROLES, 2.0), z_score=6)


@register("a5_anomaly_summary", EV(
    _Z + f", a AS (SELECT count(*) AS c FROM e, s WHERE abs({_ZE}) > 3)\n"
    f"SELECT c AS count, {sig('c / greatest((SELECT count(*) FROM e), 1) * 100')} AS pct_of_data FROM a"))
def a5_anomaly_summary(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return rounded(anomalies.anomaly_summary(anomalies.detect_zscore(rows, "revenue", 3.0), rows))


@register("a6_flag_rows", EV(
    _IQR + f"SELECT event_id, category, {sig('revenue')} AS revenue, {_IQRP} AS _flag FROM e, q"))
def a6_flag_rows(spark, sf_dir):
    return rounded(anomalies.flag_rows(_rows(spark, sf_dir), "revenue", "iqr", 1.5))


# ---------------------------------------------------------------- forecasts
def _series_sql(src: str, alias: str, date_col: str, unit: str) -> str:
    return f"""WITH {alias} AS ({src})
, g AS (SELECT CAST(date_trunc('{unit}', {date_col}) AS TIMESTAMP) AS date, coalesce(sum(revenue), 0) AS value
        FROM {alias} WHERE {date_col} IS NOT NULL GROUP BY 1)
, sp AS (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 {unit})) AS date FROM g)
, s AS (SELECT sp.date, coalesce(g.value, 0) AS value, row_number() OVER (ORDER BY sp.date) - 1 AS t
        FROM sp LEFT JOIN g ON sp.date = g.date)
"""


@register("f0_series_daily_events", _series_sql(EVENTS_FACT_SQL, "e", "date", "day") +
          f"SELECT date, {sig('value')} AS value, t FROM s")
def f0_series_daily_events(spark, sf_dir):
    return rounded(forecast.prepare_series(events_fact(spark, sf_dir), EVENTS_ROLES, "D"))


@register("f0_series_weekly_orders", _series_sql(ORDERS_FACT_SQL, "f", "order_date", "week") +
          f"SELECT date, {sig('value')} AS value, t FROM s")
def f0_series_weekly_orders(spark, sf_dir):
    return rounded(forecast.prepare_series(orders_fact(spark, sf_dir), FACT_ROLES, "W"))


def _ma_sql(src, alias, date_col, unit, periods, metrics: bool) -> str:
    head = _series_sql(src, alias, date_col, unit)
    return head + f"""
, p AS (SELECT count(*) AS n, greatest(3, least(14, count(*) // 4)) AS w, least({periods}, greatest(1, count(*) // 5)) AS hold,
               max(date) AS last_d FROM s)
, r AS (SELECT a.t, a.date, a.value,
               CASE WHEN count(b.value) >= max(p.w) THEN avg(b.value) END AS roll
        FROM s a JOIN s b ON b.t BETWEEN a.t - (SELECT w FROM p) + 1 AND a.t, p GROUP BY a.t, a.date, a.value)
, m AS (SELECT avg(value) FILTER (WHERE t >= n - w) AS last_avg, avg(value) FILTER (WHERE t < w) AS head_avg,
               coalesce(stddev_samp(value) FILTER (WHERE t >= n - w), 0) AS sd, max(last_d) AS last_d, max(n) AS n,
               sum(value) AS historical_total,
               avg(abs(value - roll)) FILTER (WHERE t >= n - hold) AS mae,
               avg(abs((value - roll) / value)) FILTER (WHERE t >= n - hold AND value <> 0) * 100 AS mape_pct
        FROM r, p)
, fu AS (SELECT last_d + i * INTERVAL 1 {unit} AS date, greatest(0, last_avg + (last_avg - head_avg) / n * i) AS fc, sd
         FROM m, range(1, {periods} + 1) AS rg(i))
""" + (f"""SELECT {sig('mae')} AS mae, {sig('mape_pct')} AS mape_pct, {sig('historical_total')} AS historical_total,
       {sig('(SELECT sum(fc) FROM fu)')} AS forecast_total,
       {sig(f'((SELECT sum(fc) FROM fu) / {periods} - last_avg) / greatest(last_avg, 1e-9) * 100')} AS expected_growth_pct FROM m"""
       if metrics else f"""SELECT date, {sig('value')} AS actual, CAST(NULL AS DOUBLE) AS forecast, CAST(NULL AS DOUBLE) AS lower,
       CAST(NULL AS DOUBLE) AS upper FROM s
UNION ALL SELECT date, NULL, {sig('fc')}, {sig('greatest(0, fc - 1.28 * sd)')}, {sig('fc + 1.28 * sd')} FROM fu""")


@register("f1_moving_average_events", _ma_sql(EVENTS_FACT_SQL, "e", "date", "day", 7, False))
def f1_moving_average_events(spark, sf_dir):
    return rounded(forecast.moving_average(events_fact(spark, sf_dir), EVENTS_ROLES, 7, "D")[0])


@register("f1_moving_average_metrics_events", _ma_sql(EVENTS_FACT_SQL, "e", "date", "day", 7, True))
def f1_moving_average_metrics_events(spark, sf_dir):
    return rounded(forecast.moving_average(events_fact(spark, sf_dir), EVENTS_ROLES, 7, "D")[1])


@register("f1_moving_average_orders_monthly", _ma_sql(ORDERS_FACT_SQL, "f", "order_date", "month", 6, False))
def f1_moving_average_orders_monthly(spark, sf_dir):
    return rounded(forecast.moving_average(orders_fact(spark, sf_dir), FACT_ROLES, 6, "M")[0])


def _ridge_sql(src: str, alias: str, date_col: str, unit: str, periods: int, key: str, metrics: bool, alpha: float = 1.0) -> str:
    """Ridge per series in SQL: moments, a 5x5 Gauss-Jordan elimination step by step, and the predictions."""
    sums = ", ".join([*[f"sum(x{i}) AS sx{i}, sum(x{i} * value) AS sxy{i}" for i in range(5)],
                      *[f"sum(x{i} * x{j}) AS s{i}{j}" for i in range(5) for j in range(i, 5)]])
    feats = ("CAST({t} AS DOUBLE) AS x0, CAST(isodow({d}) - 1 AS DOUBLE) AS x1, CAST(month({d}) AS DOUBLE) AS x2,"
             " sin(2 * pi() * dayofyear({d}) / 365.25) AS x3, cos(2 * pi() * dayofyear({d}) / 365.25) AS x4")
    sym = lambda i, j: f"s{min(i, j)}{max(i, j)}"
    start = ", ".join([*[f"{sym(i, j)} - sx{i} * sx{j} / m{' + ' + str(alpha) if i == j else ''} AS a{i}{j}"
                         for i in range(5) for j in range(5)], *[f"sxy{i} - sx{i} * sy / m AS a{i}5" for i in range(5)]])
    steps, last = [], "el"
    for k in range(5):
        cols = ", ".join((f"a{i}{j} / a{k}{k}" if i == k else f"a{i}{j} - a{i}{k} / a{k}{k} * a{k}{j}") + f" AS a{i}{j}"
                         for i in range(5) for j in range(6))
        steps.append(f", g{k} AS (SELECT {key} AS {key}, part, sy, m, sx0, sx1, sx2, sx3, sx4, {cols} FROM {last})")
        last = f"g{k}"
    predict = " + ".join(["{w}.b", *[f"{{w}}.a{i}5 * {{x}}.x{i}" for i in range(5)]])
    body = f"""WITH {alias} AS ({src})
, g AS (SELECT {key}, CAST(date_trunc('{unit}', {date_col}) AS TIMESTAMP) AS date, coalesce(sum(revenue), 0) AS value
        FROM {alias} WHERE {date_col} IS NOT NULL GROUP BY 1, 2)
, sp AS (SELECT {key}, unnest(generate_series(min(date), max(date), INTERVAL 1 {unit})) AS date FROM g GROUP BY {key})
, s0 AS (SELECT sp.{key}, sp.date, coalesce(g.value, 0) AS value, row_number() OVER (PARTITION BY sp.{key} ORDER BY sp.date) - 1 AS t,
         count(*) OVER (PARTITION BY sp.{key}) AS n FROM sp LEFT JOIN g ON sp.date = g.date AND sp.{key} = g.{key})
, s AS (SELECT *, t < n - least(greatest(3, n // 5), 30) AS train, {feats.format(t='t', d='date')} FROM s0 WHERE n >= 10)
, m AS (SELECT {key}, 'a' AS part, count(*) AS m, sum(value) AS sy, {sums} FROM s WHERE train GROUP BY {key}
        UNION ALL SELECT {key}, 'b', count(*), sum(value), {sums} FROM s GROUP BY {key})
, el AS (SELECT {key}, part, sy, m, sx0, sx1, sx2, sx3, sx4, {start} FROM m)
{"".join(steps)}
, w AS (SELECT *, (sy - a05 * sx0 - a15 * sx1 - a25 * sx2 - a35 * sx3 - a45 * sx4) / m AS b FROM g4)
, p AS (SELECT s.*, {predict.format(w='w', x='s')} AS p FROM s JOIN w ON w.{key} = s.{key} AND w.part = 'a')
, st AS (SELECT {key}, avg(CASE WHEN NOT train THEN abs(value - p) END) AS mae,
         avg(CASE WHEN NOT train AND value <> 0 THEN abs((value - p) / value) END) * 100 AS mape_pct,
         coalesce(stddev_pop(CASE WHEN train THEN value - p END), 0) AS sd, sum(value) AS historical_total,
         avg(CASE WHEN t >= n - {periods} THEN value END) AS tail, max(date) AS last, max(n) AS n FROM p GROUP BY {key})
, f0 AS (SELECT st.*, i, last + INTERVAL 1 {unit} * i AS date FROM st, (SELECT unnest(generate_series(1, {periods})) AS i))
, fx AS (SELECT *, {feats.format(t='(i + n - 1)', d='date')} FROM f0)
, fu AS (SELECT fx.*, greatest(0, {predict.format(w='w', x='fx')}) AS fc FROM fx JOIN w ON w.{key} = fx.{key} AND w.part = 'b')
"""
    if metrics:
        return body + f"""SELECT {key}, {sig('any_value(mae)')} AS mae, {sig('any_value(mape_pct)')} AS mape_pct,
 {sig('any_value(historical_total)')} AS historical_total, {sig('sum(fc)')} AS forecast_total,
 {sig('(avg(fc) - any_value(tail)) / greatest(any_value(tail), 1e-9) * 100')} AS expected_growth_pct FROM fu GROUP BY {key}"""
    return body + f"""SELECT {key}, date, {sig('value')} AS actual, CAST(NULL AS DOUBLE) AS forecast, CAST(NULL AS DOUBLE) AS lower,
 CAST(NULL AS DOUBLE) AS upper FROM s
UNION ALL SELECT {key}, date, NULL, {sig('fc')}, {sig('greatest(0, fc - 1.28 * sd)')}, {sig('fc + 1.28 * sd')} FROM fu"""


_ONE_EVENTS = f"SELECT 'all' AS k, * FROM ({EVENTS_FACT_SQL})"
_ONE_ORDERS = f"SELECT 'all' AS k, * FROM ({ORDERS_FACT_SQL})"


@register("f2_ridge_events", "SELECT * EXCLUDE (k) FROM (" + _ridge_sql(_ONE_EVENTS, "e", "date", "day", 14, "k", False) + ")")
def f2_ridge_events(spark, sf_dir):
    return rounded(forecast.ridge(events_fact(spark, sf_dir), EVENTS_ROLES, 14, "D")[0])


@register("f2_ridge_metrics_orders", "SELECT * EXCLUDE (k) FROM ("
          + _ridge_sql(_ONE_ORDERS, "f", "order_date", "day", 30, "k", True) + ")")
def f2_ridge_metrics_orders(spark, sf_dir):
    return rounded(forecast.ridge(orders_fact(spark, sf_dir), FACT_ROLES, 30, "D")[1])


@register("f3_random_forest_events")
def f3_random_forest_events(spark, sf_dir):
    return forecast.random_forest(events_fact(spark, sf_dir), EVENTS_ROLES, 7, "D")[0]


@register("f3_random_forest_shape", _series_sql(EVENTS_FACT_SQL, "e", "date", "day") +
          f"SELECT count(*) AS history, {sig('sum(value)')} AS total, 7 AS horizon, true AS ordered, max(date) + INTERVAL 7 day AS last FROM s")
def f3_random_forest_shape(spark, sf_dir):
    """What must hold of any forest: the history, the horizon, and forecasts inside their bands."""
    out = forecast.random_forest(events_fact(spark, sf_dir), EVENTS_ROLES, 7, "D")[0]
    inside = (F.col("lower") <= F.col("forecast")) & (F.col("forecast") <= F.col("upper")) & (F.col("lower") >= 0)
    return rounded(out.agg(F.count("actual").alias("history"), F.sum("actual").alias("total"),
                           F.count("forecast").cast("int").alias("horizon"), F.bool_and(inside).alias("ordered"),
                           F.max("date").alias("last")))


@register("f4_forecast_per_category", _ridge_sql(EVENTS_FACT_SQL, "e", "date", "day", 7, "category", False))
def f4_forecast_per_category(spark, sf_dir):
    """Many series at once: one ridge per event type."""
    return rounded(forecast.forecast_many(events_fact(spark, sf_dir), EVENTS_ROLES, ["category"], 7, "D")[0])


@register("f4_metrics_per_category", _ridge_sql(EVENTS_FACT_SQL, "e", "date", "day", 7, "category", True))
def f4_metrics_per_category(spark, sf_dir):
    return rounded(forecast.forecast_many(events_fact(spark, sf_dir), EVENTS_ROLES, ["category"], 7, "D")[1].drop("status"))


def _averages_sql(src: str, alias: str, date_col: str, unit: str, periods: int, key: str, metrics: bool) -> str:
    """Moving average per series: each has its own window."""
    body = f"""WITH {alias} AS ({src})
, g AS (SELECT {key}, CAST(date_trunc('{unit}', {date_col}) AS TIMESTAMP) AS date, coalesce(sum(revenue), 0) AS value
        FROM {alias} WHERE {date_col} IS NOT NULL GROUP BY 1, 2)
, sp AS (SELECT {key}, unnest(generate_series(min(date), max(date), INTERVAL 1 {unit})) AS date FROM g GROUP BY {key})
, s0 AS (SELECT sp.{key}, sp.date, coalesce(g.value, 0) AS value, row_number() OVER (PARTITION BY sp.{key} ORDER BY sp.date) - 1 AS t,
         count(*) OVER (PARTITION BY sp.{key}) AS n FROM sp LEFT JOIN g ON sp.date = g.date AND sp.{key} = g.{key})
, s AS (SELECT *, greatest(3, least(14, n // 4)) AS w, least({periods}, greatest(1, n // 5)) AS hold FROM s0 WHERE n >= 10)
, r AS (SELECT a.{key}, a.t, a.date, a.value, a.n, a.w, a.hold, CASE WHEN count(*) >= a.w THEN avg(b.value) END AS roll
        FROM s a JOIN s b ON a.{key} = b.{key} AND b.t BETWEEN a.t - a.w + 1 AND a.t GROUP BY a.{key}, a.t, a.date, a.value, a.n, a.w, a.hold)
, m AS (SELECT {key}, avg(CASE WHEN t >= n - w THEN value END) AS tail, avg(CASE WHEN t < w THEN value END) AS head,
               coalesce(stddev_samp(CASE WHEN t >= n - w THEN value END), 0) AS sd, max(date) AS last, max(n) AS n, sum(value) AS historical_total,
               avg(CASE WHEN t >= n - hold THEN abs(value - roll) END) AS mae,
               avg(CASE WHEN t >= n - hold AND value <> 0 THEN abs((value - roll) / value) END) * 100 AS mape_pct FROM r GROUP BY {key})
, fu AS (SELECT m.*, last + INTERVAL 1 {unit} * i AS date, greatest(0, tail + (tail - head) / n * i) AS fc
         FROM m, (SELECT unnest(generate_series(1, {periods})) AS i))
"""
    if metrics:
        return body + f"""SELECT {key}, {sig('max(mae)')} AS mae, {sig('max(mape_pct)')} AS mape_pct, {sig('max(historical_total)')} AS historical_total,
       {sig('sum(fc)')} AS forecast_total, {sig('(avg(fc) - max(tail)) / greatest(max(tail), 1e-9) * 100')} AS expected_growth_pct FROM fu GROUP BY {key}"""
    return body + f"""SELECT {key}, date, {sig('value')} AS actual, CAST(NULL AS DOUBLE) AS forecast, CAST(NULL AS DOUBLE) AS lower,
       CAST(NULL AS DOUBLE) AS upper FROM s
UNION ALL SELECT {key}, date, NULL, {sig('fc')}, {sig('greatest(0, fc - 1.28 * sd)')}, {sig('fc + 1.28 * sd')} FROM fu"""


@register("f4_average_per_category", _averages_sql(EVENTS_FACT_SQL, "e", "date", "day", 7, "category", False))
def f4_average_per_category(spark, sf_dir):
    """Many series at once: one moving average per event type."""
    return rounded(forecast.forecast_many(events_fact(spark, sf_dir), EVENTS_ROLES, ["category"], 7, "D", "moving_average")[0])


@register("f4_average_metrics_per_region", _averages_sql(ORDERS_FACT_SQL, "f", "order_date", "month", 6, "region", True))
def f4_average_metrics_per_region(spark, sf_dir):
    frame = forecast.forecast_many(orders_fact(spark, sf_dir), FACT_ROLES, ["region"], 6, "M", "moving_average")[1]
    return rounded(frame.drop("status"))


@register("f4_forest_per_category", f"""WITH e AS ({EVENTS_FACT_SQL})
SELECT category, CAST(date_diff('day', min(date), max(date)) + 1 AS BIGINT) AS periods, 7 AS ahead, true AS within, true AS ordered, true AS scored
FROM e GROUP BY category""")
def f4_forest_per_category(spark, sf_dir):
    """A forest per event type: its forecasts are means of history, so they lie within it; bands are ordered; errors exist."""
    frame, metrics = forecast.forecast_many(events_fact(spark, sf_dir), EVENTS_ROLES, ["category"], 7, "D", "random_forest")
    seen = frame.groupBy("category").agg(
        F.count("actual").alias("periods"), F.count("forecast").cast("int").alias("ahead"),
        ((F.min("forecast") >= F.min("actual")) & (F.max("forecast") <= F.max("actual"))).alias("within"),
        F.bool_and(F.col("forecast").isNull() | ((F.col("lower") <= F.col("forecast")) & (F.col("forecast") <= F.col("upper")))).alias("ordered"))
    return seen.join(metrics.select("category", (F.col("mae").isNotNull() & (F.col("status") == "ok")).alias("scored")), "category")
