import datetime as dt
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import anomalies, customers, forecast, products, ranking
from ledgerlens.plans.facts import EVENTS_ROLES, FACT_ROLES, events_fact, orders_fact


def test_rfm_quartiles_n6(spark):
    base = spark.createDataFrame([(f"c{i}", i, i, float(i)) for i in range(1, 7)],
                                 "customer string, recency bigint, frequency bigint, monetary double")
    ranked = ranking.row_number(base, ["frequency", "customer"], out="rn")
    n = F.lit(6)
    got = sorted((r.customer, r.F) for r in ranked.select("customer", customers._rank_quartile(F.col("rn"), n).alias("F")).collect())
    assert [f for _, f in got] == [1, 1, 2, 3, 4, 4]  # bins of size 2, 1, 1, 2


def test_rfm_on_fact(spark, sf):
    rfm = customers.rfm_analysis(orders_fact(spark, sf), FACT_ROLES)
    pdf = rfm.toPandas()
    assert set(pdf["segment"]) <= {"Champions", "Loyal Customers", "Potential Loyalists", "At Risk",
                                   "Cannot Lose Them", "Hibernating"}
    assert pdf["customer"].is_unique and pdf["R"].between(1, 4).all()
    clv = customers.customer_lifetime_value(rfm)
    assert np.allclose(clv.toPandas()["estimated_clv"], clv.toPandas()["monetary"])


def test_recency_ties_defined(spark):
    rows = [(f"c{i}", dt.datetime(2024, 1, 10) - dt.timedelta(days=d), 1.0) for i, d in enumerate([0, 0, 0, 0, 1, 2])]
    df = spark.createDataFrame(rows, "cust string, d timestamp, amount double")
    rfm = customers.rfm_analysis(df, {"customer_id": "cust", "date": "d", "revenue": "amount"})
    assert rfm.count() == 6 and rfm.where(F.col("R").isNull()).count() == 0


def test_abc_single_dominant_product(spark):
    df = spark.createDataFrame([("big", 85.0), ("s1", 10.0), ("s2", 5.0)], "p string, r double")
    out = {r.p: r["class"] for r in products.abc_classification(df, {"product": "p", "revenue": "r"}).collect()}
    assert out == {"big": "B", "s1": "B", "s2": "C"}  # 85 % -> B, 95 % -> B, 100 % -> C


def test_running_sum_matches_cumsum(spark):
    rng = np.random.default_rng(1)
    vals = rng.random(500)
    df = spark.createDataFrame([(int(i), float(v)) for i, v in enumerate(vals)], "k bigint, v double")
    got = ranking.running_sum(df, ["k"], "v", "c", num_partitions=7).orderBy("k").toPandas()["c"].to_numpy()
    assert np.allclose(got, np.cumsum(vals))
    rn = ranking.row_number(df, [("v", "desc")], "rn", num_partitions=5).orderBy("rn").toPandas()
    assert (rn["rn"].to_numpy() == np.arange(1, 501)).all() and rn["v"].is_monotonic_decreasing


def test_zscore_iqr_forest(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 2, 1, 1000)], "v double")
    assert 1000 in [r.v for r in anomalies.detect_zscore(df, "v", 2.0).collect()]
    df2 = spark.createDataFrame([(float(v),) for v in (10, 11, 12, 13, 14, 500)], "v double")
    assert 500 in [r.v for r in anomalies.detect_iqr(df2, "v").collect()]
    pts = [(float(i), float(i)) for i in range(50)] + [(500.0, -500.0)]
    df3 = spark.createDataFrame(pts, "a double, b double")
    out = anomalies.detect_isolation_forest(df3, ["a", "b"], contamination=0.05).collect()
    assert len(out) >= 1 and (500.0, -500.0) in [(r.a, r.b) for r in out]


def test_daily_anomaly_bound(spark):
    days = [(dt.datetime(2024, 1, d), 0.0) for d in range(1, 8)] + [(dt.datetime(2024, 1, 8), 0.0)]
    days[6] = (dt.datetime(2024, 1, 7), 70.0)
    df = spark.createDataFrame(days, "d timestamp, v double")
    m = {"date": "d", "revenue": "v"}
    out = anomalies.detect_time_series_anomalies(df, m, threshold=2.0).collect()
    assert len(out) == 1 and out[0].z_score == pytest.approx(2.2678, abs=1e-4)
    assert anomalies.detect_time_series_anomalies(df, m, threshold=3.0).count() == 0


def test_forecast_shapes(spark, sf):
    ev = events_fact(spark, sf)
    for method, h in (("ridge", 14), ("moving_average", 7), ("random_forest", 7)):
        out, metrics = forecast.forecast(ev, EVENTS_ROLES, periods=h, freq="D", method=method)
        pdf = out.toPandas()
        assert pdf["forecast"].notna().sum() == h and (pdf["forecast"].dropna() >= 0).all()
        assert (pdf["lower"].dropna() <= pdf["upper"].dropna()).all()
        assert metrics.first().forecast_total is not None
    with pytest.raises(ValueError):
        forecast.forecast(ev, {"date": None, "revenue": None}, periods=7)


def test_ridge_matches_closed_form(spark, sf):
    import pandas as pd
    ev = events_fact(spark, sf)
    s = forecast.prepare_series(ev, EVENTS_ROLES, "D").orderBy("t").toPandas()
    out, _ = forecast.ridge(ev, EVENTS_ROLES, periods=5)

    def design(t, dates):
        doy = dates.dayofyear.to_numpy()
        return np.column_stack([np.ones(len(t)), t, dates.dayofweek, dates.month, np.sin(2 * np.pi * doy / 365.25),
                                np.cos(2 * np.pi * doy / 365.25)]).astype(float)
    idx = pd.DatetimeIndex(s["date"])
    x, n = design(s["t"].to_numpy(), idx), len(s)
    w = np.linalg.solve(x.T @ x + np.diag([0.0, 1, 1, 1, 1, 1]), x.T @ s["value"].to_numpy())
    exp = np.clip(design(np.arange(n, n + 5), pd.date_range(idx[-1], periods=6, freq="D")[1:]) @ w, 0, None)
    got = out.where(F.col("forecast").isNotNull()).orderBy("date").toPandas()["forecast"].to_numpy()
    assert np.allclose(got, exp, rtol=1e-6)


def test_many_series_report_short_ones(spark):
    rows = [("long", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(40)]
    rows += [("short", dt.datetime(2024, 1, 1), 1.0), (None, dt.datetime(2024, 1, 2), 1.0)]
    df = spark.createDataFrame(rows, "k string, d timestamp, v double")
    frame, metrics = forecast.forecast_many(df, {"date": "d", "revenue": "v"}, ["k"], 5)
    assert {r.k: r.status for r in metrics.collect()} == {"long": "ok", "short": "too short", None: "too short"}
    ahead = [r.forecast for r in frame.where("forecast IS NOT NULL").orderBy("date").collect()]
    assert len(ahead) == 5 and all(abs(f - (40 + i)) < 0.5 for i, f in enumerate(ahead))
    with pytest.raises(ValueError):
        forecast.forecast_many(df, {"date": "d", "revenue": "v"}, ["k"], 5, method="arima")


def test_forests_of_many_series(spark):
    """A step in time is found by every series' forest; short series, null keys and the seed."""
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), float(100 * (i >= 60) + 5 * k)) for k in (1, 2) for i in range(90)]
    rows += [(None, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), 7.0) for i in range(30)] + [(9, dt.datetime(2024, 1, 1), 1.0)]
    df = spark.createDataFrame(rows, "k int, d timestamp, v double")
    def run(seed=42):
        frame, metrics = forecast.forecast_many(df, {"date": "d", "revenue": "v"}, ["k"], 4, method="random_forest", num_trees=30, seed=seed)
        return {(r.k, r.date): r.forecast for r in frame.where("forecast IS NOT NULL").collect()}, {r.k: r.status for r in metrics.collect()}
    ahead, status = run()
    assert status == {1: "ok", 2: "ok", None: "ok", 9: "too short"} and len(ahead) == 12
    for (k, _), f in ahead.items():
        assert f == pytest.approx(7.0 if k is None else 100 + 5 * k, abs=1.5)
    assert run()[0] == ahead


def test_growth_equals_best_cuts_found_by_trial():
    """One tree of depth 1 and 2 against all cuts tried one by one."""
    from ledgerlens.operators import forests
    rng = np.random.default_rng(2)
    bins, y, w = rng.integers(0, 6, (40, 3)), rng.normal(size=40), rng.integers(0, 3, (1, 40)).astype(float)

    def fit(rows, depth):
        def cost(r):
            return 0.0 if not w[0, r].sum() else -((w[0, r] * y[r]).sum() ** 2) / w[0, r].sum()
        cuts = [(cost(rows[bins[rows, f] <= b]) + cost(rows[bins[rows, f] > b]), f, b) for f in range(3) for b in range(5)
                if w[0, rows[bins[rows, f] <= b]].sum() and w[0, rows[bins[rows, f] > b]].sum()]
        if not depth or not cuts or min(cuts)[0] >= cost(rows) - 1e-9:
            return {int(i): (w[0, rows] * y[rows]).sum() / w[0, rows].sum() for i in rows}
        _, f, b = min(cuts)
        return fit(rows[bins[rows, f] <= b], depth - 1) | fit(rows[bins[rows, f] > b], depth - 1)

    for depth in (1, 2, 3):
        want = fit(np.arange(40), depth)
        assert forests.grow(bins, y, w, depth) == pytest.approx([want[i] for i in range(40)])


def test_json_first_list_key_and_csv(spark, tmpdir_path):
    p = f"{tmpdir_path}/doc.json"
    with open(p, "w") as fh:
        json.dump({"meta": 1, "rows": [{"a": {"b": 1}}, {"a": {"b": 2}}]}, fh)
    from ledgerlens.sources import readers
    df = readers.read_json(spark, p, multi_line=True)
    assert df.columns == ["a.b"] and sorted(r[0] for r in df.collect()) == [1, 2]
    c = f"{tmpdir_path}/x.csv"
    with open(c, "w") as fh:
        fh.write("a,b\n1,2\n3,NA\n")
    cdf = readers.read_csv(spark, c)
    assert cdf.count() == 2 and dict(cdf.dtypes) == {"a": "bigint", "b": "bigint"}


def test_archive_members(spark, tmpdir_path):
    z = f"{tmpdir_path}/bundle.zip"
    with zipfile.ZipFile(z, "w") as zf:
        zf.writestr("sales.csv", "a,b\n1,x\n2,y\n")
        zf.writestr("__MACOSX/._sales.csv", "junk")
        zf.writestr("notes.txt", "skip me")
        zf.writestr("items.json", json.dumps({"items": [{"k": 1}, {"k": 2}]}))
    from ledgerlens.sources import readers
    with zipfile.ZipFile(f"{tmpdir_path}/second.zip", "w") as zf:
        zf.writestr("items.json", json.dumps([{"k": 3}, {"k": 4, "note": "é"}, 5]))
        zf.writestr("quoted.csv", 'a,b\n1,"two\nlines"\n')
    with open(f"{tmpdir_path}/broken.zip", "wb") as fh:
        fh.write(b"no archive")
    tables, failed = readers.archive_tables(spark, tmpdir_path)
    assert set(tables) == {"sales.csv", "bundle.zip/items.json", "second.zip/items.json", "quoted.csv"}
    assert tables["sales.csv"].count() == 2 and tables["bundle.zip/items.json"].count() == 2
    assert tables["second.zip/items.json"].columns == ["0", "k", "note"]
    assert [tuple(r) for r in tables["quoted.csv"].collect()] == [(1, "two\nlines")]
    assert [r.archive.rsplit("/", 1)[1] for r in failed.collect()] == ["broken.zip"]


def test_json_documents_take_their_own_first_list(spark, tmpdir_path):
    from ledgerlens.sources import readers
    for name, doc in (("a", {"x": 1, "p": [{"k": 1}], "q": [{"k": 9}]}), ("b", {"q": [{"k": 2}, {"k": 3}], "p": [{"k": 9}]}),
                      ("c", [{"k": 4}]), ("d", {"k": 5})):
        with open(f"{tmpdir_path}/{name}.json", "w") as fh:
            json.dump(doc, fh, indent=1)
    assert sorted(r.k for r in readers.read_json(spark, tmpdir_path, multi_line=True).collect()) == [1, 2, 3, 4, 5]
    with open(f"{tmpdir_path}/lines.csv", "w") as fh:
        fh.write('code,text\n1D,"a\nb"\n2F,c\n')
    df = readers.read_csv(spark, f"{tmpdir_path}/lines.csv", multi_line=True)
    assert sorted(tuple(r) for r in df.collect()) == [("1D", "a\nb"), ("2F", "c")]


def test_streaming_daily_revenue(spark, sf, tmpdir_path):
    from ledgerlens.streaming import revenue_by_period_stream, run_once
    src = f"{tmpdir_path}/events"
    ev = spark.read.parquet(f"{sf}/events.parquet")
    ev.write.parquet(src)
    stream = revenue_by_period_stream(spark, src, ev.schema, {"date": "ts", "revenue": "value"}, "D", "0 seconds")
    run_once(stream, f"{tmpdir_path}/out", f"{tmpdir_path}/ckpt")
    got = spark.read.parquet(f"{tmpdir_path}/out")
    batch = ev.groupBy(F.date_trunc("day", "ts").alias("d")).agg(F.sum("value").alias("v"))
    # every closed day is emitted once; the last (open) day waits for the watermark
    assert got.count() == batch.count() - 1
