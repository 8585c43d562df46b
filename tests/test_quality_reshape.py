import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.operators import profiling, ranking, reshape, validation
from ledgerlens.sources.checks import upload_findings

INF = float("inf")


def test_quality_score_clean_beats_dirty(spark):
    clean = spark.createDataFrame([(i, i * 2) for i in range(100)], "a bigint, b bigint")
    dirty = spark.createDataFrame([(None if i <= 40 else i, i * 2) for i in range(100)] + [(i, i * 2) for i in range(80, 100)],
                                  "a bigint, b bigint")
    s1 = profiling.quality_score(clean).first()[0]
    s2 = profiling.quality_score(dirty).first()[0]
    assert s1 > s2


def test_numeric_stats_bias_corrected(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 5, 6, 7, 100)], "x double")
    r = profiling.numeric_stats(df).first()
    assert r.skew == pytest.approx(2.809, abs=1e-3) and r.kurtosis == pytest.approx(7.917, abs=1e-3)
    assert r.p25 == 2.75


def test_validation_rules(spark):
    neg = spark.createDataFrame([(-100, 50), (200, 60), (300, 70)], "revenue bigint, cost bigint")
    checks = {r.name: r for r in validation.validate_dataset(neg, {"revenue": "revenue", "cost": "cost"}).collect()}
    assert not checks["Negative Revenue"].passed
    assert validation.validate_dataset(spark.createDataFrame([(1,), (2,), (3,)], "a bigint"), {}).count() == 2
    below = spark.createDataFrame([(10, 50), (200, 20)], "revenue bigint, cost bigint")
    inv = validation.invalid_rows(below, {"revenue": "revenue", "cost": "cost"})
    assert inv.where(F.col("check") == "Selling Below Cost").count() == 1


def test_upload_findings(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "a bigint, b bigint")
    msgs = [r.message for r in upload_findings(df).collect()]
    assert any("duplicate" in m for m in msgs) and any("constant" in m for m in msgs)


def test_merge_null_keys(spark):
    left = spark.createDataFrame([(1, "l1"), (None, "l2"), (3, "l3")], "k bigint, v string")
    right = spark.createDataFrame([(1, "r1"), (None, "r2"), (4, "r4")], "k bigint, v string")
    inner = reshape.merge_datasets(left, right, "k", "inner")
    assert sorted(inner.collect(), key=str) == sorted([(1, "l1", "r1"), (None, "l2", "r2")], key=str)
    assert inner.columns == ["k", "v_x", "v_y"]
    outer = reshape.merge_datasets(left, right, "k", "outer")
    assert sorted([r.k for r in outer.collect()], key=lambda x: (x is None, x)) == [1, 3, 4, None]
    assert reshape.merge_datasets(left, right, "k", "right").count() == 3


def test_bins_match_cut(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)], "x double")
    counts = {r.x_bin: r["count"] for r in reshape.bin_column(df, "x", 5).groupBy("x_bin").count().collect()}
    assert counts == {1: 3, 2: 2, 3: 2, 4: 2, 5: 2}
    const = spark.createDataFrame([(7.0,), (7.0,)], "x double")
    assert {r.x_bin for r in reshape.bin_column(const, "x", 5).collect()} == {3}


def test_label_encoding_first_appearance(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "a"), (3, "b"), (4, None)], "i bigint, c string")
    out = {r.i: r.c_encoded for r in reshape.label_encode(df, "c", ["i"]).collect()}
    assert out == {0: 0, 1: 1, 2: 1, 3: 0, 4: -1}


def test_split_pivot_onehot(spark):
    df = spark.createDataFrame([("a b c", "x", 1.0), ("d", "y", 2.0), (None, "x", 3.0)], "s string, g string, v double")
    sp = reshape.split_column(df, "s", " ")
    assert sp.columns[-3:] == ["s_1", "s_2", "s_3"]
    assert [r.s_1 for r in sp.collect()] == ["a", "d", "None"]
    pv = reshape.pivot(df, "g", "s", "v")
    assert set(pv.columns) == {"g", "a b c", "d"}
    oh = reshape.one_hot(df, "g")
    assert oh.columns[-2:] == ["g_x", "g_y"]


def between(values, p):
    """Linear interpolation; an infinity stands at its own rank, and between two of both signs there is nothing."""
    v = sorted(values)
    h = (len(v) - 1) * p
    a, b = v[int(h)], v[min(len(v) - 1, int(h) + 1)]
    at = a if h == int(h) or a == b else a + (h - int(h)) * (b - a)
    return None if at != at else at


@pytest.mark.parametrize("extra", [[INF], [-INF], [INF, -INF], [INF] * 70_000, [5e-324, -1.7e308, 1.7e308, INF]])
def test_quantiles_with_infinities(spark, extra):
    values = [float(i % 977) for i in range(60_000)] + extra
    df = spark.createDataFrame(pd.DataFrame({"k": [i % 2 for i in range(len(values))], "x": values}))
    probs = [0.0, 0.25, 0.5, 0.75, 0.999999, 1.0]
    assert list(ranking.quantiles(df, ["x"], probs).first()) == pytest.approx([between(values, p) for p in probs])
    for r in ranking.grouped_quantiles(df, ["k"], "x", probs).collect():
        assert list(r)[1:] == pytest.approx([between(values[r.k::2], p) for p in probs])


def test_quantiles_of_infinities_alone(spark):
    df = spark.createDataFrame([(INF, -INF, None), (INF, INF, None)], "a double, b double, c double")
    assert list(ranking.quantiles(df, ["a", "b", "c"], [0.0, 0.5, 1.0]).first()) == [INF, INF, INF, -INF, None, INF, None, None, None]


@pytest.mark.parametrize("buckets", [7, 5000])
def test_many_buckets_equal_a_plain_window(spark, buckets):
    """Nulls, ties of the first column and both directions; beyond a few hundred bounds a binary search finds the bucket."""
    rows = spark.range(30_000).selectExpr(
        "id", "CASE WHEN id % 11 = 0 THEN NULL ELSE hash(id) % 500 END AS a", "CASE WHEN id % 7 = 0 THEN NULL ELSE concat('s', hash(id, 1) % 90) END AS b",
        "CASE WHEN id % 5 = 0 THEN id END AS v")
    order = [("a", "desc"), "b", "id"]
    got = ranking.row_number(rows, order, num_partitions=buckets)
    plain = F.row_number().over(Window.orderBy(F.col("a").desc_nulls_last(), F.col("b").asc_nulls_first(), "id"))
    assert got.withColumn("want", plain).where("rn != want").count() == 0 and got.count() == 30_000
    assert ranking.bucketed(rows, order, buckets).select("_rk_bucket").distinct().count() > min(buckets, 4000) * 0.8
    filled = ranking.fill(rows, ["v"], ["a", "b", "id"], num_partitions=buckets)
    w = Window.orderBy(F.col("a").asc_nulls_first(), F.col("b").asc_nulls_first(), "id").rowsBetween(Window.unboundedPreceding, 0)
    want = rows.withColumn("v", F.last("v", ignorenulls=True).over(w))
    assert filled.exceptAll(want).isEmpty() and filled.count() == 30_000


def test_buckets_follow_the_row_count(spark, monkeypatch):
    monkeypatch.setattr(ranking, "_ROWS", 50)
    rows = spark.range(20_000).withColumn("k", F.xxhash64("id"))
    assert 300 <= ranking.bucketed(rows, ["k"]).select("_rk_bucket").distinct().count() <= 400


def test_correlations_of_many_columns(spark, monkeypatch):
    """Gaps, columns without spread, large offsets; against pandas, and by both ways on the same few columns."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 60)) @ rng.normal(size=(60, 300)) + 1e6 * rng.normal(size=300)
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 5], x[:, 6] = 7.5, np.nan
    x[1:, 8] = np.nan
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(300)])
    got = profiling.correlation_matrix(spark.createDataFrame(pdf).repartition(5))
    found = got.toPandas().pivot(index="feature_a", columns="feature_b", values="correlation").loc[pdf.columns, pdf.columns].to_numpy()
    want = pdf.corr().to_numpy()
    want[[5, 6, 8]], want[:, [5, 6, 8]] = np.nan, np.nan
    assert np.array_equal(np.isnan(found), np.isnan(want)) and np.nanmax(np.abs(found - want)) < 6e-4
    few = spark.createDataFrame(pdf.iloc[:, :9])
    strong = {(f"c{i}", f"c{j}") for i in range(9) for j in range(i + 1, 9) if abs(np.round(want[i, j], 3)) >= 0.1}
    assert {(r.feature_a, r.feature_b) for r in profiling.strong_correlations(few, 0.1).collect()} == strong and strong


def test_correlations_of_late_values_with_a_large_offset(spark):
    rows = [(None, None, 1.0)] * 1500 + [(1e9 + i % 3, 2e9 - i % 3, 1.0) for i in range(500)]
    got = {(r[0], r[1]): r[2] for r in profiling.correlation_matrix(spark.createDataFrame(rows, "a double, b double, c double")).collect()}
    assert got["a", "b"] == -1.0 and got["a", "a"] == 1.0 and got["c", "c"] is None and got["a", "c"] is None


@pytest.mark.parametrize("least", [20, 10**6])
def test_full_outer_join_with_hot_keys(spark, monkeypatch, least):
    """Hot keys on both sides, on one side only, and null; two key columns; against pandas."""
    monkeypatch.setattr(reshape, "LEAST_HOT", least)
    left = pd.DataFrame({"k": [1] * 400 + [2] * 300 + [None] * 90 + list(range(10, 210)), "g": ["a"] * 990, "v": range(990)}).astype({"k": "Int64"})
    right = pd.DataFrame({"k": [1, 1, 3] + [4] * 500 + [None] * 3 + list(range(150, 260)), "g": ["a"] * 616, "v": range(616)}).astype({"k": "Int64"})
    def plain_rows(d):
        return [tuple(None if pd.isna(x) else x if isinstance(x, str) else int(x) for x in r) for r in d.itertuples(index=False)]

    frames = [spark.createDataFrame(plain_rows(d), "k long, g string, v long") for d in (left, right)]
    out = reshape.merge_datasets(*frames, ["k", "g"], "outer")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join FullOuter") == 1
    want = left.merge(right, on=["k", "g"], how="outer")
    got = [tuple(r) for r in out.select("k", "g", "v_x", "v_y").collect()]
    assert sorted(got, key=str) == sorted(plain_rows(want), key=str)
