"""Anomaly detection.

z-score: one aggregate for the scalars, attached as a scalar subquery; IQR: the
quartiles of ``ranking.quantiles``.  Isolation forest: trees are grown in tasks
on bounded subsamples (<= 256 rows per tree by the published method) and scored
on every row with a pandas UDF.  Daily anomalies run a 7-row rolling window over
the daily series, which holds one row per day.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.exprs import as_number, np_round, sum0
from ledgerlens.operators import ranking
from ledgerlens.operators._common import attach, dtypes, empty, num, ts
from ledgerlens.session import stored


def zscore_column(df: DataFrame, column: str) -> DataFrame:
    x = as_number(F.col(column), dtypes(df)[column])
    stats = df.agg(F.avg(x).alias("_zm"), F.stddev_samp(x).alias("_zs"))
    sd = F.when(F.col("_zs") == 0, F.lit(1.0)).otherwise(F.col("_zs"))
    return (attach(df, stats).withColumn("_zscore", (x - F.col("_zm")) / sd).drop("_zm", "_zs"))


def detect_zscore(df: DataFrame, column: str, threshold: float = 3.0) -> DataFrame:
    """A1: rows with |x - mean| / (std or 1) > threshold, with ``_zscore``."""
    return zscore_column(df, column).where(F.abs("_zscore") > threshold)


def iqr_flag(df: DataFrame, column: str, factor: float = 1.5) -> DataFrame:
    x = as_number(F.col(column), dtypes(df)[column])
    q = ranking.quantiles(df.select(x.alias("_x")), ["_x"], [0.25, 0.75])
    stats = q.select(F.array("_x_q0", "_x_q1").alias("_q"))
    q1, q3 = F.col("_q")[0], F.col("_q")[1]
    lo, hi = q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)
    return (attach(df, stats)
              .withColumn("_flag", F.coalesce((x < lo) | (x > hi), F.lit(False))).drop("_q"))


def detect_iqr(df: DataFrame, column: str, factor: float = 1.5) -> DataFrame:
    """A2: rows outside q1 - f*iqr .. q3 + f*iqr."""
    return iqr_flag(df, column, factor).where("_flag").drop("_flag")


def flag_rows(df: DataFrame, column: str, method: str = "zscore", threshold: float = 3.0) -> DataFrame:
    """Every row with a boolean ``_flag`` (for a chart) instead of a filter."""
    if method == "iqr":
        return iqr_flag(df, column, threshold)
    z = zscore_column(df, column)
    return z.withColumn("_flag", F.coalesce(F.abs("_zscore") > threshold, F.lit(False))).drop("_zscore")


def anomaly_summary(anomalies: DataFrame, data: DataFrame) -> DataFrame:
    """A5: number of anomalies and their share of all rows (2 dp)."""
    a = anomalies.agg(F.count("*").alias("count"))
    t = data.agg(F.count("*").alias("_rows"))
    return attach(a, t).select(
        "count", np_round(F.col("count") / F.greatest(F.col("_rows"), F.lit(1)) * 100, 2).alias("pct_of_data"))


def daily_series(df: DataFrame, mapping: dict) -> DataFrame | None:
    date_c, rev_c = mapping.get("date"), mapping.get("revenue")
    if not date_c or not rev_c:
        return None
    d = F.date_trunc("day", ts(df, date_c)).cast("timestamp_ntz")
    return df.where(d.isNotNull()).groupBy(d.alias("date")).agg(sum0(num(df, rev_c)).alias("value"))


def detect_time_series_anomalies(df: DataFrame, mapping: dict, threshold: float = 3.0,
                                 include_current: bool = True, window: int = 7, min_periods: int = 3) -> DataFrame:
    """A4: days whose sum deviates from the rolling 7-row mean by > threshold rolling stds.

    Instants are truncated to days first, so the ordered window has a row per day.

    ``include_current=True`` is the pandas rolling window (the point is inside
    its own window, so |z| <= 6/sqrt(7) and 3.0 never fires); ``False`` uses the
    previous 7 rows.  Fewer than 8 dates -> no rows.
    """
    daily = daily_series(df, mapping)
    if daily is None:
        return empty(df.sparkSession, "date TIMESTAMP_NTZ, value DOUBLE, z_score DOUBLE")
    frame = (-(window - 1), 0) if include_current else (-window, -1)
    w = Window.orderBy("date").rowsBetween(*frame)
    n_dates = Window.partitionBy(F.lit(1))
    rolled = daily.select(
        "date", "value", F.count("value").over(w).alias("_n"), F.avg("value").over(w).alias("_m"),
        F.stddev_samp("value").over(w).alias("_s"), F.count("*").over(n_dates).alias("_dates"))
    sd = F.when(F.col("_s") == 0, None).otherwise(F.col("_s"))
    z = F.when(F.col("_n") >= min_periods, (F.col("value") - F.col("_m")) / sd)
    return (rolled.withColumn("z_score", z)
                  .where((F.col("_dates") >= 8) & (F.abs("z_score") > threshold))
                  .select("date", "value", "z_score"))


# ---------------------------------------------------------------- A3
def _c(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int, limit: int, nodes: list) -> int:
    idx = len(nodes)
    nodes.append(None)
    n = len(x)
    if depth >= limit or n <= 1:
        nodes[idx] = (-1, 0.0, -1, -1, float(n), _c(n))
        return idx
    lo, hi = x.min(axis=0), x.max(axis=0)
    cand = np.flatnonzero(hi > lo)
    if len(cand) == 0:
        nodes[idx] = (-1, 0.0, -1, -1, float(n), _c(n))
        return idx
    f = int(rng.choice(cand))
    split = float(rng.uniform(lo[f], hi[f]))
    mask = x[:, f] < split
    left = _grow(x[mask], rng, depth + 1, limit, nodes)
    right = _grow(x[~mask], rng, depth + 1, limit, nodes)
    nodes[idx] = (f, split, left, right, float(n), 0.0)
    return idx


def _path_lengths(tree: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    node = np.zeros(len(x), dtype=np.int64)
    depth = np.zeros(len(x))
    active = np.ones(len(x), dtype=bool)
    while active.any():
        f = tree[node, 0].astype(np.int64)
        leaf = f < 0
        done = active & leaf
        if done.any():
            out[done] = depth[done] + tree[node[done], 5]
            active &= ~leaf
        if not active.any():
            break
        a = np.flatnonzero(active)
        go_left = x[a, f[a]] < tree[node[a], 1]
        node[a] = np.where(go_left, tree[node[a], 2], tree[node[a], 3]).astype(np.int64)
        depth[a] += 1
    return out


def _tree_samples(feats: DataFrame, n: int, psi: int, n_trees: int, seed: int) -> DataFrame:
    """(tree, features...): ``psi`` distinct rows for each tree, chosen by hashes of the rows.

    Every row draws as many trees as it takes to give each about 1.5 * psi rows
    (less than one draw on average for a large table); each tree keeps the psi
    rows with the smallest hash, which Spark limits per task before the shuffle.
    """
    share = 1.5 * psi * n_trees / n
    draws = min(n_trees, max(1, math.ceil(share)))
    row = F.xxhash64(F.lit(seed), F.monotonically_increasing_id(), *feats.columns)
    rows = feats.withColumn("_row", row)
    if share < 1:
        rows = rows.where(F.pmod(F.xxhash64("_row", F.lit("take")), F.lit(1 << 30)) < int(share * (1 << 30)))
    # all trees for a small table, else some of them
    tree = F.col("_j") if draws == n_trees else F.pmod(F.xxhash64("_row", "_j"), F.lit(n_trees))
    drawn = (rows.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("tree", tree.cast("int"))
             .withColumn("_h", F.xxhash64("_row", "tree")))
    if 1 < draws < n_trees:  # a row can draw a tree twice
        drawn = drawn.dropDuplicates(["_row", "tree"])
    first = Window.partitionBy("tree").orderBy("_h", "_row")
    return drawn.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= psi).select("tree", *feats.columns)


def detect_isolation_forest(df: DataFrame, columns: Sequence[str], contamination: float = 0.03,
                            n_trees: int = 200, sample_size: int = 256, seed: int = 42) -> DataFrame:
    """A3: isolation forest; rows whose score is below the contamination quantile.

    Nulls -> 0; fewer than 10 rows -> empty.  Each tree is grown in a task from
    its own sample of ``sample_size`` rows; only the trees come to the driver
    (at most 2 * sample_size nodes each, whatever the table size) and are
    broadcast to score every row in parallel.
    Output: the input rows plus ``_anomaly_score`` (negative = anomalous).
    """
    types = dtypes(df)
    feats = [F.coalesce(as_number(F.col(c), types[c]), F.lit(0.0)) for c in columns]
    df = stored(df)  # read by the count, the samples and the scores
    n = df.count()
    if n < 10:
        return df.limit(0).withColumn("_anomaly_score", F.lit(None).cast("double"))
    psi = min(sample_size, n)
    limit = math.ceil(math.log2(max(psi, 2)))
    names = [f"_f{i}" for i in range(len(columns))]
    samples = _tree_samples(df.select(*[f.alias(k) for f, k in zip(feats, names, strict=True)]), n, psi, n_trees, seed)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        nodes: list = []
        _grow(pdf.sort_values(names)[names].to_numpy(dtype=float), np.random.default_rng([seed, tree]), 0, limit, nodes)
        return pd.DataFrame({"tree": [tree], "size": [len(pdf)], "nodes": [np.array(nodes, dtype=float).tobytes()]})

    grown = samples.groupBy("tree").applyInPandas(grow, "tree INT, size INT, nodes BINARY").orderBy("tree").collect()
    bc = df.sparkSession.sparkContext.broadcast([(np.frombuffer(r["nodes"]).reshape(-1, 6), r["size"]) for r in grown])

    @F.pandas_udf(T.DoubleType())
    def score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
        total = np.zeros(len(x))
        for tree, _ in bc.value:
            total += _path_lengths(tree, x)
        cn = np.mean([_c(size) for _, size in bc.value])
        return pd.Series(-(2.0 ** (-total / len(bc.value) / cn)))

    # scored once and stored: the cutoff and the final filter would otherwise each run the trees again
    scored = stored(df.withColumn("_raw", score(*feats)))
    cut = ranking.quantiles(scored, ["_raw"], [contamination]).select(F.col("_raw_q0").alias("_cut"))
    return (attach(scored, cut)
                  .withColumn("_anomaly_score", F.col("_raw") - F.col("_cut"))
                  .where(F.col("_anomaly_score") < 0)
                  .drop("_raw", "_cut"))
