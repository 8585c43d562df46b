"""Random forests of many short series at once.

A series has a row per period, so it is small; there may be very many of them.
Its trees are grown in batches, and each (series, batch) is a group of its own
that some task takes.  Within a batch all trees grow together, level by level:
a histogram of weights and values per (tree, node, bin) of each feature gives
the best cut of every node, as in the distributed growth of one large tree.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Trees that grow together, and bins per feature.
BATCH, BINS = 25, 64


def binned(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Bin numbers of a feature; the borders lie half-way between values that the known rows hold."""
    values = np.unique(x[known])
    if len(values) > BINS:
        values = np.unique(np.quantile(values, np.linspace(0, 1, BINS), method="nearest"))
    return np.searchsorted((values[1:] + values[:-1]) / 2, x, side="left")


def grow(bins: np.ndarray, y: np.ndarray, weights: np.ndarray, depth: int) -> np.ndarray:
    """Sum over trees of each row's prediction.  ``weights`` (trees x rows): how often a tree has drawn a row."""
    trees, rows = weights.shape
    node = np.zeros((trees, rows), np.int64)
    base = np.arange(trees)[:, None]
    w, wy = weights.ravel(), (weights * y).ravel()
    for level in range(depth):
        nodes = 1 << level
        slot = base * nodes + node
        best, feature, border = np.zeros(trees * nodes), np.full(trees * nodes, -1), np.zeros(trees * nodes, np.int64)
        for f in range(bins.shape[1]):
            size = int(bins[:, f].max()) + 1
            key = (slot * size + bins[:, f]).ravel()
            left = np.bincount(key, w, trees * nodes * size).reshape(-1, size).cumsum(axis=1)
            sums = np.bincount(key, wy, trees * nodes * size).reshape(-1, size).cumsum(axis=1)
            all_, total = left[:, -1:], sums[:, -1:]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = sums**2 / left + (total - sums) ** 2 / (all_ - left) - total**2 / all_
            gain = np.where((left > 0) & (left < all_), gain, 0.0)
            at = gain.argmax(axis=1)
            top = gain[np.arange(len(at)), at]
            better = top > best + 1e-9 * (1 + np.abs(best))
            best, feature, border = np.where(better, top, best), np.where(better, f, feature), np.where(better, at, border)
        value = np.take_along_axis(np.broadcast_to(bins, (trees, *bins.shape)), np.maximum(feature[slot], 0)[:, :, None], axis=2)[:, :, 0]
        node = 2 * node + ((feature[slot] >= 0) & (value > border[slot]))
    slot = (base * (1 << depth) + node).ravel()
    size = trees << depth
    with np.errstate(invalid="ignore"):
        means = np.bincount(slot, wy, size) / np.bincount(slot, w, size)
    return np.nan_to_num(means[slot]).reshape(trees, rows).sum(axis=0)


def predictions(rows: DataFrame, keys: list[str], num_trees: int, depth: int, seed: int) -> DataFrame:
    """(keys, t, p): a forest's prediction for each row of each series.

    Rows have t, value (null in the future), train and the features x0, x1, ...
    The forest that predicts known rows has seen the ``train`` rows alone, the
    one that predicts the future all known rows.
    """
    features = [c for c in rows.columns if c.startswith("x")]
    batches = -(-num_trees // BATCH)
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        x = np.column_stack([table.column(f).to_numpy() for f in features])
        value, train = table.column("value").to_numpy(), table.column("train").to_numpy(zero_copy_only=False)
        known = ~np.isnan(value)
        batch = table.column("batch")[0].as_py()
        series = zlib.crc32(repr([table.column(k)[0].as_py() for k in keys]).encode())
        trees = min(BATCH, num_trees - batch * BATCH)
        out = np.zeros(len(value))
        for part, (seen, wanted) in enumerate(((train & known, known), (known, ~known))):
            drawn = np.random.default_rng([seed, series, batch, part]).multinomial(seen.sum(), np.full(seen.sum(), 1 / seen.sum()), trees)
            weights = np.zeros((trees, len(value)))
            weights[:, seen] = drawn
            bins = np.column_stack([binned(x[:, f], seen) for f in range(x.shape[1])])
            out[wanted] = grow(bins, np.where(known, value, 0.0), weights, depth)[wanted]
        return table.select([*keys, "t"]).append_column("s", pa.array(out))

    dealt = rows.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
    sums = dealt.groupBy(*keys, "batch").applyInArrow(one, (schema + ", " if schema else "") + "t long, s double")
    return sums.groupBy(*keys, "t").agg((F.sum("s") / num_trees).alias("p"))
