"""Approximate nearest neighbours by stable projections, a kd-tree and a chi-square stopping test.

Vectors are projected on ``m`` Gaussian directions (a 2-stable projection), so
the squared projected distance of two vectors over their squared distance is
chi-square with ``m`` degrees of freedom.  The projections of each cell of
vectors are indexed by a kd-tree.  A query takes the tree's leaves in the order
of their projected distance and verifies their vectors exactly; it stops once
an unseen vector nearer than the k-th found would, with probability
``confidence``, have been projected nearer than the next leaf.

Cells hold about ``8 * sqrt(n)`` vectors, spread by a hash of the id, and every
query visits every cell: each task reads the vectors of a cell, builds its tree
and streams the queries, in batches, past it.  The k best of all cells are
merged per query.  Every vector is indexed; distances are exact, in double
precision, on the original vectors.

Defined results: vectors that are null, zero, empty, or hold a null or
non-finite component, and rows without an id, take no part; rows that repeat an
id are one vector (the least); only vectors of equal length are compared; ties
go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIRECTIONS = 8
CONFIDENCE = 0.99
LEAF = 32
SEED = 17


def chi_square_quantile(p: float, m: int) -> float:
    """The value that a chi-square variable with ``m`` degrees of freedom stays below with probability ``p``."""
    def below(x: float) -> float:  # lower incomplete gamma function, by its series
        term = total = 1 / (m / 2)
        n = 0
        while term > total * 1e-15:
            n += 1
            term *= (x / 2) / (m / 2 + n)
            total += term
        return total * math.exp(-x / 2 + (m / 2) * math.log(x / 2) - math.lgamma(m / 2))

    lo, hi = 1e-9, 10.0 * m + 200.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


def directions(dim: int, m: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, m))


class Cell:
    """The vectors of one cell with the kd-tree over their projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, m: int = DIRECTIONS, leaf: int = LEAF, seed: int = SEED):
        self.project = directions(vectors.shape[1], m, seed)
        low = vectors @ self.project
        parts, leaves = [np.arange(len(ids))], []
        while parts:  # halve at the median of the widest projection
            rows = parts.pop()
            if len(rows) <= leaf:
                leaves.append(rows)
                continue
            axis = int(np.ptp(low[rows], axis=0).argmax())
            half = len(rows) // 2
            order = np.argpartition(low[rows, axis], half)
            parts += [rows[order[half:]], rows[order[:half]]]
        order = np.concatenate(leaves)
        self.ids, self.vectors = ids[order], vectors[order]
        self.bounds = np.concatenate(([0], np.cumsum([len(x) for x in leaves])))
        self.lo = np.array([low[x].min(axis=0) for x in leaves])
        self.hi = np.array([low[x].max(axis=0) for x in leaves])

    def search(self, query: np.ndarray, own: int, k: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and squared distances of the ``k`` nearest found, nearest first; ``own`` is left out."""
        q = query @ self.project
        gap = np.maximum(0.0, np.maximum(self.lo - q, q - self.hi))
        far = (gap * gap).sum(axis=1)
        order = np.argsort(far, kind="stable")
        ids, dist = np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, 2
        while at < len(order):
            if len(ids) == k and far[order[at]] > limit * dist[-1]:
                break
            rows = np.concatenate([np.arange(self.bounds[x], self.bounds[x + 1]) for x in order[at: at + step]])
            at, step = at + step, min(2 * step, 16)
            diff = self.vectors[rows] - query
            new_ids, new = self.ids[rows], np.einsum("ij,ij->i", diff, diff)
            ok = new_ids != own
            ids, dist = np.concatenate([ids, new_ids[ok]]), np.concatenate([dist, new[ok]])
            best = np.lexsort((ids, dist))[:k]
            ids, dist = ids[best], dist[best]
        return ids, dist


def _searcher(k: int, m: int, limit: float, leaf: int, seed: int):
    def run(batches):
        now, held, cell = None, [], None  # the cell being read, its vectors so far, its tree
        for batch in batches:
            cells, kinds = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            ids = batch.column(2).to_numpy(zero_copy_only=False)
            lists = batch.column(3)
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            begin = np.concatenate(([0], np.cumsum(size)))
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            edges = np.flatnonzero((np.diff(cells) != 0) | (np.diff(kinds) != 0)) + 1
            out: list[np.ndarray] = []
            for a, b in zip([0, *edges], [*edges, len(cells)], strict=True):
                if a == b:
                    continue
                if cells[a] != now:
                    now, held, cell = cells[a], [], None
                block = flat[begin[a]: begin[b]].reshape(b - a, -1)
                if kinds[a] == 0:
                    held.append((ids[a:b], block))
                    continue
                if held:
                    cell = Cell(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]), m, leaf, seed)
                    held = []
                if cell is None:
                    continue
                for own, query in zip(ids[a:b].tolist(), block, strict=True):
                    near, dist = cell.search(query, own, k, limit)
                    out.append(np.rec.fromarrays([np.full(len(near), own), near, np.sqrt(dist)], names="q,v,s"))
            if out:
                rows = np.concatenate(out)
                yield pa.RecordBatch.from_arrays([pa.array(rows["q"]), pa.array(rows["v"]), pa.array(rows["s"])],
                                                 ["query_id", "vec_id", "score"])
    return run


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = F.expr("vec_id IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x)"
                  " AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)")
    return rows.where(good).groupBy("vec_id").agg(F.min("v").alias("v"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, m: int = DIRECTIONS, confidence: float = CONFIDENCE,
            leaf: int = LEAF, cells: int | None = None, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``queries``; both inputs are results of :func:`usable`."""
    n = cells or max(1, math.ceil(math.sqrt(vectors.count()) / 8))
    cell = F.size("v").cast("long") * n
    data = vectors.select((cell + F.pmod(F.xxhash64("vec_id"), F.lit(n))).alias("cell"), F.lit(0).alias("kind"),
                          F.col("vec_id").alias("id"), "v")
    asked = (queries.withColumn("spread", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
             .select((cell + F.col("spread")).alias("cell"), F.lit(1).alias("kind"), F.col("vec_id").alias("id"), "v"))
    laid = data.unionByName(asked).repartition(n, "cell").sortWithinPartitions("cell", "kind")
    found = laid.mapInArrow(_searcher(k, m, chi_square_quantile(confidence, m), leaf, seed),
                            "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
