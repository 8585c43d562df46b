"""Profiling and structural quality (Q1-Q7).

Every report is a single aggregate over the data (plus the duplicate count,
which needs its own shuffle).  Constant-column detection uses min/max/count
instead of count_distinct, so it adds no Expand and no extra shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.exprs import np_round, is_numeric_type, is_temporal_type, is_text_type, kurt_corrected, skew_corrected
from ledgerlens.operators import ranking
from ledgerlens.operators._common import attach, dtypes, empty, q
from ledgerlens.session import cut_lineage, stored

PROFILE_SCHEMA = ("column STRING, type STRING, non_null BIGINT, nulls BIGINT, null_pct DOUBLE, unique BIGINT, "
                  "unique_pct DOUBLE, min DOUBLE, mean DOUBLE, max DOUBLE, std DOUBLE, sample STRING")


def _present(c: Column, dt: T.DataType) -> Column:
    """The value if it counts as present (pandas: NaN is missing)."""
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return F.nanvl(c, F.lit(None).cast(dt))
    return c


def numeric_columns(df: DataFrame) -> list[str]:
    """pandas is_numeric_dtype: numbers and booleans."""
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType, allow_bool=True)]


def number_columns(df: DataFrame) -> list[str]:
    """numpy ``number`` dtypes (what ``select_dtypes(include=np.number)`` keeps): booleans excluded."""
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]


def _as_double(c: str, dt: T.DataType) -> Column:
    return _present(F.col(c).cast("double"), T.DoubleType())


def duplicate_rows(df: DataFrame, exact: bool = False) -> DataFrame:
    """Q1: rows minus distinct rows (nulls equal), as a one-row frame.

    Default: group on a 64-bit row hash first (map-side combined, 8-byte key),
    then confirm only the colliding hashes exactly.  ``exact=True`` groups on
    all columns directly.
    """
    cols = [F.col(c) for c in df.columns]
    if exact or len(cols) == 1:
        return (df.groupBy(*cols).agg(F.count("*").alias("_n"))
                  .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_rows")))
    h = F.xxhash64(*cols, *[F.isnull(c) for c in cols])
    hashed = df.withColumn("_h", h)
    cand = hashed.groupBy("_h").agg(F.count("*").alias("_n")).where("_n > 1").select("_h")
    confirmed = (hashed.join(cand, "_h", "left_semi")
                 .groupBy("_h", *cols).agg(F.count("*").alias("_n")))
    return confirmed.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column index ``_ci``, value, ``_n``): how often each present value of each column occurs, in one shuffle.

    Each value goes into one typed slot of a narrow record -- integers and
    booleans as long ``_l``, floats as double ``_d``, the rest as text ``_s``
    -- so the shuffle carries 4 fields instead of Spark's distinct-rewrite
    Expand, which carries every column in every row.
    """
    types = dtypes(df)
    cols = columns or list(types)
    nl, nd, ns = F.lit(None).cast("long"), F.lit(None).cast("double"), F.lit(None).cast("string")
    ents = []
    for i, c in enumerate(cols):
        dt, x = types[c], F.col(q(c))
        if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
            slot = (x.cast("long"), nd, ns)
        elif isinstance(dt, (T.DoubleType, T.FloatType)):
            slot = (nl, _present(x, dt).cast("double"), ns)
        elif isinstance(dt, (T.ArrayType, T.MapType, T.StructType)):
            slot = (nl, nd, F.to_json(x))
        else:
            slot = (nl, nd, x.cast("string"))
        ents.append(F.when(_present(x, dt).isNotNull(), F.struct(
            F.lit(i).alias("_ci"), slot[0].alias("_l"), slot[1].alias("_d"), slot[2].alias("_s"))))
    pairs = df.select(F.explode(F.array(*ents)).alias("_p")).where(F.col("_p").isNotNull()).select("_p.*")
    return pairs.groupBy("_ci", "_l", "_d", "_s").agg(F.count("*").alias("_n"))


def distinct_counts(counts: DataFrame) -> DataFrame:
    """(``_ci``, ``unique``, ``_rows``) from :func:`value_counts`."""
    return counts.groupBy("_ci").agg(F.count("*").alias("unique"), F.sum("_n").alias("_rows"))


def _shape_aggs(df: DataFrame) -> list[Column]:
    out = [F.count("*").alias("_rows")]
    for i, (name, dt) in enumerate(dtypes(df).items()):
        c = _present(F.col(name), dt)
        out.append(F.count(c).alias(f"_nn{i}"))
        if not isinstance(dt, (T.MapType, T.ArrayType, T.StructType, T.BinaryType)):
            out += [F.min(c).alias(f"_mn{i}"), F.max(c).alias(f"_mx{i}")]
    return out


def _constant_flags(df: DataFrame) -> list[Column]:
    """nunique(dropna=False) <= 1: all null, or no null and min == max."""
    flags = []
    for i, (name, dt) in enumerate(dtypes(df).items()):
        nn, rows = F.col(f"_nn{i}"), F.col("_rows")
        if isinstance(dt, (T.MapType, T.ArrayType, T.StructType, T.BinaryType)):
            flags.append((nn == 0).cast("int"))
        else:
            flags.append(((nn == 0) | ((nn == rows) & (F.col(f"_mn{i}") == F.col(f"_mx{i}")))).cast("int"))
    return flags


def overview(df: DataFrame, exact_duplicates: bool = False) -> DataFrame:
    """Q2 + Q7: one-row structural overview with the 0-100 quality score."""
    types = dtypes(df)
    ncols = len(types)
    base = attach(df.agg(*_shape_aggs(df)), duplicate_rows(df, exact_duplicates))
    rows = F.col("_rows")
    missing = sum((rows - F.col(f"_nn{i}") for i in range(ncols)), F.lit(0))
    constant = sum(_constant_flags(df), F.lit(0))
    cells = F.greatest(rows * ncols, F.lit(1))
    base = base.select(
        rows.alias("rows"), F.lit(ncols).alias("columns"), F.col("duplicate_rows"),
        missing.cast("long").alias("missing_cells"),
        (missing / cells * 100).cast("double").alias("missing_pct"),
        F.lit(sum(1 for t in types.values() if is_numeric_type(t, allow_bool=True))).alias("numeric_cols"),
        F.lit(sum(1 for t in types.values() if is_text_type(t))).alias("text_cols"),
        constant.cast("int").alias("constant_cols"),
    )
    dup_pct = F.col("duplicate_rows") / F.greatest(F.col("rows"), F.lit(1)) * 100
    const_pct = F.col("constant_cols") / F.lit(max(ncols, 1)) * 100
    score = (F.lit(100.0) - F.least(F.col("missing_pct") * 1.5, F.lit(40.0))
             - F.least(dup_pct * 1.2, F.lit(25.0)) - F.least(const_pct * 0.3, F.lit(15.0)))
    return base.withColumn("quality_score", F.greatest(F.rint(score), F.lit(0.0)).cast("int"))


def quality_score(df: DataFrame) -> DataFrame:
    """Q7 alone (one row, one column)."""
    return overview(df).select("quality_score")


def column_profile(df: DataFrame, approx_unique: bool = False, top: int = 3) -> DataFrame:
    """Q3: one row per column; numeric stats rounded to 2, else the top-3 values."""
    types = dtypes(df)
    names = list(types)
    counts = value_counts(df, names)  # one shuffle feeds the distinct counts and the samples
    aggs = [F.count("*").alias("_rows")]
    for i, (name, dt) in enumerate(types.items()):
        c = _present(F.col(name), dt)
        aggs.append(F.count(c).alias(f"nn{i}"))
        if is_numeric_type(dt, allow_bool=True):
            d = _as_double(name, dt)
            aggs += [F.min(d).alias(f"mn{i}"), F.avg(d).alias(f"me{i}"), F.max(d).alias(f"mx{i}"),
                     F.stddev_samp(d).alias(f"sd{i}")]
    if approx_unique:
        uniq = df.agg(*[F.approx_count_distinct(_present(F.col(n), t)).alias(f"u{i}")
                        for i, (n, t) in enumerate(types.items())])
    else:
        uniq = distinct_counts(counts).agg(*[F.coalesce(F.max(F.when(F.col("_ci") == i, F.col("unique"))), F.lit(0)).alias(f"u{i}")
                                             for i in range(len(names))])
    wide = attach(df.agg(*aggs), uniq)
    nulld = F.lit(None).cast("double")
    entries = []
    for i, (name, dt) in enumerate(types.items()):
        isnum = is_numeric_type(dt, allow_bool=True)
        rows = F.col("_rows")
        r2 = (lambda col: np_round(col, 2)) if isnum else None
        entries.append(F.struct(
            F.lit(name).alias("column"), F.lit(dt.simpleString()).alias("type"),
            F.col(f"nn{i}").alias("non_null"), (rows - F.col(f"nn{i}")).alias("nulls"),
            np_round((rows - F.col(f"nn{i}")) / F.greatest(rows, F.lit(1)) * 100, 2).alias("null_pct"),
            F.col(f"u{i}").cast("long").alias("unique"),
            np_round(F.col(f"u{i}") / F.greatest(rows, F.lit(1)) * 100, 2).alias("unique_pct"),
            (r2(F.col(f"mn{i}")) if isnum else nulld).alias("min"),
            (r2(F.col(f"me{i}")) if isnum else nulld).alias("mean"),
            (r2(F.col(f"mx{i}")) if isnum else nulld).alias("max"),
            (r2(F.col(f"sd{i}")) if isnum else nulld).alias("std"),
        ))
    stats = wide.select(F.inline(F.array(*entries)))
    text = [n for n in names if not is_numeric_type(types[n], allow_bool=True)
            and not isinstance(types[n], (T.MapType, T.ArrayType, T.StructType, T.BinaryType))]
    if not text:
        return stats.withColumn("sample", F.lit(""))
    best = top_values(counts, top).groupBy("_ci").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_s"))), lambda s: s["_s"]), ", ").alias("_text"))
    position = F.array_position(F.lit(names), F.col("column")) - 1
    shown = F.when(F.col("column").isin(text), F.coalesce(F.col("_text"), F.lit(""))).otherwise(F.lit(""))
    return (stats.join(best, position == F.col("_ci"), "left").withColumn("sample", shown)
                 .select(*[c.split()[0] for c in PROFILE_SCHEMA.split(", ")]))


def top_values(counts: DataFrame, k: int = 3) -> DataFrame:
    """(``_ci``, rank, ``_s``, ``_n``): the k most frequent values per column of :func:`value_counts`, ties by text.

    Spark limits each task to its k best rows per column before the shuffle,
    so no task holds the values of a column.
    """
    w = Window.partitionBy("_ci").orderBy(F.desc("_n"), "_s", "_l", "_d")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def numeric_stats(df: DataFrame) -> DataFrame:
    """Q4: describe() + bias-corrected skew/kurtosis + zero count, rounded to 3 (booleans excluded).

    The numbers are stored when called, as their quantiles read them several times.
    """
    cols = number_columns(df)
    if not cols:
        return empty(df.sparkSession, "column STRING")
    types = dtypes(df)
    df = stored(df.select(*[F.col(q(c)) for c in cols]))
    aggs = []
    for i, c in enumerate(cols):
        d = _as_double(c, types[c])
        aggs += [F.count(d).alias(f"n{i}"), F.avg(d).alias(f"me{i}"), F.stddev_samp(d).alias(f"sd{i}"),
                 F.min(d).alias(f"mn{i}"),
                 F.max(d).alias(f"mx{i}"), skew_corrected(d).alias(f"sk{i}"), kurt_corrected(d).alias(f"ku{i}"),
                 F.count_if(d == 0).alias(f"z{i}")]
    qdf = df.select(*[_as_double(c, types[c]).alias(f"_c{i}") for i, c in enumerate(cols)])
    wide = attach(df.agg(*aggs), ranking.quantiles(qdf, [f"_c{i}" for i in range(len(cols))], [0.25, 0.5, 0.75]))
    for i in range(len(cols)):
        wide = wide.withColumn(f"p{i}", F.array(*[F.col(f"_c{i}_q{k}") for k in range(3)]))

    def r3(col):
        return np_round(F.nanvl(col.cast("double"), F.lit(None).cast("double")), 3)

    entries = [F.struct(
        F.lit(c).alias("column"), r3(F.col(f"n{i}")).alias("count"), r3(F.col(f"me{i}")).alias("mean"),
        r3(F.col(f"sd{i}")).alias("std"), r3(F.col(f"mn{i}")).alias("min"),
        r3(F.col(f"p{i}")[0]).alias("p25"), r3(F.col(f"p{i}")[1]).alias("p50"), r3(F.col(f"p{i}")[2]).alias("p75"),
        r3(F.col(f"mx{i}")).alias("max"), r3(F.col(f"sk{i}")).alias("skew"), r3(F.col(f"ku{i}")).alias("kurtosis"),
        r3(F.col(f"z{i}")).alias("zeros")) for i, c in enumerate(cols)]
    return wide.select(F.inline(F.array(*entries)))


def correlation_matrix(df: DataFrame) -> DataFrame:
    """Q5/H6: Pearson r for every ordered pair (pairwise complete), rounded to 3 (booleans excluded).

    Stores the numbers and runs one pass over them when called, however many columns there are: masked Gram matrices per
    batch, summed.
    For each pair the sums run over the rows that hold both columns.  Values are taken relative to one of their column's
    own, so that large values do not cancel.  A task keeps four matrices of columns by columns and hands on a row per
    column; those are added up by column.
    """
    cols = number_columns(df)
    if len(cols) < 2:
        return empty(df.sparkSession, "feature_a STRING, feature_b STRING, correlation DOUBLE")
    types, size = dtypes(df), len(cols)
    values = stored(df.select(*[_as_double(c, types[c]).alias(f"x{i}") for i, c in enumerate(cols)]))

    def any_of(rows, which):
        return rows.agg(*[F.first(f"x{i}", ignorenulls=True).alias(f"x{i}") for i in which]).first()

    shift = np.array([np.nan if v is None else v for v in any_of(values.limit(1000), range(size))])
    if np.isnan(shift).any():  # nothing near the beginning
        late = np.flatnonzero(np.isnan(shift)).tolist()
        shift[late] = [np.nan if v is None else v for v in any_of(values, late)]
    shift[~np.isfinite(shift)] = 0.0

    def gram(batches):
        sums = np.zeros((size, 4, size))
        for batch in batches:
            x = np.column_stack([np.asarray(c.fill_null(float("nan")), float) for c in batch.columns]) - shift
            there = ~np.isnan(x)
            x[~there] = 0.0
            mask = there.astype(float)
            with np.errstate(invalid="ignore"):
                for k, part in enumerate((mask.T @ mask, x.T @ mask, (x * x).T @ mask, x.T @ x)):
                    sums[:, k] += part  # of a row's values where the other column is there: how many, sum, squares; products
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([m.tobytes() for m in sums], pa.binary())],
                                         names=["a", "sums"])

    def added(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for a, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[a] = total.get(a, 0.0) + np.frombuffer(sums).reshape(4, size)
        for a, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([a] * size, pa.int32()), pa.array(range(size), pa.int32()), *map(pa.array, m)],
                                             names=["a", "b", "n", "s", "ss", "p"])

    cells = cut_lineage(values.mapInArrow(gram, "a int, sums binary").repartition("a")
                        .mapInArrow(added, "a int, b int, n double, s double, ss double, p double"))
    x, y = cells.alias("x"), cells.select("a", "b", "s", "ss").alias("y")
    spread = [F.col(f"{t}.ss") - F.try_divide(F.col(f"{t}.s") * F.col(f"{t}.s"), F.col("x.n")) for t in "xy"]
    known = (F.col("x.n") > 1) & (spread[0] > 1e-13 * F.col("x.ss")) & (spread[1] > 1e-13 * F.col("y.ss"))  # more than rounding
    r = F.when(known, F.try_divide(F.col("x.p") - F.try_divide(F.col("x.s") * F.col("y.s"), F.col("x.n")), F.sqrt(spread[0] * spread[1])))
    r = F.when(F.col("x.a") == F.col("x.b"), F.when(known, F.lit(1.0))).otherwise(F.nanvl(r, F.lit(None)))
    names = F.array(*map(F.lit, cols))
    return x.join(y, (F.col("x.a") == F.col("y.b")) & (F.col("x.b") == F.col("y.a"))).select(
        F.get(names, F.col("x.a")).alias("feature_a"), F.get(names, F.col("x.b")).alias("feature_b"), np_round(r, 3).alias("correlation"))


def strong_correlations(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Q5: upper-triangle pairs with |r| >= threshold (after rounding), by |r| desc."""
    cols = number_columns(df)
    order = {c: i for i, c in enumerate(cols)}
    m = correlation_matrix(df)
    if len(cols) < 2:
        return m
    idx = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(order[c]))])
    return (m.where(idx[F.col("feature_a")] < idx[F.col("feature_b")])
             .where(F.abs("correlation") >= threshold)
             .orderBy(F.abs("correlation").desc(), idx[F.col("feature_a")], idx[F.col("feature_b")]))


def missing_summary(df: DataFrame) -> DataFrame:
    """Q6: columns with nulls: (column, missing, missing_pct) by missing desc."""
    types = dtypes(df)
    wide = df.agg(F.count("*").alias("_rows"),
                  *[F.count(_present(F.col(c), t)).alias(f"nn{i}") for i, (c, t) in enumerate(types.items())])
    entries = [F.struct(F.lit(c).alias("column"), (F.col("_rows") - F.col(f"nn{i}")).alias("missing"))
               for i, c in enumerate(types)]
    out = wide.select(F.col("_rows"), F.inline(F.array(*entries)))
    return (out.where(F.col("missing") > 0)
               .select("column", "missing",
                       np_round(F.col("missing") / F.greatest(F.col("_rows"), F.lit(1)) * 100, 2).alias("missing_pct"))
               .orderBy(F.desc("missing"), "column"))
