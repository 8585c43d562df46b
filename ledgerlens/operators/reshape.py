"""Reshape, join and feature columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.exprs import as_number, as_timestamp
from ledgerlens.operators import ranking
from ledgerlens.operators._common import AGG_FUNCS, agg_expr, attach, dtypes, q
from ledgerlens.operators.cleaning import _as_text
from ledgerlens.operators.profiling import _present
from ledgerlens.session import cut_lineage, stored

#: Rows of a key (both sides) below which it is not worth salting.
LEAST_HOT = 100_000
#: Different values of a column, whose codes are sent to every task; with more, rows are shuffled for them.
CODES = 500_000


def with_medians(out: DataFrame, rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``out`` (one row per ``keys``) with the exact median of ``value`` over ``rows``."""
    med = ranking.grouped_quantiles(rows, keys, value, [0.5]).select(
        *[F.col(q(k)).alias(f"_mk{i}") for i, k in enumerate(keys)], F.col("q0").alias(name))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(q(k)).eqNullSafe(F.col(f"_mk{i}"))
    return out.join(med, on, "left").drop(*[f"_mk{i}" for i in range(len(keys))])


def group_and_aggregate(df: DataFrame, group_cols: Sequence[str], agg_map: dict[str, str]) -> DataFrame:
    """``groupBy(...).agg`` with pandas names ``<col>_<fn>``; the null group is kept.

    Medians come from :func:`ranking.grouped_quantiles`, so no task holds all values of a group.
    """
    types = dtypes(df)
    unknown = [fn for fn in agg_map.values() if fn not in AGG_FUNCS]
    if unknown:
        raise ValueError(f"aggregation must be one of {AGG_FUNCS}")
    present = {c: _present(F.col(q(c)), types[c]) for c in agg_map}
    plain = [agg_expr(fn, present[c]).alias(f"{c}_{fn}") for c, fn in agg_map.items() if fn != "median"]
    out = df.groupBy(*group_cols).agg(*plain) if plain else df.select(*group_cols).distinct()
    for c in (c for c, fn in agg_map.items() if fn == "median"):
        out = with_medians(out, df.select(*group_cols, present[c].alias("_md")), list(group_cols), "_md", f"{c}_median")
    return out.select(*group_cols, *[f"{c}_{fn}" for c, fn in agg_map.items()])


def _sorted_values(df: DataFrame, column: str) -> list:
    """Every non-null value of a column, sorted; it names the output columns of a wide form."""
    return [r[0] for r in df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column).collect()]


def pivot_long(df: DataFrame, index: str, columns: str, values: str, aggfunc: str = "sum") -> DataFrame:
    """T2, long form: (index, header, value) for the cells that have rows; no limit on the number of headers."""
    fn = {"sum": F.sum, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max}[aggfunc]
    v = _present(F.col(values), dtypes(df)[values])
    return (df.where(F.col(index).isNotNull() & F.col(columns).isNotNull())
            .groupBy(F.col(index), F.col(columns).cast("string").alias("header")).agg(fn(v).alias("value")))


def pivot(df: DataFrame, index: str, columns: str, values: str, aggfunc: str = "sum",
          column_values: Sequence | None = None) -> DataFrame:
    """Pivot table; empty cells 0, null index / header values dropped, headers sorted.

    The wide form has a column per header (given, or all that occur); :func:`pivot_long`
    is the form for a column with very many values.
    """
    fn = {"sum": F.sum, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max}[aggfunc]
    vals = sorted(column_values) if column_values is not None else _sorted_values(df, columns)
    v = _present(F.col(values), dtypes(df)[values])
    rows = df.where(F.col(index).isNotNull() & F.col(columns).isNotNull())
    cells = rows.groupBy(index, columns).agg(fn(v).alias("_cell"))  # one row per cell, combined before the wide form
    out = cells.groupBy(index).agg(*[F.max(F.when(F.col(columns) == F.lit(x), F.col("_cell"))).alias(str(x)) for x in vals])
    return out.na.fill(0, subset=[str(x) for x in vals]) if vals else out


def merge_datasets(left: DataFrame, right: DataFrame, on: Sequence[str] | str, how: str = "inner") -> DataFrame:
    """Equi-join on shared columns; null keys match null keys; clashes get _x/_y.

    ``<=>`` stays an equi-join (Spark plans it on (coalesce(k), isnull(k)))
    so Catalyst/AQE still choose broadcast or sort-merge and split skewed keys; a full outer
    join salts its hot keys itself.
    As in pandas, n null keys on one side and m on the other give n * m rows.
    """
    keys = [on] if isinstance(on, str) else list(on)
    how = {"outer": "full_outer", "full": "full_outer"}.get(how, how)
    lcols = [c for c in left.columns if c not in keys]
    rcols = [c for c in right.columns if c not in keys]
    clash = set(lcols) & set(rcols)
    l = left.select(*[F.col(k).alias(f"_lk{i}") for i, k in enumerate(keys)],
                    *[F.col(c).alias(f"{c}_x" if c in clash else c) for c in lcols])
    r = right.select(*[F.col(k).alias(f"_rk{i}") for i, k in enumerate(keys)],
                     *[F.col(c).alias(f"{c}_y" if c in clash else c) for c in rcols])
    cond = None
    for i in range(len(keys)):
        e = F.col(f"_lk{i}").eqNullSafe(F.col(f"_rk{i}"))
        cond = e if cond is None else cond & e
    if how == "full_outer":
        j = _salted_outer(l, r, len(keys), cond)
    else:
        j = l.join(r, cond, how)
    if how == "right":
        key_out = [F.col(f"_rk{i}").alias(k) for i, k in enumerate(keys)]
    elif how == "full_outer":
        key_out = [F.coalesce(F.col(f"_lk{i}"), F.col(f"_rk{i}")).alias(k) for i, k in enumerate(keys)]
    else:
        key_out = [F.col(f"_lk{i}").alias(k) for i, k in enumerate(keys)]
    # pandas keeps the key columns where they stood in the left frame
    out_cols = []
    ki = {k: key_out[i] for i, k in enumerate(keys)}
    for c in left.columns:
        out_cols.append(ki[c] if c in ki else F.col(f"{c}_x" if c in clash else c))
    out_cols += [F.col(f"{c}_y" if c in clash else c) for c in rcols]
    return j.select(*out_cols)


def _salted_outer(l: DataFrame, r: DataFrame, n_keys: int, cond: Column) -> DataFrame:
    """Full outer join on (``_lk*`` <=> ``_rk*``); adaptive execution does not split such a join, so hot keys are salted.

    One count over the keys of both sides names the keys with more than a task's share of the rows (fewer than four per
    task; stored, so that its size is known).  Left rows of such a key are dealt to as many salts as its rows fill shares,
    by a hash of the row; right rows go to each salt.  A copy of a right row that meets no left row in its salt is dropped
    where the key has left rows, as it meets them in another.
    """
    def names(prefix):
        return [f"{prefix}{i}" for i in range(n_keys)]

    both = (l.select(*[F.col(a).alias(k) for a, k in zip(names("_lk"), names("_hk"), strict=True)], F.lit(1).alias("l"), F.lit(0).alias("r"))
            .unionByName(r.select(*[F.col(a).alias(k) for a, k in zip(names("_rk"), names("_hk"), strict=True)], F.lit(0).alias("l"), F.lit(1).alias("r"))))
    counts = cut_lineage(both.groupBy(*names("_hk")).agg(F.sum("l").alias("_hl"), F.sum(F.col("l") + F.col("r")).alias("_hn")))
    tasks = max(1, int(l.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    share = F.ceil(F.col("_all") / (4 * tasks))
    hot = cut_lineage(attach(counts, counts.agg(F.sum("_hn").alias("_all"))).where(F.col("_hn") > F.greatest(share, F.lit(LEAST_HOT)))
                      .select(*names("_hk"), F.ceil(F.col("_hn") / share).cast("int").alias("_salts"), (F.col("_hl") > 0).alias("_meets")))

    def with_hot(side, prefix):
        on = F.lit(True)
        for a, k in zip(names(prefix), names("_hk"), strict=True):
            on = on & F.col(a).eqNullSafe(F.col(k))
        return side.join(F.broadcast(hot), on, "left")

    salt = F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*[F.col(q(c)) for c in l.columns]), F.col("_salts")).cast("int"))
    left = with_hot(l, "_lk").withColumn("_ls", salt).withColumn("_there", F.lit(True)).drop(*names("_hk"), "_salts", "_meets")
    copies = F.when(F.col("_meets"), F.sequence(F.lit(0), F.col("_salts") - 1)).otherwise(F.array(F.lit(0)))
    right = (with_hot(r, "_rk").withColumn("_rs", F.explode(copies)).withColumn("_must", F.coalesce("_meets", F.lit(False)))
             .drop(*names("_hk"), "_salts", "_meets"))
    joined = left.join(right, cond & (F.col("_ls") == F.col("_rs")), "full_outer")
    return joined.where(F.col("_there").isNotNull() | ~F.col("_must")).drop("_ls", "_rs", "_there", "_must")


def split_column(df: DataFrame, column: str, delimiter: str = " ", new_names: Sequence[str] | None = None,
                 width: int | None = None) -> DataFrame:
    """Split text into ``<col>_1..n`` (width = most parts, measured unless given)."""
    dt = dtypes(df)[column]
    missing = "nan" if isinstance(dt, (T.FloatType, T.DoubleType)) else "None"
    text = F.coalesce(_as_text(F.col(column), dt), F.lit(missing))
    pattern = re.escape(delimiter) if len(delimiter) == 1 else delimiter
    parts = F.split(text, pattern)
    if width is None:
        width = int(df.agg(F.max(F.size(parts))).first()[0] or 0)
    names = list(new_names) if new_names else [f"{column}_{i + 1}" for i in range(width)]
    if len(names) < width:
        raise ValueError(f"{width} parts but only {len(names)} names")
    return df.withColumns({names[i]: F.get(parts, i) for i in range(width)})


def add_date_parts(df: DataFrame, date_col: str) -> DataFrame:
    """T4: year, month, month name, quarter, weekday name, is_weekend (Sat/Sun)."""
    d = as_timestamp(F.col(date_col), dtypes(df)[date_col])
    return df.withColumns({
        f"{date_col}_year": F.year(d), f"{date_col}_month": F.month(d),
        f"{date_col}_month_name": F.date_format(d, "MMMM"), f"{date_col}_quarter": F.quarter(d),
        f"{date_col}_weekday": F.date_format(d, "EEEE"),
        f"{date_col}_is_weekend": F.coalesce(F.weekday(d).isin(5, 6), F.lit(False)),
    })


def bin_column(df: DataFrame, column: str, bins: int = 5, labels: Sequence[str] | None = None) -> DataFrame:
    """T5: equal-width, right-closed bins over min..max (1-based bin number or label).

    A constant column falls into the middle bin.  Not ``width_bucket``
    (left-closed, max -> bins + 1).
    """
    x = as_number(F.col(column), dtypes(df)[column])
    stats = df.agg(F.min(x).alias("_bmin"), F.max(x).alias("_bmax"))
    j = attach(df, stats)
    w = (F.col("_bmax") - F.col("_bmin")) / bins
    idx = F.when(x.isNull(), None).when(w == 0, F.lit((bins + 1) // 2)).otherwise(
        F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil((x - F.col("_bmin")) / w).cast("int"))))
    out = F.element_at(F.array(*[F.lit(s) for s in labels]), idx) if labels else idx.cast("int")
    return j.withColumn(f"{column}_bin", out).drop("_bmin", "_bmax")


def normalize_column(df: DataFrame, column: str, method: str = "minmax") -> DataFrame:
    """Min-max or z-score; zero span / zero std divide by 1."""
    x = as_number(F.col(column), dtypes(df)[column])
    if method == "zscore":
        stats = df.agg(F.avg(x).alias("_a"), F.stddev_samp(x).alias("_b"))
        expr = (x - F.col("_a")) / F.when(F.col("_b") == 0, F.lit(1.0)).otherwise(F.col("_b"))
    else:
        stats = df.agg(F.min(x).alias("_a"), (F.max(x) - F.min(x)).alias("_b"))
        expr = (x - F.col("_a")) / F.when(F.col("_b") == 0, F.lit(1.0)).otherwise(F.col("_b"))
    return attach(df, stats).withColumn(f"{column}_norm", expr).drop("_a", "_b")


def create_calculated_column(df: DataFrame, name: str, expression: str) -> DataFrame:
    """A Spark SQL expression over the columns (division by zero -> use try_divide)."""
    return df.withColumn(name, F.expr(expression))


def one_hot(df: DataFrame, column: str, values: Sequence | None = None) -> DataFrame:
    """One boolean column ``<col>_<value>`` per non-null value (given, or all, sorted); null -> all false."""
    vals = sorted(values) if values is not None else _sorted_values(df, column)
    return df.select("*", *[F.coalesce(F.col(column) == F.lit(v), F.lit(False)).alias(f"{column}_{v}") for v in vals])


def label_encode(df: DataFrame, column: str, order_by: Sequence[str]) -> DataFrame:
    """Codes in order of first appearance (by ``order_by``), null -> -1.  Stores the rows, and each value's first place, when called."""
    df = stored(df)
    known, lead = df.where(F.col(column).isNotNull()), F.col(order_by[0])
    # a value's first row is among those with its least (or no) first order column; by whole keys, all rows would have to be sorted
    least = cut_lineage(known.groupBy(F.col(column).alias("_le_v")).agg(F.min(lead).alias("_le_lead")))
    few = least.count() <= CODES
    on = (F.col(column) == F.col("_le_v")) & (lead.isNull() | lead.eqNullSafe(F.col("_le_lead")))
    known = known.join(F.broadcast(least) if few else least, on, "left_semi")
    first = cut_lineage(known.groupBy(F.col(column).alias("_le_v"))
                        .agg(F.min(F.struct(*[F.col(c).alias(f"_le_o{i}") for i, c in enumerate(order_by)])).alias("_le_first"))
                        .select("_le_v", "_le_first.*"))
    codes = ranking.row_number(first, [*[f"_le_o{i}" for i in range(len(order_by))], "_le_v"], out="_le_rn").select(
        "_le_v", (F.col("_le_rn") - 1).alias("_le_code"))
    codes = F.broadcast(codes) if few else codes
    j = df.join(codes, df[column] == codes["_le_v"], "left")
    return j.withColumn(f"{column}_encoded", F.coalesce(F.col("_le_code"), F.lit(-1)).cast("long")).drop("_le_v", "_le_code")


def encode_categorical(df: DataFrame, column: str, method: str = "onehot", order_by: Sequence[str] | None = None):
    if method == "onehot":
        return one_hot(df, column)
    if not order_by:
        raise ValueError("label encoding needs order_by (first appearance)")
    return label_encode(df, column, order_by)
