"""Findings for a freshly loaded table as (seq, level, message) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators._common import attach, dtypes
from ledgerlens.operators.profiling import _constant_flags, _shape_aggs, duplicate_rows


def _fmt_int(c):
    return F.format_number(c.cast("long"), 0)


def _row(seq, level, message, keep):
    return F.struct(F.lit(seq).alias("seq"), F.lit(level).alias("level"), message.alias("message"), keep.alias("keep"))


def upload_findings(df: DataFrame) -> DataFrame:
    types = dtypes(df)
    names = list(types)
    base = attach(df.agg(*_shape_aggs(df)), duplicate_rows(df))
    rows = F.col("_rows")
    null_pct = sum((1 - F.try_divide(F.col(f"_nn{i}"), rows) for i in range(len(names))), F.lit(0.0)) / max(len(names), 1) * 100
    flags = _constant_flags(df)
    const_names = F.filter(F.array(*[F.when(f == 1, F.lit(n)) for f, n in zip(flags, names)]), lambda x: x.isNotNull())
    unnamed = [n for n in names if str(n).startswith("Unnamed")]
    loaded = F.concat(F.lit("Loaded "), _fmt_int(rows), F.lit(" rows x "), F.lit(str(len(names))), F.lit(" columns."))
    entries = [  # fixed values: the texts of the findings
        _row(1, "ok", loaded, rows > 0),
        _row(2, "warn",
                 F.lit(f"{len(unnamed)} unnamed column(s) detected — consider renaming or dropping."),
                 F.lit(bool(unnamed)) & (rows > 0)),
        _row(3, "warn",
                 F.concat(_fmt_int(F.col("duplicate_rows")), F.lit(" duplicate row(s) found.")),
                 (F.col("duplicate_rows") > 0) & (rows > 0)),
        _row(4, "warn",
                 F.concat(F.lit("High missingness: "), F.format_number(F.col("_np"), 1), F.lit("% of all cells are empty.")),
                 (F.col("_np") > 20) & (rows > 0)),
        _row(4, "ok",
                 F.concat(F.lit("Missing values: "), F.format_number(F.col("_np"), 1), F.lit("% of cells.")),
                 (F.col("_np") > 0) & (F.col("_np") <= 20) & (rows > 0)),
        _row(5, "warn",
                 F.concat(F.size(F.col("_const")).cast("string"), F.lit(" constant column(s): "),
                          F.array_join(F.slice(F.col("_const"), 1, 5), ", ")),
                 (F.size(F.col("_const")) > 0) & (rows > 0)),
        _row(0, "error", F.lit("Dataset contains 0 rows."), rows == 0),
    ]
    out = base.select(rows, F.col("duplicate_rows"), null_pct.alias("_np"), const_names.alias("_const"),
                      *[F.col(f"_nn{i}") for i in range(len(names))])
    return (out.select(F.inline(F.array(*entries)))
               .where("keep").drop("keep"))
