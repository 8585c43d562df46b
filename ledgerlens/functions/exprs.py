"""Reusable Spark column expressions with pandas-compatible semantics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions import dates

# Text tokens that pandas' astype(str) produces for missing values.
NULL_TEXT_TOKENS = ("nan", "None")
# Text treated as true by the generic boolean conversion and by
# the return-to-origin flag (the latter has no "t").
BOOL_TRUE_TOKENS = ("1", "true", "yes", "y", "t")
RTO_TRUE_TOKENS = ("1", "true", "yes", "y")


def is_numeric_type(dt: T.DataType, allow_bool: bool = False) -> bool:
    if isinstance(dt, T.BooleanType):
        return allow_bool
    return isinstance(dt, T.NumericType)


def is_temporal_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_text_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))


#: What counts as a number in text: no type suffixes (``12D``), no hexadecimal forms.
NUMBER_TEXT = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"


def as_number(c: str | Column, dt: T.DataType | None = None) -> Column:
    """pandas ``to_numeric(errors='coerce')``: junk -> NULL, NaN -> NULL, as DOUBLE."""
    col = F.col(c) if isinstance(c, str) else c
    if dt is not None and is_numeric_type(dt, allow_bool=True):
        out = col.cast("double")
    else:
        text = col.cast("string")
        out = F.when(text.rlike(NUMBER_TEXT), text.try_cast("double"))
    return F.nanvl(out, F.lit(None).cast("double"))


def as_timestamp(c: str | Column, dt: T.DataType | None = None, formats: Sequence[str] | None = None) -> Column:
    """pandas ``to_datetime(errors='coerce', format='mixed')``; ``formats`` (Spark patterns, in order) replace the usual shapes."""
    col = F.col(c) if isinstance(c, str) else c
    if isinstance(dt, T.TimestampNTZType):
        return col
    if isinstance(dt, (T.TimestampType, T.DateType)):
        return col.cast("timestamp_ntz")
    text = col.cast("string")
    if not formats:
        return dates.parse(text)
    tries = [F.try_to_timestamp(F.trim(text), F.lit(f)) for f in formats]
    return F.coalesce(*[t.cast("timestamp_ntz") for t in tries], dates.parse(text))


def null_tokens_to_null(c: Column) -> Column:
    return F.when(c.isin(*NULL_TEXT_TOKENS), F.lit(None).cast("string")).otherwise(c)


def py_title(c: Column) -> Column:
    """Python ``str.title``: a word starts after any non-letter."""
    parts = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    cased = F.transform(parts, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substring(x, 2, 1 << 30))))
    return F.when(c.isNull(), None).otherwise(F.array_join(cased, ""))


def py_capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, 2, 1 << 30)))


def squeeze_spaces(c: Column) -> Column:
    """strip + collapse inner whitespace runs (tabs, newlines and Unicode spaces included)."""
    odd = c.rlike(r"[^ -~]|  |^ | $")  # no other text has anything to squeeze; the Unicode pattern is slow
    return F.when(odd, F.trim(F.regexp_replace(c, r"(?U)\s+", " "))).otherwise(c)


def truthy(c: Column, tokens=BOOL_TRUE_TOKENS) -> Column:
    return F.coalesce(F.lower(c.cast("string")).isin(*tokens), F.lit(False))


def sum0(c: Column) -> Column:
    """pandas sum: all-null / empty -> 0."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def skew_corrected(c: Column) -> Column:
    """Bias-corrected sample skewness (pandas ``skew``); NULL for n < 3."""
    n = F.count(c).cast("double")
    g1 = F.skewness(c)
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def kurt_corrected(c: Column) -> Column:
    """Bias-corrected excess kurtosis (pandas ``kurt``); NULL for n < 4."""
    n = F.count(c).cast("double")
    g2 = F.kurtosis(c)
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def np_round(c: Column, digits: int) -> Column:
    """numpy/pandas ``round(digits)``: half-to-even on the binary value (rint(x*10^d)/10^d)."""
    p = float(10 ** digits)
    return F.rint(c * p) / p
