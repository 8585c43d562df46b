"""Column-expression helpers (all JVM-side built-ins, no Python UDFs)."""

from ledgerlens.functions.exprs import (  # noqa: F401
    as_number, as_timestamp, is_numeric_type, is_temporal_type, is_text_type,
    null_tokens_to_null, py_title, py_capitalize, squeeze_spaces, truthy,
    skew_corrected, kurt_corrected, sum0,
)
