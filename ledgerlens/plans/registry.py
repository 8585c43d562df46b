"""Registered queries: name -> (spark builder, DuckDB oracle SQL or None).

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
driver tables.  The oracle SQL runs on DuckDB with the same tables registered
as views; ``None`` marks an operator without an SQL equivalent (models,
sources, sinks), which gets a rows/schema check only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.exprs import np_round
from ledgerlens.plans.facts import ORDERS_FACT_SQL, EVENTS_FACT_SQL

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def with_fact(body: str) -> str:
    """Prefix a query with the orders_fact CTE ``f``."""
    return f"WITH f AS ({ORDERS_FACT_SQL})\n{body}"


def with_events(body: str) -> str:
    return f"WITH e AS ({EVENTS_FACT_SQL})\n{body}"


DIGITS = 2


def sig(expr: str, digits: int = DIGITS) -> str:
    """The DuckDB spelling of :func:`rounded` for one expression."""
    return np_round_sql(expr, digits)


def np_round_sql(expr: str, digits: int) -> str:
    """DuckDB spelling of :func:`ledgerlens.functions.exprs.np_round` (binary half-even)."""
    p = f"CAST({10 ** digits} AS DOUBLE)"
    return f"(round_even(CAST(({expr}) AS DOUBLE) * {p}, 0) / {p})"


def rounded(df: DataFrame, digits: int = DIGITS, **fine: int) -> DataFrame:
    """Round every DOUBLE column half-even on the binary value (numpy ``round``); ``fine`` has other digits per column.

    Money is in cents, so a double sum sits on the cent grid up to noise far
    below half a cent and rounds identically whatever the order of addition.
    Values without a unit (scores, shares, coefficients) take more digits.
    """
    return df.select(*[np_round(F.col(f.name), fine.get(f.name, digits)).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                       else F.col(f.name) for f in df.schema.fields])


def load_all() -> dict[str, tuple[Callable, str | None]]:
    # importing the suites fills REGISTRY
    from ledgerlens.plans import (  # noqa: F401
        suite_kpis,
        suite_quality,
        suite_cleaning,
        suite_reshape,
        suite_customers,
        suite_forecast,
        suite_insights,
        suite_sources,
        suite_roles,
    )
    return REGISTRY
