"""Registered profiling / validation / ingest-check queries (Q, V, S10) over the defective fact."""

from __future__ import annotations

from itertools import combinations

from ledgerlens.operators import profiling, validation
from ledgerlens.plans.facts import (DIRTY_FACT_SQL, FACT_NUMBERS, FACT_NUMERIC, FACT_ROLES_WITH_PROFIT, FACT_SCHEMA,
                                    FACT_TEXT, dirty_fact)
from ledgerlens.plans.registry import register, rounded, sig
from ledgerlens.sources.checks import upload_findings

COLS = [c for c, _ in FACT_SCHEMA]
TYPES = dict(FACT_SCHEMA)


def with_dirty(body: str) -> str:
    return f"WITH d AS ({DIRTY_FACT_SQL})\n{body}"


def _dbl(c):
    return f"CAST({c} AS DOUBLE)"


_DUPS = f"(SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM d GROUP BY {', '.join(COLS)}) g)"
_MISSING = " + ".join(f"(count(*) - count({c}))" for c in COLS)
_CONST = " + ".join(f"CAST(count({c}) = 0 OR (count({c}) = count(*) AND min({c}) = max({c})) AS INTEGER)" for c in COLS)


@register("q1_duplicate_rows", with_dirty(f"SELECT * FROM {_DUPS} x"))
def q1_duplicate_rows(spark, sf_dir):
    return profiling.duplicate_rows(dirty_fact(spark, sf_dir))


_OVERVIEW_BODY = (f"""
, a AS (SELECT count(*) AS n_rows, {_MISSING} AS missing, {_CONST} AS constant_cols FROM d)
, b AS (SELECT a.*, x.duplicate_rows, missing / greatest(n_rows * {len(COLS)}, 1) * 100 AS missing_pct FROM a, {_DUPS} x)
SELECT n_rows AS rows, {len(COLS)} AS columns, duplicate_rows, CAST(missing AS BIGINT) AS missing_cells,
       {sig('missing_pct')} AS missing_pct, {len(FACT_NUMERIC)} AS numeric_cols, {len(FACT_TEXT)} AS text_cols,
       CAST(constant_cols AS INTEGER) AS constant_cols,
       CAST(greatest(round_even(100.0 - least(missing_pct * 1.5, 40.0)
              - least(duplicate_rows / greatest(n_rows, 1) * 100 * 1.2, 25.0)
              - least(constant_cols / {len(COLS)} * 100 * 0.3, 15.0), 0), 0.0) AS INTEGER) AS quality_score
FROM b""")
_OVERVIEW = with_dirty(_OVERVIEW_BODY)
_OV_CTES, _OV_SELECT = _OVERVIEW_BODY.rsplit("\nSELECT n_rows AS rows", 1)


@register("q2_overview", _OVERVIEW)
def q2_overview(spark, sf_dir):
    return rounded(profiling.overview(dirty_fact(spark, sf_dir)))


@register("q7_quality_score", with_dirty(
    _OV_CTES + "\n, o AS (SELECT n_rows AS rows" + _OV_SELECT + ")\nSELECT quality_score FROM o"))
def q7_quality_score(spark, sf_dir):
    return profiling.quality_score(dirty_fact(spark, sf_dir))


def _profile_sql():
    parts = []
    for c, t in FACT_SCHEMA:
        isnum = c in FACT_NUMERIC
        num = (lambda f: sig(f"round_even({f}({_dbl(c)}), 2)")) if isnum else (lambda f: "CAST(NULL AS DOUBLE)")
        std = sig(f"round_even(stddev_samp({_dbl(c)}), 2)") if isnum else "CAST(NULL AS DOUBLE)"
        if isnum:
            sample = "''"
        else:
            sample = (f"coalesce((SELECT string_agg(v, ', ' ORDER BY n DESC, v ASC) FROM (SELECT CAST({c} AS VARCHAR) AS v, "
                      f"count(*) AS n FROM d WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v ASC LIMIT 3) s), '')")
        parts.append(
            f"SELECT '{c}' AS column, '{t}' AS type, count({c}) AS non_null, count(*) - count({c}) AS nulls, "
            f"{sig(f'round_even((count(*) - count({c})) / greatest(count(*), 1) * 100, 2)')} AS null_pct, "
            f"count(DISTINCT {c}) AS unique, {sig(f'round_even(count(DISTINCT {c}) / greatest(count(*), 1) * 100, 2)')} AS unique_pct, "
            f"{num('min')} AS min, {num('avg')} AS mean, {num('max')} AS max, {std} AS std, {sample} AS sample FROM d")
    return with_dirty("\nUNION ALL\n".join(parts))


@register("q3_column_profile", _profile_sql())
def q3_column_profile(spark, sf_dir):
    return rounded(profiling.column_profile(dirty_fact(spark, sf_dir)))


def _stats_sql():
    parts = []
    for c in FACT_NUMBERS:
        x = _dbl(c)

        def r3(e):
            return sig(f"round_even({e}, 3)", 3)
        parts.append(
            f"SELECT '{c}' AS column, {r3(f'count({x})')} AS count, {r3(f'avg({x})')} AS mean, "
            f"{r3(f'stddev_samp({x})')} AS std, {r3(f'min({x})')} AS min, {r3(f'quantile_cont({x}, 0.25)')} AS p25, "
            f"{r3(f'quantile_cont({x}, 0.5)')} AS p50, {r3(f'quantile_cont({x}, 0.75)')} AS p75, "
            f"{r3(f'max({x})')} AS max, {r3(f'skewness({x})')} AS skew, {r3(f'kurtosis({x})')} AS kurtosis, "
            f"{r3(f'count_if({x} = 0)')} AS zeros FROM d")
    return with_dirty("\nUNION ALL\n".join(parts))


@register("q4_numeric_stats", _stats_sql())
def q4_numeric_stats(spark, sf_dir):
    return rounded(profiling.numeric_stats(dirty_fact(spark, sf_dir)), 3)


def _corr_sql(strong: float | None = None):
    parts = []
    idx = {c: i for i, c in enumerate(FACT_NUMBERS)}
    for a in FACT_NUMBERS:
        for b in FACT_NUMBERS:
            if a == b:
                v = f"CASE WHEN count({_dbl(a)}) > 1 AND stddev_samp({_dbl(a)}) > 0 THEN 1.0 END"
            else:
                v = f"corr({_dbl(a)}, {_dbl(b)})"
            parts.append(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {idx[a]} AS ia, {idx[b]} AS ib, "
                         f"round_even(CASE WHEN isnan({v}) THEN NULL ELSE {v} END, 3) AS correlation FROM d")
    u = "\nUNION ALL\n".join(parts)
    if strong is None:
        return with_dirty(f"SELECT feature_a, feature_b, {sig('correlation', 3)} AS correlation FROM ({u}) m")
    return with_dirty(f"SELECT feature_a, feature_b, {sig('correlation', 3)} AS correlation FROM ({u}) m "
                      f"WHERE ia < ib AND abs(correlation) >= {strong}")


@register("q5_correlation_matrix", _corr_sql())
def q5_correlation_matrix(spark, sf_dir):
    return rounded(profiling.correlation_matrix(dirty_fact(spark, sf_dir)), 3)


@register("q5_strong_pairs", _corr_sql(0.5))
def q5_strong_pairs(spark, sf_dir):
    return rounded(profiling.strong_correlations(dirty_fact(spark, sf_dir), 0.5), 3)


@register("h6_correlation_heatmap", _corr_sql())
def h6_correlation_heatmap(spark, sf_dir):
    # the heatmap data is the full matrix (threshold 0)
    return rounded(profiling.correlation_matrix(dirty_fact(spark, sf_dir)), 3)


@register("q6_missing_summary", with_dirty("SELECT * FROM (" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, count(*) - count({c}) AS missing, "
    f"{sig(f'round_even((count(*) - count({c})) / greatest(count(*), 1) * 100, 2)')} AS missing_pct FROM d"
    for c in COLS) + ") m WHERE missing > 0"))
def q6_missing_summary(spark, sf_dir):
    return rounded(profiling.missing_summary(dirty_fact(spark, sf_dir)))


def _checks_sql():
    rules = [
        ("Negative Revenue", "revenue < 0", "critical", "Rows where 'revenue' is negative."),
        ("Negative Profit", "profit < 0", "warning", "Rows where 'profit' is negative."),
        ("Invalid Quantity", "quantity <= 0", "critical", "Rows where 'quantity' is zero or negative."),
        ("Non-Positive Cost", "cost <= 0", "critical", "Rows where 'cost' is zero or negative."),
        ("Selling Below Cost", "revenue < cost", "critical", "Rows where 'revenue' is less than 'cost'."),
        ("Future-Dated Rows", "order_date > CAST(now() AS TIMESTAMP)", "warning", "Rows where 'order_date' is after today."),
    ]
    rows = [("Duplicate Rows", "x.duplicate_rows", "warning", "Exact duplicate rows in the dataset."),
            ("Missing Values", "a.missing", "warning", "Empty cells across all columns.")]
    rows += [(n, f"a.r{i}", s, d) for i, (n, _, s, d) in enumerate(rules)]
    agg = ", ".join([f"CAST({_MISSING} AS BIGINT) AS missing"] + [f"count_if({p}) AS r{i}" for i, (_, p, _, _) in enumerate(rules)])
    sel = "\nUNION ALL\n".join(
        f"SELECT {i} AS seq, '{n}' AS name, {v} = 0 AS passed, CAST({v} AS BIGINT) AS count, '{s}' AS severity, "
        f"'{d.replace(chr(39), chr(39) * 2)}' AS description FROM a, {_DUPS} x"
        for i, (n, v, s, d) in enumerate(rows, start=1))
    return f", a AS (SELECT {agg} FROM d)\n{sel}"


V1_BODY = _checks_sql()


@register("v1_validate_dataset", with_dirty(V1_BODY))
def v1_validate_dataset(spark, sf_dir):
    return validation.validate_dataset(dirty_fact(spark, sf_dir), FACT_ROLES_WITH_PROFIT)


_SCORE_BODY = (f"""{V1_BODY.replace(chr(10) + 'SELECT 1 AS seq', chr(10) + ', v AS (SELECT 1 AS seq', 1)})
, s AS (SELECT CAST(CASE WHEN count(*) = 0 THEN 100 ELSE round_even(count_if(passed) / count(*) * 100, 0) END AS INTEGER) AS score,
       count(*) AS checks, CAST(count_if(passed) AS BIGINT) AS passed,
       CAST(count_if(NOT passed AND severity = 'critical') AS BIGINT) AS critical_failures,
       coalesce(string_agg(CASE WHEN NOT passed THEN name END, ', ' ORDER BY seq), '') AS failed_checks
FROM v)
""")
_SCORE = with_dirty(_SCORE_BODY + "SELECT * FROM s")


@register("v2_validation_score", _SCORE)
def v2_validation_score(spark, sf_dir):
    return validation.validation_score(validation.validate_dataset(dirty_fact(spark, sf_dir), FACT_ROLES_WITH_PROFIT))


@register("v4_critical_failures", with_dirty(_SCORE_BODY + "SELECT critical_failures, passed, checks FROM s"))
def v4_critical_failures(spark, sf_dir):
    s = validation.validation_score(validation.validate_dataset(dirty_fact(spark, sf_dir), FACT_ROLES_WITH_PROFIT))
    return s.select("critical_failures", "passed", "checks")


_ALLC = ", ".join(COLS)


@register("v3_invalid_rows", with_dirty(f"""
SELECT {_ALLC}, 'Selling Below Cost' AS "check" FROM d WHERE revenue < cost
UNION ALL SELECT {_ALLC}, 'Negative Revenue' FROM d WHERE revenue < 0
UNION ALL SELECT {_ALLC}, 'Negative Profit' FROM d WHERE profit < 0
UNION ALL SELECT {_ALLC}, 'Invalid Quantity' FROM d WHERE quantity <= 0
UNION ALL SELECT {_ALLC}, 'Duplicate Rows' FROM (SELECT *, count(*) OVER (PARTITION BY {_ALLC}) AS n FROM d) w WHERE n > 1
"""))
def v3_invalid_rows(spark, sf_dir):
    return validation.invalid_rows(dirty_fact(spark, sf_dir), FACT_ROLES_WITH_PROFIT)


def _findings_sql():
    n = len(COLS)
    np_expr = "(" + " + ".join(f"(1 - count({c}) / count(*))" for c in COLS) + f") / {n} * 100"
    const_list = "list_filter([" + ", ".join(
        f"CASE WHEN count({c}) = 0 OR (count({c}) = count(*) AND min({c}) = max({c})) THEN '{c}' END" for c in COLS) + "], lambda x: x IS NOT NULL)"
    return with_dirty(f"""
, a AS (SELECT count(*) AS n_rows, {np_expr} AS np, {const_list} AS consts FROM d)
, b AS (SELECT a.*, x.duplicate_rows FROM a, {_DUPS} x)
SELECT 1 AS seq, 'ok' AS level, 'Loaded ' || format('{{:,}}', n_rows) || ' rows x {n} columns.' AS message FROM b WHERE n_rows > 0
UNION ALL SELECT 3, 'warn', format('{{:,}}', duplicate_rows) || ' duplicate row(s) found.' FROM b WHERE duplicate_rows > 0 AND n_rows > 0
UNION ALL SELECT 4, 'warn', 'High missingness: ' || printf('%.1f', np) || '% of all cells are empty.' FROM b WHERE np > 20 AND n_rows > 0
UNION ALL SELECT 4, 'ok', 'Missing values: ' || printf('%.1f', np) || '% of cells.' FROM b WHERE np > 0 AND np <= 20 AND n_rows > 0
UNION ALL SELECT 5, 'warn', CAST(len(consts) AS VARCHAR) || ' constant column(s): ' || array_to_string(consts[1:5], ', ') FROM b WHERE len(consts) > 0 AND n_rows > 0
UNION ALL SELECT 0, 'error', 'Dataset contains 0 rows.' FROM b WHERE n_rows = 0
""")


@register("s10_upload_findings", _findings_sql())
def s10_upload_findings(spark, sf_dir):
    return upload_findings(dirty_fact(spark, sf_dir))
