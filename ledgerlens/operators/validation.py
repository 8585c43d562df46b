"""Business-rule validation (V1-V4): one fused aggregate, checks as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators._common import attach, dtypes, num, ts
from ledgerlens.operators.profiling import _present, duplicate_rows

CHECK_SCHEMA = "seq INT, name STRING, passed BOOLEAN, count BIGINT, severity STRING, description STRING"


def _rules(df: DataFrame, mapping: dict, as_of: Column) -> list[tuple[str, Column, str, str]]:
    """(name, predicate, severity, description) for the row-level checks that apply."""
    rev, profit, cost = mapping.get("revenue"), mapping.get("profit"), mapping.get("cost")
    qty, date = mapping.get("quantity"), mapping.get("date")
    rules = []  # fixed values: the names, severities and descriptions of the report
    if rev:
        rules.append(("Negative Revenue", num(df, rev) < 0, "critical", f"Rows where '{rev}' is negative."))
    if profit:
        rules.append(("Negative Profit", num(df, profit) < 0, "warning", f"Rows where '{profit}' is negative."))
    if qty:
        rules.append(("Invalid Quantity", num(df, qty) <= 0, "critical", f"Rows where '{qty}' is zero or negative."))
    if cost:
        rules.append(("Non-Positive Cost", num(df, cost) <= 0, "critical", f"Rows where '{cost}' is zero or negative."))
    if rev and cost:
        rules.append(("Selling Below Cost", num(df, rev) < num(df, cost), "critical",
                      f"Rows where '{rev}' is less than '{cost}'."))
    if date:
        rules.append(("Future-Dated Rows", ts(df, date) > as_of, "warning", f"Rows where '{date}' is after today."))
    return rules


def validate_dataset(df: DataFrame, mapping: dict, as_of=None) -> DataFrame:
    """V1: (seq, name, passed, count, severity, description); unmapped checks left out."""
    as_of_col = F.current_timestamp().cast("timestamp_ntz") if as_of is None else F.lit(as_of).cast("timestamp_ntz")
    rules = _rules(df, mapping, as_of_col)
    types = dtypes(df)
    missing = sum((F.count("*") - F.count(_present(F.col(c), t)) for c, t in types.items()), F.lit(0))
    wide = df.agg(missing.cast("long").alias("_missing"),
                  *[F.count_if(pred).alias(f"_r{i}") for i, (_, pred, _, _) in enumerate(rules)])
    wide = attach(wide, duplicate_rows(df))
    checks = [("Duplicate Rows", F.col("duplicate_rows"), "warning", "Exact duplicate rows in the dataset."),
              ("Missing Values", F.col("_missing"), "warning", "Empty cells across all columns.")]
    checks += [(name, F.col(f"_r{i}"), sev, desc) for i, (name, _, sev, desc) in enumerate(rules)]
    entries = [F.struct(F.lit(i).alias("seq"), F.lit(name).alias("name"), (cnt == 0).alias("passed"),
                        cnt.cast("long").alias("count"), F.lit(sev).alias("severity"), F.lit(desc).alias("description"))
               for i, (name, cnt, sev, desc) in enumerate(checks, start=1)]
    return wide.select(F.inline(F.array(*entries)))


def validation_score(checks: DataFrame) -> DataFrame:
    """V2 + V4: score = round(100 * passed / checks) (100 when none), failed and critical lists."""
    n = F.count("*")
    passed = F.count_if("passed")
    failed = F.filter(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.struct("seq", "name")))),
                      lambda x: x.isNotNull())
    return checks.agg(
        F.when(n == 0, F.lit(100.0)).otherwise(F.rint(passed / n * 100)).cast("int").alias("score"),
        n.alias("checks"), passed.alias("passed"),
        F.count_if(~F.col("passed") & (F.col("severity") == "critical")).alias("critical_failures"),
        F.array_join(F.transform(failed, lambda x: x["name"]), ", ").alias("failed_checks"),
    )


def invalid_rows(df: DataFrame, mapping: dict) -> DataFrame:
    """V3: offending rows with a ``check`` column (a row can fail several checks).

    Predicate checks take one scan (explode of the failed names).  Duplicates
    are found by a row hash first (8-byte key, combined map-side); only rows
    whose hash repeats are counted on all columns, and each group gives its row
    as often as it occurs.
    """
    rules = [r for r in _rules(df, mapping, F.lit(None)) if r[0] in
             ("Selling Below Cost", "Negative Revenue", "Negative Profit", "Invalid Quantity")]
    cols = df.columns
    parts = []
    if rules:
        names = F.filter(F.array(*[F.when(pred, F.lit(name)) for name, pred, _, _ in rules]), lambda x: x.isNotNull())
        parts.append(df.select(*cols, F.explode(names).alias("check")))
    h = F.xxhash64(*[F.col(c) for c in cols], *[F.isnull(c) for c in cols])
    hashed = df.withColumn("_h", h)
    again = hashed.groupBy("_h").agg(F.count("*").alias("_n")).where("_n > 1").select("_h")
    # rows with a repeated hash, counted exactly: only these are grouped on all columns
    same = (hashed.join(again, "_h", "left_semi").groupBy("_h", *cols).agg(F.count("*").alias("_n")).where("_n > 1"))
    copies = same.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    parts.append(copies.select(*cols, F.lit("Duplicate Rows").alias("check")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
