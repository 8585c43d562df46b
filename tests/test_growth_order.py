"""Label codes: rows are neither shuffled for a few codes nor sorted to find a value's first one."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import reshape

ROWS = [(k, t, 1.0, v) for k, t, v in
        [(None, 3, "b"), (None, 1, "a"), (1, 2, None), (1, 1, "c"), (1, 1, "a"), (2, None, "d"), (2, 5, "c"), (3, 4, "e"), (3, 4, "e"), (float("nan"), 1, "f")]]


def _first(rows):
    """Codes by first appearance in order of (k, t), nulls first, NaN last, then by value."""
    def place(x):
        return (0, 0) if x is None else (2, 0) if x != x else (1, x)
    out = {}
    for k, t, _, v in sorted(rows, key=lambda r: (place(r[0]), place(r[1]), r[3] or "")):
        if v is not None:
            out.setdefault(v, len(out))
    return out


@pytest.mark.parametrize("few", [True, False])
def test_codes_follow_the_first_appearance(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(reshape, "CODES", 0)
    rows = [tuple(float(x) if i == 0 and x is not None else x for i, x in enumerate(r)) for r in ROWS]
    df = spark.createDataFrame(rows, "k double, t int, w double, v string").repartition(3)
    got = reshape.label_encode(df, "v", ["k", "t"])
    want = _first(rows) | {None: -1}
    assert sorted((r["v"] or "", r["v_encoded"]) for r in got.collect()) == sorted((r[3] or "", want[r[3]]) for r in rows)


def test_rows_are_not_shuffled_for_a_few_codes(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(1000).select("id", F.concat(F.lit("v"), (F.col("id") % 7).cast("string")).alias("v"))
        plan = reshape.label_encode(df, "v", ["id"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
