"""What grows with the tables: shuffles of the fact."""

import datetime as dt
import re
from collections import Counter

import duckdb
import pytest

from ledgerlens.plans import facts
from ledgerlens.plans.facts import ORDERS_FACT_SQL, orders_fact


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Small tables with null keys, repeated keys and lines without a partner."""
    at = str(tmp_path_factory.mktemp("tables"))
    day = dt.datetime
    rows = {
        "nation": ("n_nationkey int, n_name string", [(0, "NATION_0"), (1, "NATION_1")]),
        "customer": ("c_custkey long, c_nationkey int", [(1, 0), (2, 1), (3, None), (4, 9)]),
        "supplier": ("s_suppkey long, s_name string", [(1, "S1"), (2, None), (2, "S2 again")]),
        "part": ("p_partkey long, p_name string, p_brand string, p_retailprice double",
                 [(1, "bolt", "B1", 10.05), (2, "ring", None, None), (2, "ring two", "B2", 3.335), (None, "none", "B0", 1.0)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderpriority string",
                   [(1, 1, day(2024, 1, 1, 23), "1-URGENT"), (2, 2, None, "2-HIGH"), (3, 3, day(2024, 1, 2), None), (4, 4, day(2024, 1, 3), "x"),
                    (2, 1, day(2024, 2, 1), "3-LOW"), (None, 1, day(2024, 2, 1), "3-LOW")]),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, "
                     "l_returnflag string, l_shipdate timestamp_ntz",
                     [(o, p, s, 3.0, 99.995, d, f, when) for o in (1, 2, 3, 4, None) for p, s in ((1, 1), (2, 2), (None, 1), (7, 1), (1, 7))
                      for d, f, when in ((0.05, "R", day(2024, 3, 1, 1)), (None, None, None))])}
    for name, (schema, values) in rows.items():
        spark.createDataFrame(values, schema).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return at


@pytest.mark.parametrize("few", [True, False])
def test_fact_has_the_rows_of_its_sql(spark, tables, monkeypatch, few):
    if not few:
        monkeypatch.setattr(facts, "SUPPLIERS", 0)
    found = orders_fact(spark, tables)
    con = duckdb.connect()
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet/*.parquet'")
    want = con.execute(ORDERS_FACT_SQL).fetchall()
    assert want and Counter(map(tuple, found.collect())) == Counter(want)


def test_lines_of_the_fact_are_shuffled_twice(spark, tables):
    """Once by part, once by order, and not for a few suppliers; when all joins are too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = orders_fact(spark, tables)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    keys = re.findall(r"Exchange hashpartitioning\(l_(\w+?)#", plan)
    assert sorted(keys) == ["orderkey", "partkey"]
