"""Benchmark the headline operators.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Builds the orders fact once (star join, written as parquet under the shared
checkpoint folder, timed as ``fact_build``), then times each headline query
over it: one warm-up, then the median of 3 runs.  Every run executes the full
plan into Spark's no-op sink (nothing is collected).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlens.operators import cleaning, customers, forecast, kpis, products, profiling  # noqa: E402
from ledgerlens.plans.facts import FACT_ROLES, materialize, orders_fact  # noqa: E402
from ledgerlens.session import get_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPS = int(os.environ.get("BENCH_REPS", "3"))


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def headline(fact):
    return {
        "monthly_revenue": lambda: kpis.revenue_by_period(fact, FACT_ROLES, "M"),
        "kpi_row": lambda: kpis.compute_core_kpis(fact, FACT_ROLES),
        "rfm": lambda: customers.rfm_analysis(fact, FACT_ROLES),
        "abc": lambda: products.abc_classification(fact, FACT_ROLES),
        "profile": lambda: profiling.column_profile(fact),
        "duplicates": lambda: profiling.duplicate_rows(fact),
        "iqr_outliers": lambda: cleaning.remove_outliers(fact, ["revenue", "cost"], "iqr", 1.5, "remove"),
        "ridge_forecast": lambda: forecast.ridge(fact, FACT_ROLES, 30, "D")[1],
    }


def main() -> None:
    spark = get_session(f"local[{CPUS}]", app="ledgerlens-bench", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": str(int(CPUS) * 2), "spark.driver.memory": "16g",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="ledgerlens-bench-")})
    spark.sparkContext.setLogLevel("ERROR")
    run(orders_fact(spark, SF_DIR))  # warm-up (JVM, codegen, file listing); not timed
    t0 = time.perf_counter()
    fact = materialize(orders_fact(spark, SF_DIR), "bench-orders-fact")
    build = time.perf_counter() - t0
    times = {"fact_build": round(build, 3)}
    for name, q in headline(fact).items():
        run(q())  # warm-up
        samples = []
        for _ in range(REPS):
            t = time.perf_counter()
            run(q())
            samples.append(time.perf_counter() - t)
        times[name] = round(statistics.median(samples), 3)
    total = round(sum(v for k, v in times.items() if k != "fact_build"), 3)
    sf = os.path.basename(SF_DIR.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_median_sec", "value": total, "unit": "sec", "queries": times,
                      "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "cpus": int(CPUS)}))


if __name__ == "__main__":
    main()
