"""K3 (revenue per day / week / month) over a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.exprs import sum0
from ledgerlens.operators._common import num, ts

WINDOWS = {"D": "1 day", "W": "1 week"}


def revenue_by_period_stream(spark: SparkSession, source_dir: str, schema: T.StructType, mapping: dict,
                             freq: str = "D", watermark: str = "2 days", fmt: str = "parquet") -> DataFrame:
    """A streaming DataFrame of (period, value); ``freq`` D or W (weeks start Monday).

    Rows later than ``watermark`` behind the newest event are dropped by the
    stream (the batch operator has no such limit).
    """
    if freq not in ("D", "W"):
        raise ValueError("streamed periods are D or W (months have no fixed length)")
    src = spark.readStream.schema(schema).format(fmt).load(source_dir)
    d = ts(src, mapping["date"]).cast("timestamp")
    ev = src.select(d.alias("_t"), num(src, mapping["revenue"]).alias("_v")).where(F.col("_t").isNotNull())
    # week windows in Spark start on Thursday (epoch); shift by 4 days so they start on Monday
    start = "4 days" if freq == "W" else None
    w = F.window("_t", WINDOWS[freq], WINDOWS[freq], start) if start else F.window("_t", WINDOWS[freq])
    return (ev.withWatermark("_t", watermark).groupBy(w.alias("w"))
              .agg(sum0(F.col("_v")).alias("value"))
              .select(F.col("w.start").cast("timestamp_ntz").alias("period"), "value"))


def run_once(stream: DataFrame, table_path: str, checkpoint: str) -> None:
    """Process everything available now into a parquet table (append mode, exactly once)."""
    q = (stream.writeStream.outputMode("append").format("parquet").option("path", table_path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
