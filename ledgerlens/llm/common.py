"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.words import blocks
from ledgerlens.session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor rereads the files instead of recomputing
    the stages before, and the planner knows the real size of the table.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of tables that nothing refers to any more.

    Spark removes them once the driver's JVM has collected their plans, which
    otherwise happens whenever the JVM next needs memory.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names; other columns never travel."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def raw(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterator], Iterator]:
    """``mapInArrow`` function from a function of one batch."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None and out.num_rows:
                    yield out
    return run


def per_block(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterator], Iterator]:
    """:func:`per_batch`, but ``fn`` sees a few megabytes of text (column 1) at a time, so what it holds does not follow the rows of a batch."""
    def run(batches):
        for batch in batches:
            for start, texts in blocks(batch.column(1)):
                out = fn(batch.slice(start, len(texts)))
                if out is not None and out.num_rows:
                    yield out
    return run


def fold(id_col: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id falls in fold 0."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.when(F.col(id_col).isNull(), F.lit(0)).otherwise(F.crc32(text.cast("binary")) % modulus).cast("int")


class Memo(dict):
    """A bounded memo: ``memo[key]`` computes a missing value, and starts anew when full."""

    def __init__(self, compute: Callable, limit: int = 1 << 20, longest: int = 64):
        super().__init__()
        self._compute, self._limit, self._longest = compute, limit, longest

    def __missing__(self, key):
        value = self._compute(key)
        if len(key) <= self._longest:
            if len(self) >= self._limit:
                self.clear()
            self[key] = value
        return value


def offsets(lengths: np.ndarray) -> np.ndarray:
    """Start of each part when parts of these lengths are laid end to end, and the total at the end."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
