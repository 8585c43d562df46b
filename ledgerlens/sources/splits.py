"""What readers of files without record borders share: pieces of text in the order of their split, and fragments across splits.

``spark.read.text`` splits files wherever its line separator stands.  Each row
carries a hash of its file's path and the byte at which its split begins; rows of
a split keep their order, and a split lies in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A whole record (part null), what ends a record of an earlier split or lies within one (0), what begins one that goes on (1).
PIECES = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("part", pa.int32()), ("value", pa.string()), ("first", pa.bool_())])
PIECES_SQL = "file long, block long, part int, value string, first boolean"
RESPLIT = "the files are split in another way than before"


def pieces(spark: SparkSession, path: str, separator: str, encoding: str = "utf-8", longest: int | None = None) -> DataFrame:
    """(file, block, value): the pieces of all files between ``separator``.

    Pieces of ``longest`` bytes or more are left out, and never held whole.
    """
    reader = spark.read.option("lineSep", separator).option("encoding", encoding)
    if longest is not None:
        reader = reader.option("mapreduce.input.linerecordreader.line.maxlength", longest)
    return reader.text(path).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                    F.make_valid_utf8("value").alias("value"))


def runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], int, int]]:
    """((file, block), first row, end) of each run of rows of one split."""
    file, block = np.asarray(batch.column(0)), np.asarray(batch.column(1))
    starts = np.flatnonzero(np.r_[True, (file[1:] != file[:-1]) | (block[1:] != block[:-1])]) if len(file) else []
    for a, b in zip(starts, [*starts[1:], len(file)], strict=True):
        yield (int(file[a]), int(block[a])), int(a), int(b)


def batch_of(rows: list[tuple], schema: pa.Schema = PIECES) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def with_states(text: DataFrame, states: DataFrame) -> DataFrame:
    """Pieces with their split's state.  ``states`` has one row per split of a file: its broadcast stays a millionth of the data."""
    return text.join(F.broadcast(states), ["file", "block"], "left")


def joined(rows: DataFrame, glue: str) -> DataFrame:
    """(value, first): the whole records among ``PIECES`` rows, and those put together from their fragments."""
    order = Window.partitionBy("file").orderBy("block", "part")
    fragments = rows.where("part IS NOT NULL").withColumn("record", F.sum("part").over(order))  # a beginning opens the next record
    whole = fragments.groupBy("file", "record").agg(
        F.sort_array(F.collect_list(F.struct("block", "part", "value"))).alias("f"), F.bool_or("first").alias("first"))
    text = F.array_join(F.transform("f", lambda x: x["value"]), glue)
    return rows.where("part IS NULL").select("value", "first").unionByName(whole.select(text.alias("value"), "first"))


def retried(read, times: int = 3):
    """``read()``, again if the files were split differently between its two readings (the number of cores counts there)."""
    for left in reversed(range(times)):
        try:
            return read()
        except Exception as failed:
            if RESPLIT not in str(failed) or not left:
                raise
