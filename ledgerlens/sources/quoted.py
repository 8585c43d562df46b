"""CSV files whose quoted fields hold line breaks, read by many tasks.

A file is split between tasks at line breaks, and a split cannot tell by itself
whether it begins inside a quoted field.  What a run of lines does to that state
is a map from (outside, inside) to (outside, inside), though, and such maps
compose.  So:

1. each task reduces the lines of a split to one map (``state_maps``);
2. a prefix scan over the maps of a file, one row per split, gives the state in
   which each split begins (``begins_inside``);
3. each task cuts its splits into records, and passes on what began before a
   split or goes on behind it as a fragment (``records``); fragments are joined
   by key, so no task ever holds more than a record.

A quote opens a field only at its beginning; doubled quotes inside stand for one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.session import scratch_path
from ledgerlens.sources.splits import PIECES_SQL, RESPLIT, batch_of, joined, pieces, retried, runs, with_states

MAPS = "file long, block long, from_outside boolean, from_inside boolean, broken boolean"
#: From inside a quoted field up to and with its closing quote.
_CLOSING = re.compile(r'(?:[^"]++|"")*+"')


def ends_inside(line: str, inside: bool, sep: str) -> bool:
    """Whether a quoted field is open at the end of a line that begins inside (or outside) one."""
    at = 0
    while True:
        if inside:
            closed = _CLOSING.match(line, at)
            if closed is None:
                return True
            at = line.find(sep, closed.end())
        elif line.startswith('"', at):
            at, inside = at + 1, True
            continue
        else:  # on to the next field that is quoted
            at = line.find(sep + '"', at)
        if at < 0:
            return False
        at, inside = at + len(sep), False


def lines(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """(file, block, value): the lines of all files."""
    return pieces(spark, path, "\n", encoding)


def state_maps(text: DataFrame, sep: str = ",") -> DataFrame:
    """(file, block, from_outside, from_inside, broken): per split, the state at its end, and whether a line ever ends inside when
    the split begins outside."""
    def run(batches):
        now, outside, inside, broken = None, False, True, False
        names = [c.split()[0] for c in MAPS.split(", ")]

        def taken():
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, outside, inside, broken)], names=names)

        for batch in batches:
            quoted = batch.column(2)
            for key, a, b in runs(batch):
                if key != now:
                    if now is not None:
                        yield taken()
                    now, outside, inside, broken = key, False, True, False
                for line in quoted.slice(a, b - a).drop_null().to_pylist():
                    outside, inside = ends_inside(line, outside, sep), ends_inside(line, inside, sep)
                    broken = broken or outside
        if now is not None:
            yield taken()

    own = text.select("file", "block", F.when(F.col("value").contains('"'), F.col("value")).alias("value"))  # other lines keep the state
    return own.mapInArrow(run, MAPS)


def begins_inside(maps: DataFrame) -> DataFrame:
    """(file, block, inside): the composition of all maps before a split, applied to a file's beginning.

    A map keeps the state, swaps it, or sets it whatever it was; so the state is
    what the last setting map says, swapped once per swapping map since.
    """
    order = Window.partitionBy("file").orderBy("block")
    sets = F.col("from_outside") == F.col("from_inside")
    swaps = F.col("from_outside") & ~F.col("from_inside")
    grouped = maps.select("file", "block", F.when(sets, F.col("from_outside")).alias("set"), swaps.cast("int").alias("swap"),
                          F.sum(sets.cast("int")).over(order).alias("group"))  # a setting map and the maps up to the next one
    after = grouped.select("file", "block", F.last("set", ignorenulls=True).over(order).alias("said"),
                           (F.sum("swap").over(Window.partitionBy("file", "group").orderBy("block")) % 2 == 1).alias("odd"))
    state = F.coalesce(F.col("said"), F.lit(False)) != F.col("odd")
    return after.select("file", "block", F.coalesce(F.lag(state).over(order), F.lit(False)).alias("inside"))


def _cut(sep: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Records and fragments of splits: (file, block, part, value, first).

    ``part`` is null for a whole record, 0 for what ends a record of an earlier
    split (or lies within one), 1 for what begins a record that goes on.
    """
    def run(batches):
        now, inside, held, head, first = None, False, [], False, False
        rows: list[tuple] = []

        def put(part, value):
            nonlocal first
            rows.append((*now, part, value, first and part != 0))
            first = first and part == 0

        def end():
            if held:
                put(0 if head else 1, "\n".join(held))

        for batch in batches:
            begins, values = batch.column(3), batch.column(2)
            for key, a, b in runs(batch):
                if key != now:
                    if now is not None:
                        end()
                    now, inside = key, begins[a].as_py()
                    if inside is None:
                        raise ValueError(RESPLIT)
                    held, head, first = [], inside, key[1] == 0
                for line in values.slice(a, b - a).to_pylist():
                    was, inside = inside, inside if '"' not in line else ends_inside(line, inside, sep)
                    if not was and not inside:
                        put(None, line)
                        continue
                    held.append(line)
                    if not inside:
                        put(0 if head else None, "\n".join(held))
                        held, head = [], False
            if rows:
                yield batch_of(rows)
                rows.clear()
        if now is not None:
            end()
        if rows:
            yield batch_of(rows)

    return run


def records(text: DataFrame, states: DataFrame, sep: str = ",") -> DataFrame:
    """(value, first): the records of all files, line breaks in quoted fields included; ``first`` marks each file's first record.

    Written to the scratch folder at once: a fragment's key must be the one of this very reading.
    """
    spark = text.sparkSession
    cut = with_states(text, states).select("file", "block", "value", "inside").mapInArrow(_cut(sep), PIECES_SQL)
    path = scratch_path(spark, "csv-records")
    cut.write.parquet(path)
    return joined(spark.read.schema(cut.schema).parquet(path), "\n")


def quoted_records(spark: SparkSession, path: str, sep: str = ",", encoding: str = "utf-8", always: bool = False) -> DataFrame | None:
    """The records of CSV files, or None if every line is a record (unless ``always``)."""
    def read():
        text = lines(spark, path, encoding)
        maps = scratch_path(spark, "csv-maps")
        state_maps(text, sep).write.parquet(maps)
        found = spark.read.parquet(maps)
        if not always and found.where("broken").isEmpty():  # the first split of a file that is left inside shows it
            return None
        return records(text, begins_inside(found), sep)

    return retried(read)
