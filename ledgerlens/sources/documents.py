"""JSON documents larger than a row, read by many tasks.

A document contributes the elements of its root list, else of the first list
among its own keys, else itself.  Files are split at line breaks if no line is
longer than ``LINE``, else at commas, wherever those stand.  A split cannot tell
whether it begins inside a string or how deep, but what it does to both is known
from its text alone: the parity of its quotes, and the brackets it opens for
either beginning.

1. the pieces between separators are read once, and stored as blocks of about a
   megabyte; what follows treats each block as a split of its own.  With each go
   its parity, the depth gained and the least depth, from outside a string and
   from inside one; a prefix scan over the blocks of a file gives where each begins;
2. for documents that are objects, each task says whether the first list opens
   or closes in a block; only blocks that come down to the root's keys can do so;
3. each task cuts its blocks into the list's elements, those of a block as the
   lines of one row; an element over several blocks is put together by key, so no
   task holds more than a block or an element.  Step 1 cuts already as if each
   block began between elements; what began otherwise is cut again here.

The scan itself is a few array operations over the quotes, brackets and commas of a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.session import scratch_path
from ledgerlens.sources.splits import PIECES, PIECES_SQL, RESPLIT, batch_of, joined, pieces, runs, with_states

BEFORE, WITHIN, BEHIND = range(3)
#: Characters of a block; the piece that reaches them ends it.
CHUNK = 1 << 20
#: Bytes of a line from which on a file's lines are no pieces.
LINE = 1 << 20
#: A block's text; or, where it can be cut as if it began between elements, what stands before its first comma, its whole elements
#: as objects, one per line, and what stands behind its last comma.
_CHUNKS = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("value", pa.string()), ("head", pa.string()), ("lines", pa.string()),
                     ("tail", pa.string()), ("parity", pa.int32()), ("outside", pa.int64()), ("inside", pa.int64()),
                     ("low_outside", pa.int64()), ("low_inside", pa.int64()), ("root", pa.string()), ("bytes", pa.int64())])
_CHUNKS_SQL = ("file long, block long, value string, head string, lines string, tail string, parity int, outside long, inside long, "
               "low_outside long, low_inside long, root string, bytes long")
#: The text of a block that was cut, up to blanks.
_TEXT = "coalesce(value, concat(head, ',', translate(lines, '\n', ','), ',', tail))"
#: Fragments as in ``PIECES``; a row without part has whole elements as objects, one per line.
_CUT, _CUT_SQL = PIECES.append(pa.field("lines", pa.string())), PIECES_SQL + ", lines string"
#: Spark holds thousands of rows of a row group at once; of blocks these are so few.
_FEW = {"parquet.block.row.count.limit": 16}
_LISTS = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("opens", pa.bool_()), ("shut", pa.bool_()), ("closes", pa.bool_())])


_STEP = np.zeros(256, np.int8)
_STEP[[91, 123]], _STEP[[93, 125]] = 1, -1
#: 1 for quotes, brackets and commas.
_MARKS = bytes(x in b'",[]{}' for x in range(256))
_BLANKS = bytes.maketrans(b"\r\n\t", b"   ")


def _steps(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the first byte and all quotes, brackets and commas: places, bytes, whether a quote count up to each is odd, +1 / -1 at brackets.

    No escape may be cut at the ends.
    """
    if b"\\" in text:
        text = text.replace(b"\\\\", b"..").replace(b'\\"', b"..")
    marked = np.frombuffer(bytearray(text.translate(_MARKS)), bool)
    marked[:1] = True
    at = np.flatnonzero(marked)
    codes = np.frombuffer(text, np.uint8)[at]
    odd = (np.add.accumulate((codes == 34).view(np.uint8), dtype=np.uint8) & 1).view(bool)
    return at, codes, odd, _STEP[codes]


def _depths(steps: np.ndarray, counted: np.ndarray, depth: int = 0) -> np.ndarray:
    """The depth behind each mark, of the steps that are counted."""
    return np.cumsum(steps * counted, dtype=np.int32 if len(steps) + abs(depth) < 1 << 31 else np.int64) + depth


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], int, bytes]]:
    """((file, block), row, text) of each block; the separator ends the text, also behind a file's last piece."""
    for row, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
        yield key, row, batch.column(2)[row].as_buffer().to_pybytes()


class Cutter:
    """Cuts text that comes in order into the elements of a list at depth ``level`` (1: the root's own)."""

    def __init__(self, level: int, state: int = BEFORE, inside: bool = False, depth: int = 0):
        self.level, self.state, self.inside, self.depth = level, state, inside, depth
        self.held: list[bytes] = []

    def own(self, text: bytes) -> tuple[int, np.ndarray, int, bool] | None:
        """Where the list's part of this text begins, its commas, where it ends, and whether the list closes there; None if there is no part."""
        at, codes, odd, steps = _steps(text)
        outside = odd == self.inside
        after = _depths(steps, outside, self.depth)
        if len(codes):
            self.inside, self.depth = bool(odd[-1] != self.inside), int(after[-1])
        start, mark = 0, 0
        if self.state == BEFORE:
            opened = np.flatnonzero((codes == 91) & outside & (after == self.level))
            if not len(opened):
                return None
            mark, self.state = int(opened[0]) + 1, WITHIN
            start = int(at[opened[0]]) + 1
        if self.state == BEHIND:
            return None
        closed = np.flatnonzero(after[mark:] < self.level)
        end = mark + int(closed[0]) if len(closed) else len(at)
        stop = int(at[end]) if len(closed) else len(text)
        commas = (codes[mark:end] == 44) & outside[mark:end] & (after[mark:end] == self.level)
        if len(closed):
            self.state = BEHIND
        return start, at[mark:end][commas], stop, bool(len(closed))

    def feed(self, text: bytes) -> list[bytes]:
        """The elements that end in this text."""
        found, out = self.own(text), []
        if found is None:
            return out
        start, commas, stop, closed = found
        for end in [*commas.tolist(), *[stop] * closed]:
            out.append(b"".join([*self.held, text[start:end]]) if self.held else text[start:end])
            self.held, start = [], end + 1
        if not closed:
            self.held.append(text[start:stop])
        return out


class Root:
    """Finds where the first value of text that comes in order ends."""

    def __init__(self):
        self.inside, self.depth = False, 0

    def end(self, text: bytes) -> int | None:
        """Place behind the bracket that closes the root, if it is in this text."""
        at, codes, odd, steps = _steps(text)
        moved = np.where(odd == self.inside, steps, 0)
        after = self.depth + np.cumsum(moved, dtype=np.int64)
        closed = np.flatnonzero((after == 0) & (moved < 0))
        if len(codes):
            self.inside, self.depth = bool(odd[-1] != self.inside), int(after[-1])
        return int(at[closed[0]]) + 1 if len(closed) else None


def _objects(block: bytes, starts: np.ndarray, ends: np.ndarray) -> str | None:
    """Elements that follow each other, one per line, if each of them begins as an object; behind each stands a byte that is not blank."""
    low = int(starts[0])
    text = np.frombuffer(block[low:int(ends[-1]) + 1].translate(_BLANKS), np.uint8)
    at = starts - low
    while (blank := text[at] == 32).any():
        at = at + blank
    if (text[at] != 123).any():
        return None
    text = text.copy()
    text[ends - low] = 10
    return text[:-1].tobytes().decode()


def _guess(block: bytes, commas: np.ndarray) -> tuple[str, str, str] | None:
    """(head, lines, tail) of a block that is cut at these commas, if it has whole elements and all are objects."""
    lines = _objects(block, commas[:-1] + 1, commas[1:]) if len(commas) > 1 else None
    return None if lines is None else (block[:commas[0]].decode(), lines, block[commas[-1] + 1:].decode())


def _chunks(text: DataFrame, separator: str) -> DataFrame:
    """``_CHUNKS``: the pieces of each split, in order, joined to blocks of about ``CHUNK`` characters, and what each does to the state.

    A block's number is twice the byte at which its split begins, for blocks behind the first plus twice the pieces before
    it less one: numbers rise along a file, as a piece and its separator take at least a byte.
    """
    def run(batches):
        now, held, size, before, count = None, [], 0, 0, 0

        def block():
            value = separator.join(held) + separator
            raw = value.encode()
            at, codes, odd, steps = _steps(raw)
            outside, inside = _depths(steps, ~odd), _depths(steps, odd)
            low = min(0, int(outside.min()))
            cut = _guess(raw, at[(codes == 44) & ~odd & (outside == 0)]) if not low else None
            row = (now[0], 2 * (now[1] + before) - (before > 0), *((None, *cut) if cut else (value, None, None, None)), int(odd[-1]),
                   int(outside[-1]), int(inside[-1]), low, min(0, int(inside.min())), value[:-1].lstrip("\ufeff \t\r\n")[:1] or None, len(raw))
            return batch_of([row], _CHUNKS)

        for batch in batches:
            for key, a, b in runs(batch):
                if key != now:
                    if held:
                        yield block()
                    now, held, size, before, count = key, [], 0, 0, 0
                values = batch.column(2).slice(a, b - a)
                ends = np.cumsum(pc.binary_length(values).to_numpy(zero_copy_only=False) + 1, dtype=np.int64)
                edges = np.r_[0, np.flatnonzero(np.diff(ends // CHUNK)) + 1, b - a]
                for part, more in zip(pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values), separator),
                                      np.diff(edges).tolist(), strict=True):
                    held.append(part.as_py())
                    size, count = size + len(held[-1]) + 1, count + more
                    if size >= CHUNK:
                        yield block()
                        held, size, before = [], 0, count
        if held:
            yield block()

    return text.mapInArrow(run, _CHUNKS_SQL)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """The blocks, stored; of lines if these make up all bytes of every file (the reader leaves out longer lines), else of what is between commas."""
    for separator, longest in (("\n", LINE), (",", None)):
        store = scratch_path(spark, "json-chunks")
        _chunks(pieces(spark, path, separator, longest=longest), separator).write.options(**_FEW).parquet(store)
        blocks = spark.read.schema(_CHUNKS_SQL).parquet(store)
        if longest is None or _whole(spark, path, blocks):
            return blocks


def _whole(spark: SparkSession, path: str, blocks: DataFrame) -> bool:
    """Whether the blocks hold all bytes of each file; its last line may end without a line break."""
    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("_metadata.file_path").alias("file"), "length")  # no content is read
    read = files.join(blocks.groupBy("file").agg(F.sum("bytes").alias("bytes")), "file", "left")
    return read.where(~F.coalesce("bytes", F.lit(0)).between(F.col("length"), F.col("length") + 1)).isEmpty()


def _begins(maps: DataFrame) -> DataFrame:
    """(file, block, inside, depth, low, root): the prefix scan over the blocks of each file; ``low`` is a block's least depth."""
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    at = maps.withColumn("in", F.coalesce(F.sum("parity").over(before) % 2 == 1, F.lit(False)))
    gained = F.when(F.col("in"), F.col("inside")).otherwise(F.col("outside"))
    depth = F.coalesce(F.sum("gained").over(before), F.lit(0))
    return (at.withColumn("gained", gained)
            .select("file", "block", F.col("in").alias("inside"), depth.alias("depth"),
                    (depth + F.when(F.col("in"), F.col("low_inside")).otherwise(F.col("low_outside"))).alias("low"),
                    F.min_by("root", F.when(F.col("root").isNotNull(), F.col("block"))).over(Window.partitionBy("file")).alias("root")))


def _lists(text: DataFrame, begins: DataFrame) -> DataFrame:
    """Per block of a document that is an object: whether a list of its own opens there, is shut behind that, or one from before closes.

    None of that happens in a block that stays within the values of the root's keys; such blocks are left out.
    """
    def run(batches):
        for batch in batches:
            done = []
            for key, row, block in _blocks(batch):
                inside, depth = batch.column(3)[row].as_py(), batch.column(4)[row].as_py()
                _, codes, odd, steps = _steps(block)
                outside = odd == inside
                after = _depths(steps, outside, depth)
                low = np.flatnonzero(after < 2)
                opened = np.flatnonzero((codes == 91) & outside & (after == 2))
                done.append((*key, bool(len(opened)), bool(len(opened) and len(low) and low[-1] > opened[0]), bool(len(low))))
            if done:
                yield batch_of(done, _LISTS)

    objects = begins.where("root = '{' AND low < 2")
    return (text.join(F.broadcast(objects), ["file", "block"]).select("file", "block", "value", "inside", "depth")
            .mapInArrow(run, "file long, block long, opens boolean, shut boolean, closes boolean"))


def _states(begins: DataFrame, lists: DataFrame) -> DataFrame:
    """(file, block, inside, depth, level, state) of each split; level 0 means that the document itself is the row."""
    whole, order = Window.partitionBy("file"), Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    all_ = begins.join(lists, ["file", "block"], "left")
    opened = F.min(F.when(F.col("opens"), F.col("block"))).over(whole)
    ends = F.when(F.col("block") == F.col("at"), F.col("shut")).when(F.col("block") > F.col("at"), F.col("closes"))
    placed = all_.withColumn("at", F.when(F.col("root") == "[", F.lit(0)).otherwise(opened)).withColumn("ends", F.coalesce(ends, F.lit(False)))
    closed = F.coalesce(F.max("ends").over(before), F.lit(False)) & (F.col("root") != "[")
    state = F.when(F.col("block") <= F.col("at"), BEFORE).when(closed, BEHIND).otherwise(WITHIN)
    level = F.when(F.col("root") == "[", 1).when(F.col("at").isNotNull(), 2).otherwise(0)
    return placed.select("file", "block", "inside", "depth", level.alias("level"), state.alias("state"), "root")


def _lines(block: bytes, starts: np.ndarray, ends: np.ndarray) -> str:
    """Elements that follow each other as objects, one per line."""
    if (lines := _objects(block, starts, ends)) is not None:
        return lines
    kept = (block[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
    return b"\n".join(_object(x) for x in kept if x.strip(b" \r\n\t,")).decode()


def _object(element: bytes) -> bytes:
    """What ``as_objects`` makes of a whole element."""
    text = element.translate(_BLANKS).strip(b" ")
    return text if text.startswith(b"{") else b'{"0":' + text + b"}"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, row, block in _blocks(batch):
            inside, depth, level, state, root = (batch.column(i)[row].as_py() for i in range(3, 8))
            if inside is None:
                raise ValueError(RESPLIT)
            if root not in ("[", "{"):
                raise ValueError("not a JSON document")
            if not level:  # a document that is a row itself goes on as one fragment per block
                yield batch_of([(*key, int(key[1] == 0), block.decode(), False, None)], _CUT)
                continue
            found = Cutter(level, state, inside, depth).own(block)
            if found is None:
                continue
            start, commas, stop, closed = found
            starts, ends, head = np.r_[start, commas + 1], np.r_[commas, stop], state == WITHIN
            parts = [None] * len(ends)
            if not closed:
                parts[-1] = 1
            if head:
                parts[0] = 0
            rows = [(*key, part, block[a:b].decode(), False, None) for part, a, b in zip(parts, starts.tolist(), ends.tolist(), strict=True)
                    if part is not None]
            whole = slice(int(head), len(ends) - (not closed))
            if len(ends[whole]):
                rows.append((*key, None, None, False, _lines(block, starts[whole], ends[whole])))
            yield batch_of(rows, _CUT)


def as_objects(found: DataFrame) -> DataFrame:
    """Elements as JSON objects on one line; one that is none becomes ``{"0": x}``."""
    value = F.col("value")
    ended = F.rtrim(value, F.lit(" \t\n\x0b\f\r")).endswith(",")  # few do, and few hold line breaks, which stand outside strings only
    text = F.when(ended, F.regexp_replace(value, r",\s*$", "")).otherwise(value)
    breaks = F.contains(value, F.lit("\n")) | F.contains(value, F.lit("\r")) | F.contains(value, F.lit("\t"))
    text = F.trim(F.when(breaks, F.translate(text, "\r\n\t", "   ")).otherwise(text))
    wrapped = F.concat(F.lit('{"0":'), F.col("value"), F.lit("}"))
    return found.select(text.alias("value")).select(F.when(F.col("value").startswith("{"), F.col("value")).otherwise(wrapped).alias("value"))


def element_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the rows of the documents, one document per file, as JSON objects on a line each; a value holds one line or many."""
    lists, cut = (scratch_path(spark, f"json-{n}") for n in ("lists", "cut"))
    blocks = _stored(spark, path)
    text = blocks.select("file", "block", F.expr(_TEXT).alias("value"))
    begins = _begins(blocks).where("root IS NOT NULL")
    _lists(text, begins).write.parquet(lists)
    states = _states(begins, spark.read.parquet(lists)).withColumn(
        "guessed", (F.col("level") > 0) & (F.col("state") == WITHIN) & ~F.col("inside") & (F.col("depth") == F.col("level")))
    kept = blocks.select("file", "block", "value", "head", "lines", "tail").join(
        F.broadcast(begins.select("file").distinct()), "file", "left_semi")  # files of blanks alone have no root
    right = with_states(kept.where("lines IS NOT NULL"), states).where("guessed")
    ends = right.select("file", "block", F.explode(F.array(*[F.struct(F.lit(part).alias("part"), F.col(c).alias("value"))
                                                             for part, c in enumerate(("head", "tail"))])).alias("e"))
    again = with_states(kept, states).where("lines IS NULL OR guessed IS NULL OR NOT guessed")
    again.select("file", "block", F.expr(_TEXT).alias("value"), "inside", "depth", "level", "state", "root").mapInArrow(
        _cut, _CUT_SQL).write.options(**_FEW).parquet(cut)
    rows = spark.read.schema(_CUT_SQL).parquet(cut)
    parts = rows.where("part IS NOT NULL").select("file", "block", "part", "value", "first")
    single = joined(parts.unionByName(ends.select("file", "block", "e.part", "e.value", F.lit(False).alias("first"))), "")
    return (right.select(F.col("lines").alias("value")).unionByName(rows.where("part IS NULL AND lines != ''").select(F.col("lines").alias("value")))
            .unionByName(as_objects(single.where(F.ltrim("value", F.lit(" \r\n\t,")) != ""))))


def elements(spark: SparkSession, path: str) -> DataFrame:
    """(value): one JSON object per row of the documents, one document per file."""
    return element_lines(spark, path).select(F.explode(F.split("value", "\n")).alias("value")).select(F.trim("value").alias("value"))
