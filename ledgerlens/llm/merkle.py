"""A Merkle manifest of a table: a digest of every row, of every group and of the whole, with a proof per row.

A row's leaf is the SHA-256 of its fields, each written as its UTF-8 byte count,
a colon and its value (``-`` for null).  The leaves of a group stand in the order
of their ids; every two neighbours become the SHA-256 of their digests (as hex
text, end to end), a last one without a neighbour becomes that of its own, until
one node is left: the group's root.  The groups' roots, in the order of the
groups' names, give the table's root in the same way.

**Coordinates by bitmap rank, without sorting the leaves.**  The ids of a group
form a compressed bitmap: only its 64-bit words that are not zero are kept, a
row each.  Partial bitmaps of the tasks merge by ``bit_or``, and a directory of
popcounts tells how many leaves come before a word.  The directory has a level
per digit of the word's number (10, 16, 16 and 16 bits), so no count ever runs
over more than 65,536 siblings.  A leaf's rank is its word's count plus the
popcount of the bits below its own.  Ids that several rows share are counted in
their word's row; such leaves are ranked among themselves by their digests, two
bytes first, and rows that are equal in all fields are counted, not collected,
and take consecutive places.

**Levels by keyed slot arrays.**  The leaves of ``2**BITS`` consecutive places go
to one array, each into the slot that its rank names, and the array is reduced
``BITS`` levels at once in a task; its root is a leaf of the next round.  On the
way back each array hands its own siblings and those above to the next lower
one.  A group of any size is spread over its arrays.

Defined results: null ids come first in their group, null groups before all
others; rows with equal ids are ordered by their leaf; equal rows are leaves
each; an empty table gives an empty result; texts of any length are hashed
whole; only the named fields are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import stored
from ledgerlens.operators import ranking

#: Levels that one slot array reduces.
BITS = 8
#: Copies of one row that are laid out at once.
COPIES = 1 << 16
BLOCKS = "g string, pos long, height int, slots array<struct<slot int, node binary, doc_id long, presented binary>>"
_ABOVE = "g string, pos long, node binary, doc_id long, presented binary, path array<string>, subroot string, root string"


def written(value: Column) -> Column:
    """A field as it enters a leaf."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: Sequence[Column]) -> Column:
    """The SHA-256 of the fields, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[written(f) for f in fields]), 256))


def manifest(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id",
             group_col: str = "lang", presented: Column | None = None) -> DataFrame:
    """Per row: doc_id, position in its group, leaf, subroot, root and proof.

    ``proof`` has an entry per level: ``L`` or ``R`` (the side of the sibling) and
    the sibling's digest, or the empty text where a node is alone.  ``presented``
    is a leaf (or null) of the row as somebody shows it later; it comes back as
    hex text, the row's own leaf where null.
    """
    spark = docs.sparkSession
    own = leaf([F.col(f) for f in fields])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), group_col), F.lit("")).alias("g"),
                       own.alias("node"), (F.lit(None) if presented is None else F.nullif(presented, own)).cast("binary").alias("presented"))
    leaves = stored(rows.groupBy("g", "doc_id", "node", "presented").agg(F.count("*").alias("m")), "merkle-leaves")
    placed = _places(leaves)
    blocks = [stored(_slots(placed), "merkle-slots")]
    most = blocks[0].agg(F.max("height")).first()[0]
    if most is None:
        return spark.createDataFrame([], "doc_id long, position long, leaf string, subroot string, root string, proof array<string>,"
                                         " presented string")
    nodes = _tops(blocks[0])
    for _ in range(BITS, most, BITS):
        blocks.append(stored(_slots(nodes), "merkle-slots"))
        nodes = _tops(blocks[-1])
    above = stored(_whole(nodes), "merkle-roots")
    for b in reversed(blocks):
        above = _paths(b, above)
    hexed = [F.lower(F.hex(c)).alias(n) for c, n in ((F.col("node"), "leaf"), (F.coalesce("presented", "node"), "presented"))]
    return above.select("doc_id", F.col("pos").alias("position"), hexed[0], "subroot", "root", F.col("path").alias("proof"), hexed[1])


def folded(start: Column, proof: Column) -> Column:
    """The root that follows from a leaf (hex text) and the siblings of its proof."""
    def up(node: Column, step: Column) -> Column:
        other = F.substr(step, F.lit(2))
        return F.sha2(F.when(step == "", node).when(F.startswith(step, F.lit("L")), F.concat(other, node)).otherwise(F.concat(node, other)), 256)

    return F.aggregate(proof, start, up)


def siblings(proof: Column) -> Column:
    """The digests of a proof, lowest level first."""
    return F.transform(F.filter(proof, lambda s: s != ""), lambda s: F.substr(s, F.lit(2)))


def _places(leaves: DataFrame) -> DataFrame:
    """Each leaf with ``pos``, its rank in its group, and ``height``, the levels of its group's tree."""
    bit = F.col("doc_id").bitwiseAND(63).cast("int")
    ids = leaves.groupBy("g", "doc_id").agg(F.sum("m").alias("c"))
    words = stored(ids.groupBy("g", F.shiftright("doc_id", 6).alias("w")).agg(
        F.expr("bit_or(shiftleft(1L, cast(doc_id & 63 AS INT)))").alias("bits"), F.sum("c").alias("n"),
        F.collect_list(F.when(F.col("c") > 1, F.struct(bit.alias("bit"), (F.col("c") - 1).alias("more")))).alias("shared"),
    ), "merkle-words")
    d = _directory(words)
    at = leaves.alias("l").join(d.alias("d"), (F.col("l.g") == F.col("d.g")) & F.shiftright("l.doc_id", 6).eqNullSafe(F.col("d.w")))
    below = F.expr("bit_count(d.bits & ~shiftleft(-1L, cast(l.doc_id & 63 AS INT)))")
    before = F.aggregate(F.filter("d.shared", lambda s: s["bit"] < F.col("l.doc_id").bitwiseAND(63)), F.lit(0).cast("long"),
                         lambda total, s: total + s["more"])
    tied = F.coalesce(F.exists("d.shared", lambda s: s["bit"] == F.col("l.doc_id").bitwiseAND(63)), F.col("d.n") > 1)
    located = stored(at.select("l.*", F.when(F.col("d.total") > 1, F.length(F.bin(F.col("d.total") - 1))).otherwise(0).alias("height"), tied.alias("tied"),
                               (F.col("d.before") + F.coalesce(below + before, F.lit(0))).alias("pos")), "merkle-places")
    columns = ["g", "doc_id", "node", "presented", "height", "pos"]
    return located.where("not tied").select(columns).unionByName(_shared(located.where("tied")).select(columns))


def _directory(words: DataFrame) -> DataFrame:
    """Words with ``before``, the leaves of the group that come before them, and the group's ``total``.

    One level per digit of the word's number; each sums over at most 65,536 siblings.
    """
    def before(parent: list[str], digit: str) -> Column:
        up_to = Window.partitionBy("g", *parent).orderBy(F.col(digit).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(up_to), F.lit(0))

    levels, keys = [words], ["w", "k1", "k2", "k3"]
    for i, shift in enumerate((10, 16, 16)):
        levels[i] = levels[i].withColumn(keys[i + 1], F.shiftright(keys[i], shift))
        levels.append(levels[i].groupBy("g", keys[i + 1]).agg(F.sum("n").alias("n")))
    top = levels[3].withColumns({"before": before([], "k3"), "total": F.sum("n").over(Window.partitionBy("g"))})
    for i in (2, 1, 0):
        k = keys[i + 1]
        own = levels[i].withColumn("inside", before([k], keys[i]))
        outer = top.select(F.col("g").alias("og"), F.col(k).alias("ok"), "before", "total")
        top = (own.join(outer, (F.col("g") == F.col("og")) & F.col(k).eqNullSafe(F.col("ok")))
               .withColumn("before", F.col("before") + F.col("inside")).drop("og", "ok", "inside"))
    return top


def _shared(tied: DataFrame) -> DataFrame:
    """Places of leaves whose id other leaves share: by the digest's first two bytes, then within those; copies one by one."""
    key = ["g", "doc_id"]
    first = tied.withColumn("t", F.conv(F.hex(F.substring("node", 1, 2)), 16, 10).cast("int"))
    counts = first.groupBy(*key, "t").agg(F.sum("m").alias("c"))
    upto = Window.partitionBy(*key).orderBy("t").rowsBetween(Window.unboundedPreceding, -1)  # at most 65,536 rows
    counts = counts.select(F.col("g").alias("og"), F.col("doc_id").alias("oid"), F.col("t").alias("ot"),
                           F.coalesce(F.sum("c").over(upto), F.lit(0)).alias("earlier"))
    inner = Window.partitionBy(*key, "t").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    at = (first.withColumn("within", F.coalesce(F.sum("m").over(inner), F.lit(0)))
          .join(counts, (F.col("g") == F.col("og")) & F.col("doc_id").eqNullSafe(F.col("oid")) & (F.col("t") == F.col("ot"))))
    part = at.withColumn("part", F.explode(F.sequence(F.lit(0), F.expr(f"(m - 1) div {COPIES}")))).repartition("g", "pos", "node", "part")
    start = F.col("part") * COPIES
    copy = F.explode(F.sequence(start, F.least(start + (COPIES - 1), F.col("m") - 1)))
    return part.withColumn("copy", copy).withColumn("pos", F.col("pos") + F.col("earlier") + F.col("within") + F.col("copy"))


def _slots(nodes: DataFrame) -> DataFrame:
    """The nodes of ``2**BITS`` consecutive places in one array, keyed by slot."""
    slot = F.col("pos").bitwiseAND((1 << BITS) - 1).cast("int")
    return (nodes.groupBy("g", F.shiftright("pos", BITS).alias("block"), "height")
            .agg(F.collect_list(F.struct(slot.alias("slot"), "node", "doc_id", "presented")).alias("slots"))
            .select("g", F.col("block").alias("pos"), "height", "slots"))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def climb(nodes: list[str], height: int) -> list[list[str]]:
    """The levels of a tree, from ``nodes`` up."""
    levels = [nodes]
    for _ in range(height):
        nodes = [digest("".join(nodes[i: i + 2])) for i in range(0, len(nodes), 2)]
        levels.append(nodes)
    return levels


def _arrays(batch: pa.RecordBatch, bits: int) -> Iterator[tuple[int, list[int], pa.StructArray, list[list[str]]]]:
    """Per row: its number, the order of its entries by slot, the entries, and the levels above them."""
    column = batch.column("slots")
    entries, bounds = column.flatten(), np.asarray(column.offsets)
    bounds = bounds - bounds[0]
    slots, nodes = np.asarray(entries.field("slot")), entries.field("node").to_pylist()
    for i, height in enumerate(batch.column("height").to_pylist()):
        a, b = int(bounds[i]), int(bounds[i + 1])
        placed = [0] * (b - a)
        for j in range(a, b):
            placed[slots[j]] = j
        yield i, placed, entries, climb([nodes[j].hex() for j in placed], min(bits, height))


def _tops(blocks: DataFrame) -> DataFrame:
    """The node that each array reduces to."""
    bits = BITS

    def run(batches):
        for batch in batches:
            tops = [bytes.fromhex(levels[-1][0]) for _, _, _, levels in _arrays(batch, bits)]
            yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("pos"), batch.column("height"), pa.array(tops, pa.binary())],
                                             names=["g", "pos", "height", "node"])

    tops = blocks.mapInArrow(run, "g string, pos long, height int, node binary")
    return tops.select("g", "pos", F.greatest(F.col("height") - BITS, F.lit(0)).alias("height"), "node",
                       F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("presented"))


def _paths(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """The entries of the arrays, each with its siblings in its own array and above."""
    bits = BITS
    kinds = pa.schema([("g", pa.string()), ("pos", pa.int64()), ("node", pa.binary()), ("doc_id", pa.int64()), ("presented", pa.binary()),
                       ("path", pa.list_(pa.string())), ("subroot", pa.string()), ("root", pa.string())])

    def run(batches):
        for batch in batches:
            g, pos, path, subroot, root = (batch.column(c).to_pylist() for c in ("g", "pos", "path", "subroot", "root"))
            for i, placed, entries, levels in _arrays(batch, bits):
                paths, n = [], len(placed)
                for at in range(n):
                    own = []
                    for nodes in levels[:-1]:
                        other = at ^ 1
                        own.append("" if other >= len(nodes) else ("L" if at & 1 else "R") + nodes[other])
                        at >>= 1
                    paths.append(own + path[i])
                mine = entries.take(pa.array(placed, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g[i]] * n), pa.array(np.arange(n) + (pos[i] << bits)), mine.field("node"), mine.field("doc_id"),
                     mine.field("presented"), pa.array(paths, pa.list_(pa.string())), pa.array([subroot[i]] * n), pa.array([root[i]] * n)],
                    schema=kinds)

    up = above.select(F.col("g").alias("og"), F.col("pos").alias("opos"), "path", "subroot", "root")
    return blocks.join(up, (F.col("g") == F.col("og")) & (F.col("pos") == F.col("opos"))).drop("og", "opos").mapInArrow(run, _ABOVE)


def _whole(subroots: DataFrame) -> DataFrame:
    """The groups' nodes with their path to the table's root, which they reach in the order of the groups' names."""
    subroots = stored(subroots.select("g", "node"), "merkle-groups")
    height = max(0, int(subroots.count() - 1).bit_length())
    placed = ranking.row_number(subroots, ["g"], out="rank").select(
        F.lit("").alias("g"), (F.col("rank") - 1).alias("pos"), F.lit(height).alias("height"), "node", F.lit(None).cast("long").alias("doc_id"),
        F.lit(None).cast("binary").alias("presented"), F.col("g").alias("name"))
    placed = stored(placed, "merkle-group-places")
    blocks, nodes = [], placed.drop("name")
    for _ in range(0, max(height, 1), BITS):
        blocks.append(stored(_slots(nodes), "merkle-slots"))
        nodes = _tops(blocks[-1])
    top = nodes.select("g", F.lit(0).cast("long").alias("pos"), F.array().cast("array<string>").alias("path"),
                       F.lower(F.hex("node")).alias("subroot"), F.lower(F.hex("node")).alias("root"))
    for b in reversed(blocks):
        top = _paths(b, top)
    names = placed.select(F.col("pos").alias("at"), "name")
    return top.join(names, F.col("pos") == F.col("at")).select(
        F.col("name").alias("g"), F.lit(0).cast("long").alias("pos"), "path", F.lower(F.hex("node")).alias("subroot"), "root")
