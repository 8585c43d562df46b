"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame operations only.

1. Words are lower-cased ``[^\\x20\\x09-\\x0D]+``; a shingle is ``shingle`` words
   (a shorter text: the whole of it).  A window has as many words as the item, so
   its similarity follows from the shingles it shares.  The best window can be
   slid to the right until it begins with a shared shingle or ends with the
   document, without losing any: those are the starts, and a start is kept only
   if its window holds as many shared shingles as the similarity needs.  Items of
   fewer words than a shingle are looked for as runs of just those words.
2. Every such window gets a 64-bit SimHash over its shingles, repeats included.
3. Multi-index search: fingerprints are four blocks of 16 bits.  Within a total
   radius r some block is at most r // 4 bits off.  Half of those bits are turned
   on the items' side and half on the windows', so the two meet.  No fingerprint
   within the radius is lost.
4. Fingerprints of similar windows can lie outside the radius.  Such pairs are
   found by the key shingles of an item: a window as similar as asked misses at
   most the share 1 - similarity of the item's shingles, so it holds at least one
   of any set that counts more than that.  The rarest ones are taken, and the
   result does not depend on the radius.
5. Candidates are verified by the exact weighted shingle similarity: the sum of
   the smaller multiplicities over the sum of the larger ones.

The benchmark is the stated query set.  Its shingles and keys are broadcast in
blocks of a bounded number of rows; more items make more blocks, not larger ones.

Defined results: a null or empty document or item matches nothing; a null id
cannot be reported; rows that repeat a doc_id are reported once, with the best
window; an empty table gives an empty result; of equal windows that begin with
one of the item's shingles, or end the document, the first is reported; a
document shorter than the item is one window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import id_and_text, stored

SHINGLE = 5
SIMILARITY = 0.8
#: Of the SimHash search; pairs outside of it are found by key shingles.
RADIUS = 19
#: Benchmark shingles broadcast at once (about 32 bytes a row).
BLOCK_ROWS = 200_000
BLOCK_BITS = 16
_LOW = (1 << BLOCK_BITS) - 1


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingles_of(words: Column, n: int) -> Column:
    """Hashes of the ``n``-word shingles of an array, in order.

    The array is bound to a lambda variable, so that it is computed once however the plan is folded.
    """
    def hashed(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.slice(w, i, n)))
        return (F.when(F.size(w) >= n, many).when(F.size(w) > 0, F.array(F.xxhash64(w)))
                .otherwise(F.lit([]).cast("array<bigint>")))

    return F.element_at(F.transform(F.array(words), hashed), 1)


def with_fingerprint(windows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fp) of rows with an array column ``sh``: bit j is 1 if set in more than half of the hashes.

    Two counts share a long (bits j and j + 32), so 32 sums hold all 64 counts.
    """
    lanes = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(0x0000000100000001))).alias(f"s{j}") for j in range(32)]
    sums = windows.select(*keys, F.explode("sh").alias("h")).groupBy(*keys).agg(F.count("*").alias("n"), *lanes)
    bits = [F.when((F.col(f"s{j}") if not high else F.shiftrightunsigned(f"s{j}", 32)).bitwiseAND(0xFFFFFFFF) * 2 > F.col("n"),
                   F.shiftleft(F.lit(1).cast("long"), j + 32 * high)).otherwise(F.lit(0).cast("long"))
            for high in (0, 1) for j in range(32)]
    return sums.select(*keys, reduce(lambda a, b: a.bitwiseOR(b), bits).alias("fp"))


def block_values(fp: str) -> Column:
    return F.array(*[F.struct(F.lit(b).alias("block"), F.shiftrightunsigned(fp, BLOCK_BITS * b).bitwiseAND(_LOW).alias("value"))
                     for b in range(4)])


def bag_similarity(a: str, b: str) -> Column:
    """Weighted Jaccard of two arrays of hashes, weights being multiplicities."""
    common = (f"CASE WHEN size(array_distinct({a})) = size({a}) AND size(array_distinct({b})) = size({b})"
              f" THEN size(array_intersect({a}, {b}))"
              f" ELSE aggregate(array_intersect({a}, {b}), 0, (s, x) -> s + least(size(filter({a}, y -> y = x)),"
              f" size(filter({b}, y -> y = x)))) END")
    return F.expr(f"({common}) / cast(size({a}) + size({b}) - ({common}) AS double)")


def item_shingles(benchmark: DataFrame, shingle: int = SHINGLE, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, size, sh): size in words."""
    items = id_and_text(benchmark, item_col, text_col).withColumnRenamed("doc_id", "item_id")
    words = words_of(F.col("text"))
    return (items.where("item_id IS NOT NULL AND text IS NOT NULL")
            .select("item_id", F.size(words).alias("size"), shingles_of(words, shingle).alias("sh")).where("size > 0"))


def in_blocks(rows: DataFrame, known: DataFrame, on: list[str], block_rows: int) -> DataFrame:
    """``rows`` joined with ``known``, which has a column ``h`` and is broadcast in blocks of about ``block_rows`` rows."""
    blocks = max(1, -(-known.count() // block_rows))
    return reduce(DataFrame.unionByName, [rows.join(F.broadcast(known.where(F.pmod("h", F.lit(blocks)) == b) if blocks > 1 else known), on)
                                          for b in range(blocks)])


def key_shingles(items: DataFrame, similarity: float) -> DataFrame:
    """(item_id, size, h): of each item its rarest shingles, of which every window at least ``similarity`` to it holds one.

    Counted with multiplicities they are more than the item's shingles that such a window can miss.
    """
    counts = (items.select("item_id", "size", F.xxhash64("sh").alias("it"), F.size("sh").alias("all"), F.explode("sh").alias("h"))
              .groupBy("item_id", "size", "it", "all", "h").agg(F.count("*").alias("n")))
    held = counts.groupBy("size", "h").agg(F.count("*").alias("holders"))
    rarest = Window.partitionBy("item_id", "size", "it").orderBy("holders", "h").rowsBetween(Window.unboundedPreceding, -1)
    return (counts.join(held, ["size", "h"]).withColumn("before", F.coalesce(F.sum("n").over(rarest), F.lit(0)))
            .where(F.col("before") <= F.col("all") * F.lit(1 - similarity) + 1e-6).select("item_id", "size", "h").distinct())


def windows(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY,
            block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, start, size, sh, last): the item-sized windows that share enough shingles with items of their size."""
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    hashed = texts.select("doc_id", shingles_of(words_of(F.col("text")), shingle).alias("sh"))
    known = items.where(F.col("size") >= shingle).select("size", F.explode("sh").alias("h")).distinct()
    hits = in_blocks(hashed.select("doc_id", F.size("sh").alias("n"), F.posexplode("sh").alias("p", "h")), known, ["h"], block_rows)
    held = (hits.groupBy("doc_id", "n", "size").agg(F.sort_array(F.collect_set("p")).alias("ps"))  # of one document and size
            .withColumn("m", F.col("size") - (shingle - 1))
            .withColumn("c", F.expr(f"greatest(1, cast(ceil({similarity} * (least(n, m) + m) / {1 + similarity} - 1e-9) AS int))")))
    inner = "filter(sequence(0, size(ps) - 1), i -> ps[i] <= n - m AND get(ps, i + c - 1) < ps[i] + m)"
    at_end = "if(size(filter(ps, x -> x >= n - m)) >= c, array(greatest(n - m, 0)), cast(array() AS array<int>))"
    starts = held.select("doc_id", "size", F.explode(F.expr(f"array_union(transform({inner}, i -> ps[i]), {at_end})")).alias("start"))
    starts = stored(starts.distinct(), "decontaminate-starts")  # few; their size decides how they are joined
    cut = F.expr(f"slice(sh, start + 1, greatest(size - {shingle - 1}, 1))")
    found = (texts.join(starts, "doc_id").select("doc_id", "start", "size", shingles_of(words_of(F.col("text")), shingle).alias("sh"))
             .select("doc_id", "start", "size", cut.alias("sh"), (F.size("sh") <= F.col("start") + F.col("size") - (shingle - 1)).alias("last")))
    short = items.where(F.col("size") < shingle)
    for size in sorted(r["size"] for r in short.select("size").distinct().collect()):  # fewer than ``shingle`` sizes
        words = F.transform(F.array(words_of(F.col("text"))), lambda w: F.when(F.size(w) >= size, F.transform(
            F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.xxhash64(F.slice(w, i, size)))))
        runs = texts.select("doc_id", F.posexplode(F.element_at(words, 1)).alias("start", "h"))
        named = short.where(F.col("size") == size).select(F.element_at("sh", 1).alias("h")).distinct()
        first = in_blocks(runs, named, ["h"], block_rows).groupBy("doc_id", "h").agg(F.min("start").alias("start"))
        found = found.unionByName(first.select("doc_id", "start", F.lit(size).alias("size"), F.array("h").alias("sh"), F.lit(False).alias("last")))
    return found


def leaks(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS,
          id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, item_id, similarity, start, n_words): the best window of each document for each item it holds."""
    items = stored(item_shingles(benchmark, shingle, item_col), "decontaminate-items")
    laid = stored(windows(id_and_text(docs, id_col, text_col), items, shingle, similarity, block_rows)
                  .dropDuplicates(["doc_id", "start", "size", "sh"]).withColumn("win", F.xxhash64("doc_id", "start", "size", "sh")),
                  "decontaminate-windows")
    off = radius // 4
    turned = [F.explode(F.lit([m for m in range(1 << BLOCK_BITS) if m.bit_count() <= bits]).cast("array<bigint>"))
              for bits in (off - off // 2, off // 2)]
    entries = (with_fingerprint(items, ["item_id", "size"]).withColumn("x", F.explode(block_values("fp")))
               .select("item_id", "size", F.col("fp").alias("item_fp"), "x.block", F.col("x.value").alias("exact")))
    near = (entries.withColumn("mask", turned[0])
            .select("item_id", "size", "item_fp", "block", F.col("exact").bitwiseXOR(F.col("mask")).alias("value")))
    looked = (with_fingerprint(laid, ["doc_id", "start", "size", "win"]).withColumn("x", F.explode(block_values("fp")))
              .withColumn("mask", turned[1])
              .select("doc_id", "size", "win", "fp", "x.block", F.col("x.value").bitwiseXOR(F.col("mask")).alias("value")))
    pairs = (looked.join(near, ["size", "block", "value"])
             .where(F.expr(f"bit_count(fp ^ item_fp) <= {int(radius)}")).select("doc_id", "win", "item_id"))
    keys = stored(key_shingles(items, similarity), "decontaminate-keys")
    held = in_blocks(laid.select("doc_id", "win", "size", F.explode(F.array_distinct("sh")).alias("h")), keys, ["size", "h"], block_rows)
    pairs = pairs.unionByName(held.select("doc_id", "win", "item_id")).distinct()
    checked = (pairs.join(laid, ["doc_id", "win"]).join(items.select("item_id", F.col("sh").alias("item_sh")), "item_id")
               .where("last OR array_contains(item_sh, sh[0])")
               .withColumn("similarity", bag_similarity("sh", "item_sh")).where(F.col("similarity") >= similarity))
    return (checked.groupBy("doc_id", "item_id")
            .agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "size")).alias("b"))
            .select("doc_id", "item_id", "b.similarity", (-F.col("b.back")).alias("start"), F.col("b.size").alias("n_words")))


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; rows without an id stay.

    Rows that share an id are judged each by its own text.
    """
    key = F.when(F.col(id_col).cast("long").isNotNull(), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")))
    marked = docs.select(key.alias("doc_id"), F.col(text_col).alias("text"))
    bad = leaks(marked, benchmark, **options).select(F.col("doc_id").alias("leak")).distinct()
    rows = docs.select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # no name of the table can clash
    return rows.join(bad, F.col("key") == F.col("leak"), "left_anti").select("row.*")
