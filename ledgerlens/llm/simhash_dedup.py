"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprint: the text is lower-cased (A-Z only), cut into words
``[^\\x20\\x09-\\x0D]+`` and into shingles of ``shingle`` words (fewer words:
the whole sequence; no word: fingerprint zero).  Each shingle is hashed with
XXH64 (seed 42); a bit of the fingerprint is 1 if it is set in more than half
of the hashes.

Search: the 64 bits are three segments (22, 21, 21 bits), each a word of the
perfect binary Golay code of length 23, padded with zeros.  Every 23-bit word
lies within 3 bits of exactly one codeword, so decoding the word and its 23
one-bit neighbours gives 1 or 6 codeword indices, and any two words at most 2
bits apart decode to a common index (that of the word between them).  With at
most 2 differing bits over three segments at least one segment is equal, and
the next one is at most 2 bits off; so (equal segment, an index of the next
segment) is a key that every linked pair shares.  Keys with few different
fingerprints are verified pair by pair.  For keys with many, the fingerprints
are verified exactly without pairs: two fingerprints are within 2 bits if and
only if they share a word at most 1 bit from both, so each gives its 65 such
words and is linked to the smallest fingerprint at the same word; such a group
never has more than 65 members.

Equal fingerprints are one class from the start, so copies are never expanded.

Defined results: null text counts as empty; empty texts link to each other
(fingerprint zero); a null id takes no part in links and gets the smallest id
linked to its fingerprint, if any; repeated rows are returned as often as they
come; an empty table gives an empty result.  :func:`keep_one` tells rows that
share an id apart by their texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import id_and_text, per_batch, raw, stored

SEED = 42
#: Keys with at most this many different fingerprints are compared pair by pair.
SMALL_KEY = 16
#: Hashes summed at once, which bounds the memory for very long texts.
STEP = 1 << 16
#: Segment widths; each is at most 23 bits.
SEGMENTS = (22, 21, 21)
#: Fixed value: generator polynomial of the binary Golay code (23, 12).
GOLAY = 0b110001110101

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint of one text, unsigned."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(flat, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    cut = list(zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist(), strict=True))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(cut), STEP):
        part = cut[at: at + STEP]
        h = np.fromiter((xxhash.xxh64_intdigest(flat[a:b], SEED) for a, b in part), np.uint64, len(part))
        octets = h.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            ones[8 * k: 8 * k + 8] += np.bincount(octets[:, k], minlength=256) @ _BITS
    return int(sum(1 << int(j) for j in np.flatnonzero(2 * ones > len(cut))))


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", mark: bool = False) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long, one row per input row; with ``mark`` also a hash of the text."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, shingle) for t in raw(batch.column(1))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), *batch.columns[2:]], ["doc_id", "fp", "mark"][: batch.num_columns])

    rows = id_and_text(docs, id_col, text_col)
    return (rows.withColumn("mark", F.xxhash64("text")) if mark else rows).mapInArrow(
        per_batch(run), "doc_id long, fp long" + ", mark long" * mark)


def _syndrome_bytes() -> list[np.ndarray]:
    """Remainders modulo the generator of each byte value at each of three byte positions."""
    def remainder(v: int) -> int:
        for bit in range(23, 10, -1):
            if v >> bit & 1:
                v ^= GOLAY << (bit - 11)
        return v
    return [np.array([remainder(b << shift) for b in range(256)], np.uint32) for shift in (0, 8, 16)]


def _syndromes(words: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    return tables[0][words & 255] ^ tables[1][(words >> 8) & 255] ^ tables[2][(words >> 16) & 127]


def golay_indices(words: np.ndarray) -> np.ndarray:
    """Indices (n, 24) of the codewords nearest to each 23-bit word and to its 23 one-bit neighbours."""
    tables = _syndrome_bytes()
    units = [1 << i for i in range(23)]
    errors = np.array([0] + units + [a | b for i, a in enumerate(units) for b in units[:i]]
                      + [a | b | c for i, a in enumerate(units) for j, b in enumerate(units[:i]) for c in units[:j]],
                      np.uint32)
    correct = np.zeros(1 << 11, np.uint32)
    correct[_syndromes(errors, tables)] = errors
    near = words.astype(np.uint32)[:, None] ^ np.array([0] + units, np.uint32)
    return (near ^ correct[_syndromes(near, tables)]) >> 11


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``fps``, key): every pair of fingerprints at most 2 bits apart shares a key."""
    values, parts, at = fps.view(np.uint64), [], 0
    for width in SEGMENTS:
        parts.append(((values >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64))
        at += width
    rows, keys = [], []
    for i, part in enumerate(parts):
        index = np.sort(golay_indices(parts[(i + 1) % 3]), axis=1)
        first = np.ones(index.shape, bool)
        first[:, 1:] = index[:, 1:] != index[:, :-1]
        row, col = np.nonzero(first)
        rows.append(row)
        keys.append((i << 40) | (part[row] << 12) | index[row, col].astype(np.int64))
    return np.concatenate(rows), np.concatenate(keys)


def linked_classes(classes: DataFrame, distance: int = 2) -> DataFrame:
    """Links (a, b) between classes, given (fp, rep); enough of them to join whatever is within ``distance`` bits."""
    if not 0 <= distance <= 2:
        raise ValueError("the Golay keys guarantee distances up to 2")

    def keyed(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        row, key = golay_keys(fps)
        return pa.RecordBatch.from_arrays(
            [pa.array(key), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))], ["key", "fp", "rep"])

    keys = classes.select("fp", "rep").mapInArrow(per_batch(keyed), "key long, fp long, rep long")
    shared = keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    found = stored(keys.join(shared, "key"), "simhash-keys")
    member = F.struct("fp", "rep")
    few = (found.where(F.col("members") <= SMALL_KEY).groupBy("key").agg(F.collect_list(member).alias("m"))
           .select(F.explode(F.expr(
               "filter(flatten(transform(m, x -> transform(m, y -> struct(x.rep AS a, y.rep AS b, x.fp AS f, y.fp AS g)))),"
               f" p -> p.a < p.b AND bit_count(p.f ^ p.g) <= {int(distance)})")).alias("p"))
           .select("p.a", "p.b"))
    many = found.where(F.col("members") > SMALL_KEY).select("fp", "rep").distinct()
    if distance == 2:
        flips = [F.lit(0)] + [F.expr(f"shiftleft(1L, {i})") for i in range(64)]
        between = many.select("rep", F.explode(F.array(*[F.col("fp").bitwiseXOR(x.cast("long")) for x in flips])).alias("w"))
        groups = between.groupBy("w").agg(F.collect_list("rep").alias("m")).where(F.size("m") > 1)
        star = groups.select(F.array_min("m").alias("a"), F.explode("m").alias("b")).where("a < b")
    else:  # within one bit: the other fingerprint is itself one of the neighbours
        flips = [F.expr(f"shiftleft(1L, {i})") for i in range(64)] if distance else []
        near = many.select(F.col("rep").alias("a"), F.explode(F.array(*[F.col("fp").bitwiseXOR(x) for x in flips])).alias("fp")
                           ) if flips else many.select(F.col("rep").alias("a"), "fp").limit(0)
        star = near.join(many.withColumnRenamed("rep", "b"), "fp").select("a", "b").where("a < b")
    return few.unionByName(star).distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable over undirected ``links`` (a, b); only linked nodes.

    Each round every node takes the smallest label among its neighbours and
    then the label of its label, so labels travel exponentially far; a round
    is one table in the shared folder.
    """
    edges = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), f"{name}-edges")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")), name)
    while True:
        near = (edges.join(labels.select(F.col("node").alias("b"), "component"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near")))
        best = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("component").alias("far"))
        after = stored(best.join(jump, "new").select("node", F.least("new", "far").alias("component"), "old"), name)
        labels = after.select("node", "component")
        if after.where("component <> old").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) per input row; see the module text for the method and the defined results."""
    fps = stored(fingerprints(docs, shingle, id_col, text_col), "simhash")
    classes = stored(fps.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    joined = components(linked_classes(classes, distance))
    named = classes.join(joined, classes["rep"] == joined["node"], "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest id; every column stays.

    Documents are told apart by id and text: rows that share only the id are judged each by its own
    fingerprint; of rows equal in both the one with the least hash of all its columns stays; rows without
    an id are kept.
    """
    fps = stored(fingerprints(docs, shingle, id_col, text_col, mark=True).where("doc_id IS NOT NULL"), "simhash")
    classes = stored(fps.groupBy("fp").agg(F.min(F.struct("doc_id", "fp", "mark")).alias("first"))
                     .select("fp", F.col("fp").alias("rep"), "first"), "simhash-classes")
    joined = components(linked_classes(classes, distance))
    best = (classes.join(joined, classes["rep"] == joined["node"], "left").groupBy(F.coalesce("component", "rep"))
            .agg(F.min("first").alias("first")).select("first.doc_id", "first.mark"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("mark"),
                        F.struct(*columns).alias("row"))  # no name of the table can clash
    plain = [F.col("row")[c] for c, kind in docs.dtypes if "map<" not in kind]
    kept = (keyed.where("doc_id IS NOT NULL").join(best, ["doc_id", "mark"], "left_semi").groupBy("doc_id", "mark")
            .agg(F.min_by("row", F.xxhash64(*plain)).alias("row")))
    return kept.select("row.*").unionByName(docs.where(F.col(id_col).cast("long").isNull()))
