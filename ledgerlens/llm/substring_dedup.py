"""Exact substring dedup of word windows, found through difference-cover anchors.

A word goes if it lies in a window of ``window`` consecutive words whose word
sequence also starts in a document with a smaller id.

Hashing every window of the corpus would shuffle a row per word.  Instead only
*anchors* are hashed: runs of ``window - period + 1`` words that begin at the
positions of a perfect difference set modulo ``period``.  For any two positions
there is a shift below ``period`` that brings both onto the set, so two equal
windows hold an equal anchor at the same shift, whatever their positions are.
Anchors that occur in one document only are dropped by one aggregation; the
rest tell which positions can begin a repeated window.  Each surviving anchor
then extends to the full windows around it, which are compared as whole word
sequences (two independent 64-bit hashes), by one aggregation for the smallest
document and one join back.  No pairs are formed, and joins on hot anchors or
windows are plain equi-joins that adaptive execution splits.

Copies of a whole document take a short cut that gives the same result: every
window of a copy also starts in the copy with the smallest id, so only that
one is searched.

Defined results: null text has no words; a null id counts as larger than any
other, and rows without an id do not remove from each other; rows that repeat
an id do not remove from each other; fewer than ``window`` words: nothing is
removed; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import Memo, id_and_text, offsets, per_block, raw, release, stored

#: Perfect difference sets, by period.
DIFFERENCE_SETS = {
    1: (0,),
    3: (0, 1),
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    21: (0, 1, 4, 14, 16),
    31: (0, 1, 3, 8, 12, 18),
}
NO_ID = (1 << 63) - 1
#: A position and a mark of the row's text share one long.
PLACE = 40
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def best_period(window: int) -> int:
    """The period that hashes the fewest anchors, while anchors keep two fifths of the window's words."""
    fitting = [p for p in DIFFERENCE_SETS if window - p + 1 >= max(1, 2 * window // 5)]
    return max(fitting)


def rolled(hashes: np.ndarray, words: int, base: int) -> np.ndarray:
    """Polynomial hash (mod 2^64) of each run of ``words`` values, by doubling."""
    out, n, block, k = None, 0, hashes, 1
    while True:
        if words & k:
            if out is None:
                out, n = block, k
            else:
                size = max(0, len(hashes) - n - k + 1)
                out = out[:size] * np.uint64(pow(base, k, 1 << 64)) + block[n: n + size]
                n += k
        if 2 * k > words:
            return out
        size = max(0, len(hashes) - 2 * k + 1)
        block = block[:size] * np.uint64(pow(base, k, 1 << 64)) + block[k: k + size]
        k *= 2


class WordHashes:
    """64-bit hashes of words, memoised for the life of a batch function."""

    def __init__(self):
        self._memo = Memo(xxhash.xxh3_64_intdigest, 1 << 19)

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of the texts, end to end, and the start of each text."""
        parts = [(t or b"").split() for t in texts]
        starts = offsets(np.array([len(p) for p in parts], np.int64))
        get = self._memo.__getitem__
        flat = np.fromiter((get(w) for p in parts for w in p), np.uint64, int(starts[-1]))
        return flat, starts


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _mark(text: bytes | None) -> int:
    return xxhash.xxh3_64_intdigest(text or b"") & 0x3FFFFF


def _meta(batch: pa.RecordBatch) -> pa.RecordBatch:
    sizes, shas = [], []
    for text in raw(batch.column(1)):
        words = (text or b"").split()
        sizes.append(len(words))
        shas.append(hashlib.sha256(b" ".join(words)).digest())
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(shas, pa.binary())], ["doc_id", "n_words", "sha"])


def anchors(texts: DataFrame, window: int) -> DataFrame:
    """(anchor, doc_id, place) at the cover positions of documents with at least ``window`` words."""
    period = best_period(window)
    span, cover = window - period + 1, np.zeros(period, bool)
    cover[list(DIFFERENCE_SETS[period])] = True
    hashes = WordHashes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        data = raw(batch.column(1))
        flat, starts = hashes(data)
        if len(flat) < window:
            return None
        lengths = np.diff(starts)
        doc = np.repeat(np.arange(len(data)), lengths)[: len(flat) - span + 1]
        place = np.arange(len(doc)) - starts[doc]
        at = np.flatnonzero(cover[place % period] & (place + span <= lengths[doc]) & (lengths[doc] >= window))
        return pa.RecordBatch.from_arrays(
            [pa.array(_mixed(rolled(flat, span, _BASES[0])[at])), batch.column(0).take(pa.array(doc[at])), pa.array(place[at])],
            ["anchor", "doc_id", "place"])

    return texts.mapInArrow(per_block(run), "anchor long, doc_id long, place long")


def _windows(found: DataFrame, window: int) -> DataFrame:
    """(w1, w2, doc_id, place) of the windows that hold a shared anchor; ``found`` has (doc_id, text, places)."""
    period = best_period(window)
    hashes = WordHashes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        data = raw(batch.column(1))
        flat, starts = hashes(data)
        if len(flat) < window:
            return None
        lengths = np.diff(starts)
        places = batch.column(2)
        doc_of = np.repeat(np.arange(len(data)), places.value_lengths().to_numpy(zero_copy_only=False))
        at = places.flatten().to_numpy(zero_copy_only=False)
        inside = at < lengths[doc_of]
        doc_of, at = doc_of[inside], at[inside] + starts[doc_of[inside]]
        # an anchor at p lies in the windows that begin at p - period + 1 .. p
        change = np.zeros(len(flat) + 1, np.int32)
        np.add.at(change, np.maximum(at - period + 1, starts[doc_of]), 1)
        np.add.at(change, at + 1, -1)
        doc = np.repeat(np.arange(len(data)), lengths)
        pick = np.flatnonzero((np.cumsum(change[:-1]) > 0) & (np.arange(len(flat)) - starts[doc] + window <= lengths[doc]))
        one, two = (_mixed(rolled(flat, window, b)[pick]) for b in _BASES)
        marks = np.array([_mark(t) for t in data], np.int64) << PLACE
        return pa.RecordBatch.from_arrays(
            [pa.array(one), pa.array(two), batch.column(0).take(pa.array(doc[pick])),
             pa.array(marks[doc[pick]] | (pick - starts[doc[pick]]))], ["w1", "w2", "doc_id", "place"])

    return found.mapInArrow(per_block(run), "w1 long, w2 long, doc_id long, place long")


def _cut(found: DataFrame, window: int) -> DataFrame:
    """(doc_id, sha, n_removed, spans, kept_sha) of documents with repeated windows at ``places``."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        whole, removed, spans, shas = [], [], [], []
        for text, places in zip(raw(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            words = (text or b"").split()
            packed = np.array(places, np.int64)
            at = packed[packed >> PLACE == _mark(text)] & ((1 << PLACE) - 1)
            change = np.zeros(len(words) + 1, np.int32)
            np.add.at(change, at, 1)
            np.add.at(change, at + window, -1)
            gone = np.cumsum(change[:-1]) > 0
            edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
            spans.append([{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
            kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
            removed.append(int(gone.sum()))
            whole.append(hashlib.sha256(b" ".join(words)).digest())
            shas.append(hashlib.sha256(kept).digest())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(whole, pa.binary()), pa.array(removed, pa.int64()), pa.array(spans, kind),
             pa.array(shas, pa.binary())], ["doc_id", "sha", "n_removed", "spans", "kept_sha"])

    return found.mapInArrow(per_block(run), "doc_id long, sha binary, n_removed long,"
                            " spans array<struct<start: long, end: long>>, kept_sha binary")


def _anchored(texts: DataFrame, rows: DataFrame, window: int) -> DataFrame:
    """(doc_id, text, places) of the documents to search, with the places of anchors that other documents hold too."""
    places = anchors(texts, window)
    shared = places.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    searched = rows.where((F.col("doc_id") == F.col("first_id")) & (F.col("n_words") >= window)).select("doc_id").distinct()
    hits = stored(places.join(shared, "anchor", "left_semi").groupBy("doc_id").agg(F.collect_set("place").alias("places"))
                  .join(searched, "doc_id", "left_semi"), "substring-anchors")
    del places, shared
    release(texts.sparkSession)
    return stored(texts.join(hits, "doc_id").select("doc_id", "text", "places"), "substring-hits")


def _repeated(found: DataFrame, window: int) -> DataFrame:
    """(doc_id, places) of the windows that also start in a document with a smaller id."""
    windows = _windows(found, window)
    repeated = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    return (windows.join(repeated.select("w1", "w2", "lo"), ["w1", "w2"]).where("lo < doc_id")
            .groupBy("doc_id").agg(F.collect_set("place").alias("places")))


def repeated_words(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: doc_id, n_words, n_removed, spans of removed words, and the SHA-256 of the kept words.

    ``spans`` are [start, end) word positions, null where a whole copy goes.
    """
    texts = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    meta = stored(texts.mapInArrow(per_block(_meta), "doc_id long, n_words long, sha binary"), "substring-meta")
    first = meta.groupBy("sha").agg(F.min("doc_id").alias("first_id"))
    rows = stored(meta.join(first, "sha"), "substring-rows")

    found = _anchored(texts, rows, window)
    release(docs.sparkSession)  # the anchors' shuffles are done with

    gone = stored(_repeated(found, window), "substring-gone")
    release(docs.sparkSession)  # so are the windows'
    cut = _cut(found.drop("places").join(gone, "doc_id").select("doc_id", "text", "places"), window).dropDuplicates(["doc_id", "sha"])
    copy = (F.col("doc_id") > F.col("first_id")) & (F.col("n_words") >= window)
    return rows.join(cut, ["doc_id", "sha"], "left").select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"), "spans",
        F.when(copy, F.unhex(F.lit(hashlib.sha256(b"").hexdigest()))).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha"))
