"""Packing of token sequences by the dot-product rule of vector bin packing.

A piece is a vector of demands: tokens, one segment, and loss-bearing tokens;
a sequence has a limit for each.  Whole full sequences are cut from long
documents first.  What is left of each document is placed by the dot-product
rule: among the waiting pieces that fit all remaining limits, the one whose
demands point most in the direction of what is left goes next.  When nothing
fits any more, a waiting piece is cut to fill the sequence, where its limits
allow it.

Each partition packs its own rows, in bounded memory: pieces wait in a pool of
at most ``pool`` pieces, and a sequence is emitted as soon as it is closed.
Nothing is shuffled.  Since the order of rows within a file split is fixed, a
task that is run again gives the same sequences.  A sequence that is closed
short, at the limit on segments or loss-bearing tokens or at the end of a
partition, is cut into lengths that are powers of two, which need no padding.

Defined results: a null or empty text has only the end token; a null id packs
like any other and stays null; rows that repeat an id are packed each; an empty
table gives an empty result; a piece never exceeds a limit: loss-bearing tokens
are counted at the end of each piece's document (see ``loss_from``).
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ledgerlens.llm.common import id_and_text
from ledgerlens.llm.words import WordIds, blocks

CAPACITY = 4096
END = 2
#: Most segments in one sequence.
SEGMENTS = 256
#: Pieces that wait for a place, per task.
POOL = 2048
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long,"
          " loss_tokens long, sequence_length long")


class Packer:
    """Packs pieces under limits on tokens, segments and loss-bearing tokens.

    A piece is (key, start, length, loss): its last ``loss`` tokens bear loss.
    ``closed`` gets lists of pieces, each list one sequence.
    """

    def __init__(self, capacity: int = CAPACITY, segments: int = SEGMENTS, loss_limit: int | None = None, pool: int = POOL):
        if capacity < 1 or segments < 1:
            raise ValueError("limits must be positive")
        self.limits = np.array([capacity, segments, capacity if loss_limit is None else loss_limit], np.float64)
        if self.limits[2] < 1:
            raise ValueError("limits must be positive")
        self.capacity, self.pool = capacity, pool
        self._keys: list = []
        self._need = np.zeros((0, 3))
        self._start = np.zeros(0, np.int64)
        self._waiting: list[tuple] = []

    def add(self, key, length: int, loss: int) -> Iterator[list[tuple]]:
        """Take a document of ``length`` tokens; gives the sequences that are closed by it."""
        full = int(min(self.limits[0], self.limits[2]))
        at = 0
        while length - at > full or (length - at == full and self.limits[1] >= 1):
            piece = (key, at, full, max(0, min(full, at + full - (length - loss))))
            yield [piece]
            at += full
        if length > at:
            self._waiting.append((key, at, length - at, min(loss, length - at)))
        if len(self._waiting) >= self.pool:
            yield from self._fill(len(self._waiting) // 2)

    def finish(self) -> Iterator[list[tuple]]:
        yield from self._fill(0)

    def _fill(self, leave: int) -> Iterator[list[tuple]]:
        """Close sequences until at most ``leave`` pieces wait (and, unless it ends, each is full or at a limit)."""
        items = self._waiting
        need = np.array([(p[2], 1, p[3]) for p in items], np.float64).reshape(-1, 3)
        there = np.ones(len(items), bool)
        remaining = len(items)
        while remaining > leave:
            left, placed = self.limits.copy(), []
            while remaining:
                fits = there & (need <= left).all(axis=1)
                if not fits.any():
                    break
                # demands and what is left, both as shares of the limits; longer pieces win among equals, then the first
                score = np.where(fits, (need / self.limits) @ (left / self.limits), -1.0)
                i = int(score.argmax())
                placed.append(items[i])
                there[i], remaining = False, remaining - 1
                left -= need[i]
            if remaining and left[0] >= 1 and left[1] >= 1:
                i = self._cut_at(items, need, there, left)
                if i is not None:
                    key, start, length, loss = items[i]
                    size = int(left[0])
                    head = max(0, size - (length - loss))
                    placed.append((key, start, size, head))
                    items[i] = (key, start + size, length - size, loss - head)
                    need[i] = (length - size, 1, loss - head)
            yield placed
        self._waiting = [p for p, t in zip(items, there, strict=True) if t]

    def _cut_at(self, items, need, there, left) -> int | None:
        """A waiting piece whose beginning fills the rest of the sequence: the longest that keeps the loss limit."""
        able = there & (need[:, 0] > left[0]) & (np.maximum(0, left[0] - (need[:, 0] - need[:, 2])) <= left[2])
        if not able.any():
            return None
        return int(np.where(able, need[:, 0], -1).argmax())


def powers(total: int) -> list[int]:
    """The powers of two that sum to ``total``, largest first."""
    return [1 << i for i in range(total.bit_length() - 1, -1, -1) if total >> i & 1]


def split_short(sequence: list[tuple], capacity: int) -> list[list[tuple]]:
    """A short sequence as sequences whose lengths are powers of two; nothing is padded then."""
    total = sum(p[2] for p in sequence)
    if total >= capacity or total & (total - 1) == 0:
        return [sequence]
    out, pieces = [], [list(p) for p in reversed(sequence)]
    for size in powers(total):
        part = []
        while size:
            key, start, length, loss = pieces[-1]
            take = min(size, length)
            head = max(0, take - (length - loss))
            part.append((key, start, take, head))
            size -= take
            if take == length:
                pieces.pop()
            else:
                pieces[-1] = [key, start + take, length - take, loss - head]
        out.append(part)
    return out


#: Parts in one call of the library.
RUN = 1 << 11
#: Fixed value: what the last token of each word ends with in the vocabulary.
END_OF_WORD = "</w>"
#: Fixed value: the pattern by which this tokenizer cuts lower-cased text before it merges bytes.
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: One part of lower-cased Latin-1 text.
LATIN_PART = regex.compile(r"[a-zªµºß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9²³¹¼-¾]|[!-/:-@\[-`{-~¡-©«¬®-±´¶-¸»¿×÷]+")


#: The same cut as blanks around what is no run of letters, for texts of printable Latin-1 characters and white space.
CUT = r"'(?:s|t|re|ve|m|ll|d)|[^\s\v\pL\pN]+|\pN"
#: Texts that need the library's own cut: other characters, or what may be a special token.
OTHER = r"[^\t\n\v\f\r -~¡-¬®-ÿ]|<\|"


def split_parts(texts: pa.Array) -> pa.ListArray:
    """The parts of each text, lower-cased; texts of other than Latin-1 characters are cut at white space only."""
    other = pc.match_substring_regex(texts, OTHER)
    if pc.any(other).as_py():
        plain, rest = split_parts(texts.filter(pc.invert(other))), pc.ascii_split_whitespace(texts.filter(other))
        order = np.argsort(np.argsort(np.asarray(other), kind="stable"), kind="stable")
        return pa.concat_arrays([plain, rest]).take(pa.array(order))
    return pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), CUT, r" \0 "))


class NewWords:
    """Token ids of words and parts not seen before, as little-endian 32-bit bytes.

    White space is dropped by this tokenizer before it looks for words, so the
    ids of a text are those of its parts, end to end (see ``words``).  Parts go
    to the library in long runs with blanks between them, and the ids are cut
    again after each token that ends a word.  Words that are not known to be one
    part go to the library by themselves.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        about = json.loads(self._library.to_str())
        if (about["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != PARTS.pattern
                or about["model"]["end_of_word_suffix"] != END_OF_WORD):
            raise ValueError("the tokenizer cuts text in another way")
        vocabulary = self._library.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for token, i in vocabulary.items() if token.endswith(END_OF_WORD)]] = True

    def _library_ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self._library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, words: list[str]) -> list[bytes]:
        found = {}
        parts = [w for w in words if LATIN_PART.fullmatch(w)]
        for i in range(0, len(parts), RUN):
            run = parts[i: i + RUN]
            ids = self._library_ids([" ".join(run)])[0]
            stops = (4 * (np.flatnonzero(self._ends[ids]) + 1)).tolist()
            data = ids.tobytes()
            found.update(zip(run, (data[a:b] for a, b in zip([0, *stops], stops, strict=False)), strict=True))
        rest = [w for w in words if w not in found]
        found.update(zip(rest, (ids.tobytes() for ids in self._library_ids(rest)), strict=True))
        return [found[w] for w in words]


@lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    """The tokenizer of this file, loaded once by a Python worker."""
    return WordIds(NewWords(path).encode, split_parts)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, segments: int = SEGMENTS, loss_limit: int | None = None,
                   loss_share: float = 1.0, pool: int = POOL, end: int = END, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row per piece.  The last ``loss_share`` of a document's tokens bear loss (1.0: all, as in pretraining)."""
    if not 0.0 <= loss_share <= 1.0:
        raise ValueError("loss_share must lie between 0 and 1")
    tail = np.array([end], "<u4").tobytes()
    kind = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])

    def run(batches):
        ids = word_ids(path)
        packer = Packer(capacity, segments, loss_limit, pool)
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 33
        known: dict[int, list] = {}  # per waiting document: doc_id, ids, tokens not yet placed
        number, rows = 0, [[] for _ in kind]

        def emit(placed):
            nonlocal sequence
            total, at = sum(p[2] for p in placed), 0
            for key, start, length, loss in placed:
                doc_id, data, left = known[key]
                values = (doc_id, start, length, zlib.crc32(data[4 * start: 4 * (start + length)]), len(data) // 4, sequence, at,
                          loss, total)
                for column, value in zip(rows, values, strict=True):
                    column.append(value)
                at += length
                known[key][2] = left - length
                if left == length:
                    del known[key]
            sequence += 1

        def taken():
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], schema=kind)
            for c in rows:
                c.clear()
            return batch

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, texts in blocks(batch.column(1)):
                flat, bounds = ids.ids(texts)
                block, bounds = flat.tobytes(), (4 * bounds).tolist()
                for i in range(len(texts)):
                    doc_id, data = doc_ids[first + i], block[bounds[i]: bounds[i + 1]] + tail
                    number += 1
                    known[number] = [doc_id, data, len(data) // 4]
                    for placed in packer.add(number, len(data) // 4, round(len(data) // 4 * loss_share)):
                        for part in split_short(placed, capacity):
                            emit(part)
            if rows[0]:
                yield taken()
        for placed in packer.finish():
            for part in split_short(placed, capacity):
                emit(part)
        if rows[0]:
            yield taken()
        ids.forget()

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
