"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

The tokenizer file gives the vocabulary and the merges; the library only cuts
texts into parts (its normalizer and pre-tokenizer), the merging is done here.

**Encoding.**  An Aho-Corasick automaton over all tokens reads a part once and
tells the longest token that begins at each place.  Tokens are taken from left
to right, the longest first.  A token may follow another only if merging the
two side by side leaves them apart; ``Merges.apart`` decides that from the
merges alone, by undoing the later of the two last merges again and again and
asking whether a pair across the border would have been merged before.  Where
no token fits, the next shorter prefix is tried, and where none is left the
last token is taken back and its end closed for good.  Each place is closed
once at most, so the time is linear in the part's length.  A sequence whose
neighbours all stay apart is the one that the merges produce, and there is only
one.  Tokens that the merges never produce (another merge comes first inside
them) are left out of the automaton.

**Decoding.**  The tokens' texts lie end to end in one buffer with an offset
per id, and the texts of a block of ids are gathered in one step.  This
tokenizer has no decoder, so decoding writes the tokens' names with a blank
between them.

Defined results: a null or empty text has no ids and decodes to the empty text;
strings of special tokens inside a text become those tokens, as the library
does by default; a null id passes through, rows that repeat are encoded each,
an empty table gives an empty result, and other columns never travel, so their
names cannot clash.  Texts are worked on whole, a few megabytes at once; one
longer text is held by itself.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ledgerlens.llm.common import Memo, id_and_text, per_batch
from ledgerlens.llm.words import WordIds, blocks, gather

#: Fixed value: the pattern by which this tokenizer cuts lower-cased text before it merges bytes.
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Stands for the end of a part inside the automaton; the byte alphabet has no blank.
END = " "
ENCODED = "doc_id long, n_tokens long, ids binary"


class Merges:
    """The merges of a vocabulary: the two halves of each token, and which tokens stay apart side by side.

    Ids must rise in the order of the merges, after the single symbols.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        self.texts: dict[int, str] = {}
        made, last = {a + b for a, b in merges}, -1
        for name, i in vocabulary.items():
            if name not in made:
                symbol, ends = name.removesuffix(suffix) if suffix else name, bool(suffix) and name.endswith(suffix)
                if len(symbol) == 1:
                    self.texts[i] = symbol + END * ends
                    last = max(last, i)
        for a, b in merges:
            x, y, i = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if i <= last or i in self.halves:
                raise ValueError("the ids of this vocabulary do not follow its merges")
            last = i
            self.halves[i], self.pairs[x, y] = (x, y), i
            self.texts[i] = self.texts[x] + self.texts[y]
        self.made = set(self.texts)  # tokens that the merges really produce
        for i, (x, y) in self.halves.items():
            if x not in self.made or y not in self.made or not self.apart(x, y, i):
                self.made.discard(i)

    def apart(self, left: int, right: int, until: float = float("inf")) -> bool:
        """Whether no merge before ``until`` joins two tokens across their border.

        A pair is merged before its neighbours take a part of it away: the left
        part's own merge wins only if it is earlier, the right part's also if it
        is the same merge, since equal merges go from left to right.
        """
        halves, pairs = self.halves, self.pairs
        while True:
            if pairs.get((left, right), until) < until:
                return False
            if left > right and left in halves:
                until, left = left, halves[left][1]
            elif right in halves:
                until, right = right + 1, halves[right][0]
            elif left in halves:
                until, left = left, halves[left][1]
            else:
                return True


class Encoder:
    """Ids of a part: a run of symbols that ends with ``END``."""

    def __init__(self, merges: Merges):
        texts = merges.texts
        ids = {texts[i]: i for i in merges.made}
        self._automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for text, i in ids.items():
            self._automaton.add_word(text, (i, len(text) - 1))
        self._automaton.make_automaton()
        self._length = {i: len(text) for text, i in ids.items()}
        self._shorter = {i: next((ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in ids), None) for t, i in ids.items()}
        self._apart = Memo(lambda pair: merges.apart(*pair))

    def encode(self, part: str) -> list[int]:
        size = len(part)
        longest = [None] * size
        for end, (token, back) in self._automaton.iter(part):
            longest[end - back] = token  # ends rise, so the longest token of a place comes last
        shorter, length, apart = self._shorter, self._length, self._apart
        closed = bytearray(size + 1)
        closed[size - 1] = 1  # the end mark is never a token by itself
        found: list[int] = []
        at, token = 0, longest[0]
        while at < size:
            while token is not None:
                if not closed[at + length[token]] and (not found or apart[found[-1], token]):
                    break
                token = shorter[token]
            if token is not None:
                found.append(token)
                at += length[token]
                token = longest[at] if at < size else None
            elif found:
                closed[at] = 1
                token = found.pop()
                at -= length[token]
            else:
                raise ValueError(f"no tokens for {part!r}")
        return found


class Tokenizer:
    """A vocabulary file of the ``tokenizers`` library: words to ids, and ids to texts."""

    def __init__(self, path: str, parts_kept: int = 1 << 19):
        from tokenizers import Tokenizer as Library

        with open(path, encoding="utf-8") as f:
            about = json.load(f)
        model, cut = about["model"], about["pre_tokenizer"]["pretokenizers"]
        if (model["type"] != "BPE" or not model["end_of_word_suffix"] or about["decoder"] is not None
                or [p["type"] for p in cut] != ["Split", "ByteLevel"] or cut[0]["pattern"]["Regex"] != PARTS.pattern):
            raise ValueError("the tokenizer cuts or decodes text in another way")
        library = Library.from_file(path)
        self._normal, self._cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self._special = {t["content"]: t["id"] for t in about["added_tokens"]}
        self._specials = regex.compile("(" + "|".join(map(regex.escape, self._special)) + ")")
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self._encoder = Encoder(Merges(model["vocab"], merges, model["end_of_word_suffix"]))
        self._parts = Memo(lambda p: array("I", self._encoder.encode(p + END)).tobytes(), limit=parts_kept)
        names = {i: name for name, i in (model["vocab"] | self._special).items()}
        self._names = pa.array([f" {names[i]}" if i in names else "" for i in range(max(names) + 1)], pa.large_binary())
        self.words = WordIds(self._encode)

    def _encode(self, words: list[str]) -> list[bytes]:
        return [b"".join(map(self._parts.__getitem__, PARTS.findall(w.lower()))) if w.isascii() and w.isprintable() and "<|" not in w
                else self._any(w) for w in words]

    def _any(self, word: str) -> bytes:
        """A word of any characters: special tokens come first, then the library's own cuts."""
        out = []
        for i, piece in enumerate(self._specials.split(word)):
            if i % 2:
                out.append(array("I", [self._special[piece]]).tobytes())
            elif piece:
                out += [self._parts[part] for part, _ in self._cut(self._normal(piece))]
        return b"".join(out)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The texts of the ids between each two bounds: names of tokens, with a blank between them."""
        data, at = gather(self._names, pa.array(ids))
        ends = at[bounds]
        empty = (bounds[1:] == bounds[:-1])
        offsets = np.zeros(len(bounds), np.int64)
        np.cumsum(np.diff(ends) - ~empty, out=offsets[1:])  # less the blank before the first token of each text
        keep = np.ones(len(data), bool)
        keep[ends[:-1][~empty]] = False
        return pa.Array.from_buffers(pa.large_utf8(), len(empty), [None, pa.py_buffer(offsets), pa.py_buffer(data[keep])])


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of this file, loaded once by a Python worker."""
    return Tokenizer(path)


def _packed(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary of little-endian 32-bit ids per text."""
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds * 4), pa.py_buffer(np.ascontiguousarray(ids))])


def encode(docs: DataFrame, path: str, decoded: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's ids, as little-endian 32-bit integers; with ``decoded`` also the text that they decode to."""
    def run(batches):
        own = tokenizer(path)
        for batch in batches:
            for start, texts in blocks(batch.column(1)):
                ids, bounds = own.words.ids(texts)
                columns = [batch.column(0).slice(start, len(texts)), pa.array(np.diff(bounds)), _packed(ids, bounds).cast(pa.binary())]
                names = ["doc_id", "n_tokens", "ids"]
                if decoded:
                    columns.append(own.decode(ids, bounds).cast(pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, ENCODED + ", decoded string" * decoded)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The text of each row of packed ids; null ids give the empty text."""
    def run(batch):
        packed = batch.column(1).fill_null(b"")
        bounds = np.zeros(len(packed) + 1, np.int64)
        np.cumsum([len(x) // 4 for x in packed.to_pylist()], out=bounds[1:])
        ids = np.frombuffer(b"".join(packed.to_pylist()), "<u4")
        text = tokenizer(path).decode(ids, bounds).cast(pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), text], names=["doc_id", "decoded"])

    rows = encoded.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{ids_col}` ids")
    return rows.mapInArrow(per_batch(run), "doc_id long, decoded string")
