"""Token counts by a compiled finite-state transducer.

A piece vocabulary whose merges are ranked by score is compiled, lazily, into
a deterministic transducer over characters.  Two facts make it finite:

* a sequence of pieces is the segmentation of its text if and only if every
  two neighbours are the segmentation of theirs, so the last piece of each
  prefix is the only one that is compatible with the last piece before it;
* a later piece can only begin where the text since then is the start of some
  piece, so older positions can be forgotten.

A state is therefore the longest suffix that begins a piece, with the last
piece and the relative count at each of its positions; a transition reads one
character and emits the change of the token count.  Between a character that
is no space and a space no piece can span (checked on the vocabulary), and
none spans a character outside the vocabulary, so the transducer is back in its
start state there.  A chunk of text is thus a map of states with a simple form:
what it reads before the first such border (its effect depends on the state it
is entered with), a constant count, and what it reads after the last border.
Such maps compose associatively, and a long text is the scan of its chunks'
maps.  The constant part is summed over whole segments, whose counts from the
start state are memoised (bounded).

Defined results: a null or empty text has 0 bytes and 0 tokens; rows come back
as often as they were given, a null id included; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerlens.llm.common import Memo, id_and_text, per_batch

SPACE = "▁"
#: Characters read by one chunk map.
CHUNK = 1 << 20
#: A segment: spaces and what follows them up to the next space or line break.
SEGMENT = re.compile("▁*[^▁\n]+|▁+|\n")


class Transducer:
    """The counting transducer of a scored piece vocabulary (``{piece: score}``)."""

    def __init__(self, scores: dict[str, float], byte_fallback: bool, limit: int = 1 << 18):
        spanning = [p for p in scores if re.search(f"[^{SPACE}]{SPACE}", p)]
        if spanning or "\n" in scores:
            raise ValueError("a piece spans a border between segments")
        self._scores, self._bytes, self._limit = scores, byte_fallback, limit
        self._begins = {p[:k] for p in scores for k in range(1, len(p))}
        self._single: Memo = Memo(lambda p: self._merge(p) == [p], longest=64)
        self._pair: dict[tuple[str, str], bool] = {}
        self._reset()

    def _reset(self) -> None:
        # state: (suffix that begins a piece, for each position within it: (last piece there, count there minus count now))
        self._ids: dict[tuple, int] = {("", ((None, 0),)): 0}
        self._states: list[tuple] = [("", ((None, 0),))]
        self._next: list[dict[str, tuple[int, int]]] = [{}]

    def _merge(self, text: str) -> list[str]:
        """The segmentation of a short text: the best-scored neighbours merge first, the leftmost of equals."""
        parts = list(text)
        while True:
            best = max(((self._scores[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))
                        if a + b in self._scores), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i: i + 2] = [parts[i] + parts[i + 1]]

    def _fits(self, left: str | None, piece: str) -> bool:
        if left is None:
            return self._single[piece]
        known = self._pair.get((left, piece))
        if known is None:
            if len(self._pair) >= 1 << 20:
                self._pair.clear()
            known = self._pair[left, piece] = self._merge(left + piece) == [left, piece]
        return known

    def _step(self, state: int, ch: str) -> tuple[int, int]:
        """Read one character: the next state and the change of the count."""
        suffix, trail = self._states[state]
        for back in range(len(suffix) + 1):  # position ``back`` characters before now; trail[0] is now
            piece = suffix[len(suffix) - back:] + ch
            if piece in self._scores or back == 0:
                last, count = trail[back]
                if self._fits(last, piece):
                    emitted = count + self._size(piece)
                    break
        else:
            raise AssertionError(f"no piece ends at {ch!r} after {suffix!r}")
        longer = suffix + ch
        keep = next(k for k in range(len(longer), -1, -1) if longer[len(longer) - k:] in self._begins or not k)
        now = [(piece, 0)]
        for back in range(1, keep + 1):  # only positions from which a piece can still begin
            p = trail[back - 1]
            now.append((p[0], p[1] - emitted) if p and longer[len(longer) - back:] in self._begins else None)
        new = (longer[len(longer) - keep:], tuple(now))
        at = self._ids.get(new)
        if at is None:
            at = self._ids[new] = len(self._states)
            self._states.append(new)
            self._next.append({})
        self._next[state][ch] = at, emitted
        return at, emitted

    def _size(self, piece: str) -> int:
        return len(piece.encode()) if self._bytes and piece not in self._scores else 1

    def run(self, text: str) -> int:
        """Tokens of a text (spaces already escaped) from the start state."""
        if len(self._states) > self._limit:
            self._reset()
        state = total = 0
        for ch in text:
            move = self._next[state].get(ch)
            state, emitted = move if move else self._step(state, ch)
            total += emitted
        return total


class ChunkMap(NamedTuple):
    """What a chunk does to any state: ``head`` is read in the state it is entered with, ``tail`` is left open.

    ``border`` is False if the chunk has no border; then ``head`` is the whole chunk.
    """

    border: bool
    head: str
    count: int
    tail: str


def chunk_map(text: str, counts: Memo) -> ChunkMap:
    # a border lies before a space that follows another character, and on both sides of a line break
    first = re.search(f"(?<=[^{SPACE}])(?={SPACE})|(?=\n)|(?<=\n)", text)
    if first is None:
        return ChunkMap(False, text, 0, "")
    last = max(text.rfind("\n") + 1, text.rfind("\n"), _last_space_border(text))
    last = max(last, first.start())
    return ChunkMap(True, text[: first.start()], sum(map(counts.__getitem__, SEGMENT.findall(text, first.start(), last))), text[last:])


def _last_space_border(text: str) -> int:
    at = text.rfind(SPACE)
    while at > 0 and text[at - 1] == SPACE:
        at -= 1
    return at if at > 0 else 0


def compose(a: ChunkMap, b: ChunkMap, counts: Memo) -> ChunkMap:
    """The map of chunk ``a`` followed by ``b``; associative."""
    if not a.border and not b.border:
        return chunk_map(a.head + b.head, counts)
    if not a.border:
        joined = chunk_map(a.head + b.head, counts)
        if not joined.border:
            return ChunkMap(True, joined.head, b.count, b.tail)
        return ChunkMap(True, joined.head, joined.count + counts[joined.tail] * bool(joined.tail) + b.count, b.tail)
    middle = a.tail + b.head
    inner = chunk_map(middle, counts)
    if b.border:
        return ChunkMap(True, a.head, a.count + sum(map(counts.__getitem__, SEGMENT.findall(middle))) + b.count, b.tail)
    if not inner.border:
        return ChunkMap(True, a.head, a.count, middle)
    return ChunkMap(True, a.head, a.count + counts[inner.head] * bool(inner.head) + inner.count, inner.tail)


def scan(maps: list[ChunkMap], counts: Memo) -> ChunkMap:
    """Composition of the maps of consecutive chunks, pairwise as a balanced tree."""
    while len(maps) > 1:
        maps = [reduce(lambda a, b: compose(a, b, counts), maps[i: i + 2]) for i in range(0, len(maps), 2)]
    return maps[0]


def count_tokens(text: str | None, counts: Memo, chunk: int = CHUNK) -> int:
    """Tokens of one text; the vocabulary puts a space before it."""
    if not text:
        return 0
    flat = SPACE + text.replace(" ", SPACE)
    if len(flat) <= chunk:
        return sum(map(counts.__getitem__, SEGMENT.findall(flat)))
    whole = scan([chunk_map(flat[i: i + chunk], counts) for i in range(0, len(flat), chunk)], counts)
    return whole.count + sum(counts[s] for s in (whole.head, whole.tail) if s)


def load_transducer(path: str) -> Transducer:
    """Compile a sentencepiece model file; it must be a plain piece model (no text normalisation)."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as schema

    model = schema.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm = model.normalizer_spec
    if (model.trainer_spec.model_type != schema.TrainerSpec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces
            or not norm.add_dummy_prefix or not norm.escape_whitespaces):
        raise ValueError("only merge-ranked models without text normalisation are supported")
    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    scores = {pieces.id_to_piece(i): pieces.get_score(i) for i in range(pieces.get_piece_size())
              if not (pieces.is_control(i) or pieces.is_unknown(i) or pieces.is_byte(i))}
    return Transducer(scores, model.trainer_spec.byte_fallback)


#: Transducers compiled by this Python worker; tasks that follow on it go on with their states.
_COMPILED: dict[str, Memo] = {}


def counter(path: str) -> Memo:
    if path not in _COMPILED:
        _COMPILED[path] = Memo(load_transducer(path).run, 1 << 19)
    return _COMPILED[path]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) per row; ``path`` must exist on every executor."""
    def run(batches):
        counts = counter(path)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()),
                 pa.array([count_tokens(t, counts) for t in texts], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

        yield from per_batch(one)(batches)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
