"""Token ids of many texts at once, through their distinct words.

For tokenizers that drop white space before they look for words: the ids of a
text are then the ids of its words, end to end.  A block of texts is split and
dictionary-encoded in Arrow, only its distinct words are looked up (or encoded,
where they are new), and the ids of all words are gathered by one ``take``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a block; a longer text is a block by itself.
BLOCK = 1 << 22
#: Words whose ids are kept between blocks.
KEPT = 1 << 19


def blocks(texts: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive slices of ``texts`` with their first row, each of about ``size`` bytes; nulls become empty."""
    texts = texts.fill_null("")
    ends = np.cumsum(np.asarray(pc.binary_length(texts), np.int64))
    start = 0
    while start < len(texts):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield start, texts.slice(start, stop - start)
        start = stop


def gather(table: pa.Array, picks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The picked entries of a large-binary table end to end: their bytes, and where each begins (and the last ends)."""
    taken = table.take(picks)
    _, offsets, data = taken.buffers()
    at = np.frombuffer(offsets, np.int64, len(taken) + 1, 8 * taken.offset) if len(taken) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8)[: at[-1]] if data is not None else np.zeros(0, np.uint8)), at


class WordIds:
    """Ids of texts by their words.

    ``encode`` gives the little-endian 32-bit ids of words it has not seen;
    ``split`` cuts texts into words whose ids, end to end, are those of the text.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], split: Callable[[pa.Array], pa.ListArray] = pc.ascii_split_whitespace,
                 kept: int = KEPT):
        self._encode, self._split, self._kept, self._known = encode, split, kept, {}

    def forget(self) -> None:
        """Drop the words kept, for a worker process that goes on with other work."""
        self._known.clear()

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text's ids begin (and the last ends)."""
        words = self._split(texts)
        coded = words.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        known = self._known
        if len(known) + len(names) > self._kept:
            known.clear()
        new = [w for w in names if w not in known]
        known.update(zip(new, self._encode(new), strict=True))
        data, at = gather(pa.array([known[w] for w in names], pa.large_binary()), coded.indices)
        first = np.asarray(words.offsets, np.int64)
        return data.view("<u4"), at[first - first[0]] // 4
