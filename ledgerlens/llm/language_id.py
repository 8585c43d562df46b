"""Language identification with labelled spans of mixed-language text.

Training counts, over all labelled rows, hashed character n-grams and whole
words per language (a table of fixed size per language, summed in Spark), and
how often each script occurs per language.  For a text, the script of each word
narrows the candidate languages; every candidate gets the word's mean
log-probability as score; then a Viterbi pass finds the best path of languages
over the words, where each switch costs a penalty.  The language with most
letters on the path is the prediction, its share of the letters the score; the
path's runs are the spans.

Defined results: a null text or one without a letter gets ``und``, score 0 and
no span; with no labelled row every text gets ``und``; ties go to the language
that sorts first; a null id is returned like any other; rows that repeat come
back as often as they were given; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import id_and_text, offsets, per_batch, raw
from ledgerlens.llm.grams import SPACE, buckets, code_points, grams, letters

UNKNOWN = "und"
#: Hashed features per language.
BITS = 15
BUCKETS = 1 << BITS
#: A word's mean score counts for this many features at most.
LONGEST = 12
#: Cost of a switch of language, in nats of the summed word scores.
SWITCH = 12.0
#: A language is a candidate for a script that holds at least this share of its words.
SCRIPT_SHARE = 0.001
#: Words handled at once (a longer text is one block), which bounds the memory.
WORDS_AT_ONCE = 1 << 20
#: Words whose features are computed at once.
FEATURES_OF = 1 << 14

#: First code point of each script range, in ascending order (Unicode block bounds).
SCRIPT_RANGES = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Ethiopic"), (0x1780, "Khmer"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
    (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3200, "Han"), (0xA000, "Other"),
    (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0x20000, "Han"), (0x30000, "Other"),
)
_FIRSTS = np.array([a for a, _ in SCRIPT_RANGES])
SCRIPTS = tuple(dict.fromkeys(n for _, n in SCRIPT_RANGES))
_SCRIPT_OF_RANGE = np.array([SCRIPTS.index(n) for _, n in SCRIPT_RANGES])


class Words:
    """Arrays about words laid end to end: ``letters`` and ``script`` per word, and their hashed features.

    A word's features are the 2- and 3-grams of its lower-cased letters, with
    borders, and the whole of them.  The script is that of most of its letters,
    the first in ``SCRIPTS`` of equals; -1 without a letter.
    """

    def __init__(self, words: list[bytes]):
        points = code_points(" " + b" ".join(words).decode().lower() + " ")
        # lower-casing never makes a space, so words stay where they are
        letter, space = letters()[points], points == SPACE
        word = np.cumsum(space) - 1
        of, found = word[letter], points[letter]
        self.letters = np.bincount(of, minlength=len(words))
        if len(found) and int(found.max()) < _FIRSTS[1]:  # one script only
            self.script = np.where(self.letters > 0, 0, -1)
        else:
            script = _SCRIPT_OF_RANGE[np.searchsorted(_FIRSTS, found, side="right") - 1]
            table = np.bincount(of * len(SCRIPTS) + script, minlength=len(words) * len(SCRIPTS)).reshape(len(words), -1)
            self.script = np.where(self.letters > 0, table.argmax(axis=1), -1)
        kept = letter | space
        self._points, self._word, self._size = points[kept], word[kept], len(words)

    def features(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word, bucket) arrays, one pair per kind of feature; words ascend."""
        for at, bucket in grams(self._points, (2, 3), BITS):
            yield self._word[at], bucket
        begin = np.flatnonzero(self._points == SPACE)
        place = np.arange(len(self._points)) - begin[self._word]
        power = np.cumprod(np.full(int(place.max()) + 1, 0xC2B2AE3D27D4EB4F, np.uint64))
        values = self._points.astype(np.uint64) * power[place]
        yield np.arange(self._size), buckets(np.add.reduceat(values, begin[:-1]), BITS)


def _blocks(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    """The words of texts, some texts at a time."""
    block, held = [], 0
    for text in texts:
        words = (text or b"").split()
        if block and held + len(words) > WORDS_AT_ONCE:
            yield block
            block, held = [], 0
        block.append(words)
        held += len(words)
    if block:
        yield block


def training_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, bucket, n): feature counts of all labelled rows; the buckets after the last count scripts."""
    def run(batches):
        tables: dict[str, np.ndarray] = {}  # features, then scripts
        for batch in batches:
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(1).to_pylist(), raw(batch.column(0)), strict=True):
                texts.setdefault(lang, []).append(text)
            for lang, mine in texts.items():
                table = tables.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS), np.int64))
                for block in _blocks(mine):
                    words = [w for part in block for w in part]
                    for i in range(0, len(words), FEATURES_OF):
                        about = Words(words[i: i + FEATURES_OF])
                        for word, bucket in about.features():
                            table[:BUCKETS] += np.bincount(bucket[about.letters[word] > 0], minlength=BUCKETS)
                        table[BUCKETS:] += np.bincount(about.script + 1, minlength=len(SCRIPTS) + 1)[1:]
        for lang, table in tables.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                                              pa.array(table[at])], ["lang", "bucket", "n"])

    labelled = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(
        "text IS NOT NULL AND lang IS NOT NULL")
    return (labelled.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))


@dataclass
class Model:
    """Log-probabilities (language, bucket) and the languages allowed (script, language)."""

    langs: list[str]
    logp: np.ndarray
    allowed: np.ndarray


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from all rows of ``docs`` that have a text and a language; the table gathered has a fixed size per language."""
    found = training_counts(docs, id_col, text_col, lang_col).toArrow()
    langs = sorted(set(found.column("lang").to_pylist()))
    row = np.array([langs.index(x) for x in found.column("lang").to_pylist()], np.int64)
    bucket, n = found.column("bucket").to_numpy(), found.column("n").to_numpy().astype(np.float64)
    table = np.full((BUCKETS, max(1, len(langs))), 0.5)
    feature = bucket < BUCKETS
    np.add.at(table, (bucket[feature], row[feature]), n[feature])
    scripts = np.zeros((len(SCRIPTS), max(1, len(langs))))
    np.add.at(scripts, (bucket[~feature] - BUCKETS, row[~feature]), n[~feature])
    share = scripts / np.maximum(1, scripts.sum(axis=0))
    return Model(langs, np.log(table / table.sum(axis=0)).astype(np.float32).T.copy(),
                 share >= SCRIPT_SHARE)


def word_scores(model: Model, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Scores (word, language) and the number of letters per word.

    A word's score is its mean log-probability, times its number of features up to ``LONGEST``.
    """
    if len(words) > FEATURES_OF:  # arrays that fit the processor's cache
        parts = [word_scores(model, words[i: i + FEATURES_OF]) for i in range(0, len(words), FEATURES_OF)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    size, k = len(words), len(model.langs)
    about = Words(words)
    total, count = np.zeros((k, size)), np.zeros(size)
    for word, bucket in about.features():
        count += np.bincount(word, minlength=size)
        for j in range(k):
            total[j] += np.bincount(word, weights=model.logp[j][bucket], minlength=size)
    scores = (total * (np.minimum(count, LONGEST) / np.maximum(count, 1))).T.astype(np.float32)
    allowed = model.allowed[about.script][:, :k]
    some = allowed.any(axis=1)
    scores[some[:, None] & ~allowed] = -1e4
    scores[(about.script < 0) | ~some] = 0
    return scores, about.letters


def viterbi(scores: np.ndarray, starts: np.ndarray, switch: float) -> np.ndarray:
    """The best language of each word; texts are laid end to end and advance together, one word a step.

    ``scores`` is (words, languages), ``starts`` the first word of each text and the total.
    """
    lengths = np.diff(starts)
    order = np.argsort(-lengths, kind="stable")
    first, lengths = starts[:-1][order], lengths[order]
    steps = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right")  # texts that have a word at each step
    k = scores.shape[1]
    stays, best = np.zeros((len(scores), k), bool), np.zeros(len(scores), np.int32)
    value, every = np.zeros((len(order), k)), np.arange(len(order))
    for t in range(steps):
        n = active[t]
        at, v = first[:n] + t, value[:n]
        if t:
            top = v.argmax(axis=1)
            moved = (v[every[:n], top] - switch)[:, None]
            best[at], stays[at] = top, v >= moved
            np.maximum(v, moved, out=v)
        v += scores[at]
    path = np.zeros(len(scores), np.int64)
    now = value.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        at = first[:n] + t
        path[at] = here = now[:n]
        if t:
            now[:n] = np.where(stays[at, here], here, best[at])
    return path


def identify(docs: DataFrame, model: Model, switch: float = SWITCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, spans) per row; spans are runs of words [start, end) with their language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])

    def some(model: Model, parts: list[list[bytes]], out: list[list]) -> None:
        langs, starts = model.langs, offsets(np.array([len(p) for p in parts], np.int64))
        words = [w for p in parts for w in p]
        scores, letters = word_scores(model, words) if words else (np.zeros((0, len(langs))), np.zeros(0, np.int64))
        path = viterbi(scores, starts, switch) if langs else np.zeros(len(words), np.int64)
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            mine, weight = path[a:b], letters[a:b]
            if not langs or not weight.any():
                for column, v in zip(out, (UNKNOWN, 0.0, []), strict=True):
                    column.append(v)
                continue
            by = np.bincount(mine, weights=weight, minlength=len(langs))
            edge = np.concatenate(([0], np.flatnonzero(np.diff(mine)) + 1, [b - a])).tolist()
            out[0].append(langs[int(by.argmax())])
            out[1].append(float(by.max() / by.sum()))
            out[2].append([{"start": i, "end": j, "lang": langs[mine[i]]} for i, j in zip(edge, edge[1:], strict=False)])

    def run(batches):
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[], [], []]
            for parts in _blocks(raw(batch.column(1))):
                some(shared.value, parts, out)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()),
                                               pa.array(out[2], pa.list_(span))], ["doc_id", "lang_pred", "score", "spans"])

        yield from per_batch(one)(batches)

    return id_and_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, lang_pred string, score double, spans array<struct<start: int, end: int, lang: string>>")
