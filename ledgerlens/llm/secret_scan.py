"""Secret scans: candidates judged by a random forest trained on labelled findings.

A candidate is a run of at least ``SHORTEST`` characters of ``A-Za-z0-9+/_.~-``
that is not part of a longer word and not just a plain lower-case or
capitalised word, or the whole value assigned to a credential's name, quoted
or up to the next blank, of any length and characters.  Where candidates
overlap, the longest one judged to be a secret is reported.  The features are length, shares and transitions of character
classes, entropy, how much of it and of the words beside it the corpus
dictionary covers, whether it looks like a path, and what stands before it.
The dictionary is counted over all documents and holds the most frequent words.

The forest is grown in Spark tasks, a tree per task, from a bounded sample of
labelled findings (``SAMPLE`` per label, in the order of a hash of the finding;
equal findings count once, so copies of documents do not crowd out others).
:func:`rule_labels` labels findings by narrow rules where no reviewed labels
exist; any table with the same columns can take its place.

Defined results: null and empty texts have no candidate; with labels of one
kind, or none, every candidate gets the label's constant (0 without labels);
a null id is returned like any other; rows that repeat come back as often as
they were given; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import os
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import id_and_text, per_batch, raw, shuffle_parts, stored

SHORTEST = 12
#: Words in the dictionary.
DICTIONARY = 5000
#: Labelled findings per label used by the fit, at most.
SAMPLE = 10_000
TREES, DEPTH, LEAF, CUTS = 24, 8, 4, 24
#: Characters of context kept on each side of a candidate.
AROUND = 32
MASK = "[SECRET]"

CANDIDATE = re.compile(r"(?<![\w+/.~-])[A-Za-z0-9+/_.~-]{12,}+(?!\w)")
#: What names a credential, and what marks a sample value.
NAMED = re.compile(r"(key|token|secret|passw(or)?d|pwd|passphrase|auth|credential|bearer|apikey)", re.I)
SAMPLED = re.compile(r"(example|sample|dummy|test|placeholder|changeme|xxxx|your[_-])", re.I)
ASSIGNED = re.compile(r"[=:]>?\s*[\"']?$")
#: A sign of assignment, a value, quoted or up to the next blank, and what stands before the sign if it names a credential.
SIGN = re.compile(r"[=:]+>?[ \t]*")
VALUE = re.compile(r"""(?:"((?:[^"\\\n]|\\.)+)"|'((?:[^'\\\n]|\\.)+)'|["']?([^\s"'=:]\S*))""")
CREDENTIAL = re.compile(r"(key|token|secret|passw(or)?d|pwd|passphrase|auth|credential|bearer)s?([_-]\w+)*[\"']?\s*$", re.I)
#: Characters before the sign that are searched for a name.
NAME = 48
WORD = re.compile(r"[a-z]{3,12}")
#: Shapes of well-known keys, used to label findings.
KNOWN_SHAPE = re.compile(r"(AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}")
NAMED_VALUE = re.compile(r"(key|token|secret|passw(or)?d|pwd)[\"']?\s*[=:]+>?\s*[\"']?$", re.I)
#: Assigned values shorter than this are not labelled as secrets.
LABELLED = 6

TAIL, CLOSING = ".,;-~\"'", {")": "(", "]": "[", "}": "{", ">": "<"}

FEATURES = ("length", "digits", "uppers", "lowers", "symbols", "transitions", "distinct", "entropy", "longest_run", "hex",
            "covered", "path", "named", "assigned", "quoted", "beside_covered", "sampled")


def dictionary(docs: DataFrame, size: int = DICTIONARY, text_col: str = "text") -> list[str]:
    """The ``size`` most frequent words of 3 to 12 letters a-z over all texts."""
    def run(batches):
        found: Counter = Counter()

        def flushed():
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())],
                                             ["word", "n"])
            found.clear()
            return out

        for batch in batches:
            words = Counter(w for t in raw(batch.column(0)) for w in (t or b"").split())
            for w, n in words.items():
                if 3 <= len(w) <= 16:
                    plain = w.strip(b".,;:!?\"'()").lower()
                    if 3 <= len(plain) <= 12 and plain.isalpha():
                        found[plain.decode()] += n
            if len(found) > 1 << 18:
                yield flushed()
        if found:
            yield flushed()

    counts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word string, n long")
    top = counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size)
    return top.toArrow().column("word").to_pylist()


def _plain(value: str) -> bool:
    return value.isalpha() and (value.islower() or value[1:].islower())


def _assigned(text: str) -> list[tuple[int, int]]:
    """(start, end) of the values assigned to a credential's name."""
    out, past = [], 0
    for sign in SIGN.finditer(text):
        if sign.start() < past or not CREDENTIAL.search(text[max(0, sign.start() - NAME): sign.start()]):
            continue
        m = VALUE.match(text, sign.end())
        if m:
            a, b = m.span(m.lastindex)
            if m.lastindex == 3:  # not quoted: what closes the sentence or a bracket around it is not part of it
                past, value = b, text[a:b].rstrip(TAIL)
                while value[-1:] in CLOSING and value.count(value[-1]) > value.count(CLOSING[value[-1]]):
                    value = value[:-1].rstrip(TAIL)
                b = a + len(value)
            if a < b:
                out.append((a, b))
    return out


def candidates(text: str | None) -> list[tuple[int, int, str, str, str]]:
    """(start, end, value, text before, text after) of each candidate of a text, in order of their starts."""
    text, spans = text or "", set()
    for m in CANDIDATE.finditer(text):
        value = m.group().rstrip(".-~")
        if len(value) >= SHORTEST and not _plain(value):
            spans.add((m.start(), m.start() + len(value)))
    return [(a, b, text[a:b], text[max(0, a - AROUND): a], text[b: b + AROUND]) for a, b in sorted(spans.union(_assigned(text)))]


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def _covered(text: str, known: frozenset) -> float:
    """Share of the letters a-z run of ``text`` that dictionary words cover, longest match first."""
    low, at, hit = text.lower(), 0, 0
    while at < len(low):
        size = next((n for n in range(min(12, len(low) - at), 2, -1) if low[at: at + n] in known), 0)
        hit += size
        at += size or 1
    return hit / max(1, len(low))


def features(value: str, before: str, after: str, known: frozenset) -> list[float]:
    kinds = [_kind(c) for c in value]
    n, counts = len(value), Counter(value)
    shares = [kinds.count(k) / n for k in range(4)]
    run = longest = 1
    for a, b in zip(kinds, kinds[1:], strict=False):
        run = run + 1 if a == b else 1
        longest = max(longest, run)
    beside = WORD.findall((before + " " + after).lower())
    return [float(n), *shares, sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1), len(counts) / n,
            -sum(c / n * math.log2(c / n) for c in counts.values()), longest / n,
            float(all(c in "0123456789abcdefABCDEF" for c in value)), _covered(value, known),
            (value.count("/") + value.count(".")) / n + float(before.endswith(("/", "@", "://"))),
            float(bool(NAMED.search(before[-24:]))), float(bool(ASSIGNED.search(before))), float(before[-1:] in "\"'" and before != ""),
            sum(w in known for w in beside) / max(1, len(beside)), float(bool(SAMPLED.search(value) or SAMPLED.search(before[-16:])))]


def _label(value: str, before: str) -> int | None:
    if KNOWN_SHAPE.fullmatch(value):
        return 1
    if NAMED_VALUE.search(before) and not SAMPLED.search(value):
        if any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
            return 1 if len(value) >= LABELLED else None
        if len(value) >= SHORTEST and (value.isalpha() or not value.isalnum()):
            return None
    return 0


def rule_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(value, before, after, label) of all candidates, labelled by narrow rules.

    1: the shape of a well-known key, or a value of mixed classes assigned to a credential's name.
    Null, not used for training: an assigned value the rules cannot tell, such as a long one without digits.
    """
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(v, x, y, _label(v, x)) for t in batch.column(1).to_pylist() for _, _, v, x, y in candidates(t)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4,
                                          (pa.string(), pa.string(), pa.string(), pa.int32()), strict=True)],
                                          ["value", "before", "after", "label"])

    return id_and_text(docs, id_col, text_col).mapInArrow(per_batch(run), "value string, before string, after string, label int")


@dataclass
class Forest:
    """Trees as arrays: feature (-1 at a leaf), threshold, left child, right child, share of secrets."""

    known: frozenset
    trees: list[tuple[np.ndarray, ...]]
    constant: float = 0.0
    key: str = field(default_factory=lambda: os.urandom(8).hex())

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.full(len(x), self.constant)
        total = np.zeros(len(x))
        for feature, threshold, left, right, share in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                inner = feature[at] >= 0
                go = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            total += share[at]
        return total / len(self.trees)


def grow(x: np.ndarray, y: np.ndarray, seed: int) -> tuple[np.ndarray, ...]:
    """One tree on a bootstrap sample; every split looks at a random subset of the features."""
    rng = np.random.default_rng(seed)
    pick = rng.integers(0, len(x), len(x))
    x, y = x[pick], y[pick]
    nodes: list[list] = []
    todo = [(np.arange(len(x)), 0, -1, 0)]
    while todo:
        rows, depth, parent, side = todo.pop()
        at, mean = len(nodes), float(y[rows].mean())
        nodes.append([-1, 0.0, 0, 0, mean])
        if parent >= 0:
            nodes[parent][2 + side] = at
        if depth >= DEPTH or len(rows) < 2 * LEAF or mean in (0.0, 1.0):
            continue
        best = (mean * (1 - mean) - 1e-9, None)
        for f in rng.permutation(x.shape[1])[: max(1, round(math.sqrt(x.shape[1])))]:
            column = x[rows, f]
            for cut in np.unique(np.quantile(column, np.linspace(0, 1, CUTS + 2)[1:-1])):
                left = column <= cut
                n = int(left.sum())
                if min(n, len(rows) - n) < LEAF:
                    continue
                a, b = y[rows[left]].mean(), y[rows[~left]].mean()
                impurity = (n * a * (1 - a) + (len(rows) - n) * b * (1 - b)) / len(rows)
                if impurity < best[0]:
                    best = (impurity, (int(f), float(cut), left))
        if best[1]:
            f, cut, left = best[1]
            nodes[at][:2] = [f, cut]
            todo += [(rows[~left], depth + 1, at, 1), (rows[left], depth + 1, at, 0)]
    columns = list(zip(*nodes, strict=True))
    return (*(np.array(c, t) for c, t in zip(columns, (np.int64, np.float64, np.int64, np.int64, np.float64), strict=True)),)


def fit(labelled: DataFrame, known: list[str], sample: int = SAMPLE, trees: int = TREES) -> Forest:
    """Train on (value, before, after, label): at most ``sample`` different findings of each label."""
    words = frozenset(known)
    labelled = stored(labelled.where("label IN (0, 1) AND value IS NOT NULL")
                      .select("value", F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"),
                              "label").distinct(), "secret-findings")
    order = F.xxhash64("value", "before", "after")
    rows = [r for k in (0, 1) for r in labelled.where(F.col("label") == k).orderBy(order, "value", "before", "after").limit(sample)
            .toArrow().to_pylist()]
    y = np.array([r["label"] for r in rows], np.float64)
    if len(set(y.tolist())) < 2:
        return Forest(words, [], float(y.mean()) if len(y) else 0.0)
    x = np.array([features(r["value"], r["before"], r["after"], words) for r in rows])
    spark = labelled.sparkSession
    shared = spark.sparkContext.broadcast((x, y))

    def run(batches):
        import pickle
        for batch in batches:
            grown = [pickle.dumps(grow(*shared.value, seed)) for seed in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grown, pa.binary())], ["id", "tree"])

    import pickle
    grown = spark.range(trees).repartition(min(trees, shuffle_parts(spark))).mapInArrow(run, "id long, tree binary").toArrow()
    return Forest(words, [pickle.loads(t) for _, t in sorted(zip(grown.column("id").to_pylist(), grown.column("tree").to_pylist(),
                                                                 strict=True))])


def _judged(texts: list[str | None], forest: Forest, threshold: float) -> list[list[tuple[int, int, str, float]]]:
    """Per text, the (start, end, value, score) of its candidates that are secrets."""
    found = [candidates(t) for t in texts]
    x = np.array([features(v, b, a, forest.known) for c in found for _, _, v, b, a in c]).reshape(-1, len(FEATURES))
    scores = iter(forest.predict(x).tolist() if len(x) else [])
    return [_longest([(a, b, v, s) for (a, b, v, _, _), s in [(c, next(scores)) for c in found_here] if s >= threshold])
            for found_here in found]


def _longest(hits: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """The hits in order of their starts, without those that lie inside another."""
    out: list[tuple[int, int, str, float]] = []
    for hit in sorted(hits, key=lambda h: (h[0], -h[1])):
        if not out or hit[1] > out[-1][1]:
            out.append(hit)
    return out


def secrets(docs: DataFrame, forest: Forest, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, value, score) of the candidates judged to be secrets; positions are in characters."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    kind = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()),
                      ("score", pa.float64())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, judged = batch.column(0).to_pylist(), _judged(batch.column(1).to_pylist(), shared.value, threshold)
        rows = [(i, *hit) for i, hits in zip(ids, judged, strict=True) for hit in hits]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(kind)], schema=kind)

    return id_and_text(docs, id_col, text_col).mapInArrow(
        per_batch(run), "doc_id long, start long, end long, value string, score double")


def masked_column(spark: SparkSession, forest: Forest, threshold: float = 0.5, text_col: str = "text", mask: str = MASK):
    """A column with the text, each secret replaced by ``mask``; texts without secrets stay as they are."""
    shared = spark.sparkContext.broadcast(forest)

    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        values = texts.to_pylist()
        out = []
        for text, hits in zip(values, _judged(values, shared.value, threshold), strict=True):
            spans: list[list[int]] = []
            for a, b, _, _ in hits:
                if spans and a < spans[-1][1]:
                    spans[-1][1] = b
                else:
                    spans.append([a, b])
            for a, b in reversed(spans):
                text = text[:a] + mask + text[b:]
            out.append(text)
        return pa.array(out, pa.string())

    return masked(F.col(text_col).cast("string"))
