"""BPE encoding and decoding against the library, and against plain merging."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from ledgerlens.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
PIECES = ["a", "th", "e", "in", "ing", " ", "\n", "'s", "é", "É", "ß", "Σ", "ΑΣ", "́", " ", "\x1c", "\x85", " ", "１", "²",
          "½", "😀", "👨‍👩‍👧", "한국", "ǅ", "İ", "ﬁ", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "</w>", "…", "!!", "123", "日本", "a" * 40, "\0",
          "र्", "ẞ"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.tokenizer(PATH)


def test_ids_and_texts_are_the_librarys(own, library):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(rng.choice("abcdeéthing") for _ in range(rng.randint(1, 60))) for _ in range(3000)] + ["", " ", "x" * 5000]
    for start, block in bpe.blocks(pa.array(texts), size=10_000):
        ids, bounds = own.words.ids(block)
        back = own.decode(ids, bounds).to_pylist()
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            want = library.encode(texts[start + i], add_special_tokens=False).ids
            assert ids[a:b].tolist() == want
            assert back[i] == library.decode(want, skip_special_tokens=False)


def merged(symbols, ranks):
    """Plain merging: the earliest pair first, from the left."""
    symbols = list(symbols)
    while True:
        best = min(((ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks), default=None)
        if best is None:
            return symbols
        i = best[1]
        symbols[i: i + 2] = [symbols[i] + symbols[i + 1]]


@pytest.mark.parametrize("seed", range(30))
def test_backtracking_equals_plain_merging_on_any_vocabulary(seed):
    """Random merges over two letters: many tokens overlap, and some are never produced."""
    rng = random.Random(seed)
    names = ["a", "b", "a</w>", "b</w>"]
    vocabulary, merges = {n: i for i, n in enumerate(names)}, []
    while len(merges) < 25:
        a, b = rng.choice(names), rng.choice(names)
        if not a.endswith("</w>") and a + b not in vocabulary:
            merges.append((a, b))
            vocabulary[a + b] = len(vocabulary)
            names.append(a + b)
    table = bpe.Merges(vocabulary, merges, "</w>")
    encoder = bpe.Encoder(table)
    ranks = {p: i for i, p in enumerate(merges)}
    for i, text in table.texts.items():
        if text.endswith(bpe.END):
            assert (merged([*text[:-2], text[-2] + "</w>"], ranks) == [text[:-1] + "</w>"]) == (i in table.made)
    for _ in range(300):
        word = "".join(rng.choice("ab") for _ in range(rng.randint(1, 24)))
        want = [vocabulary[s] for s in merged([*word[:-1], word[-1] + "</w>"], ranks)]
        assert encoder.encode(word + bpe.END) == want


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "the cat"), (3, "the cat"), (4, "word " * 300_000), (4, "word " * 300_000)]
    docs = spark.createDataFrame([(i, t, 9, "x") for i, t in rows], "doc_id long, text string, n_tokens int, ids string")
    coded = bpe.encode(docs, PATH, decoded=True)
    got = sorted(((r.doc_id, r.n_tokens, r.decoded[:20]) for r in coded.collect()), key=str)
    long = (4, 300_000, ("word</w> " * 3)[:20])
    assert got == sorted([(1, 0, ""), (2, 0, ""), (3, 0, ""), (None, 2, "the</w> cat</w>"), (3, 2, "the</w> cat</w>"), long, long], key=str)
    back = bpe.decode(coded.select("doc_id", "ids", F.lit(1).alias("decoded")), PATH)
    assert sorted(r.decoded for r in back.collect()) == sorted(r.decoded for r in coded.collect())
    assert bpe.encode(docs.limit(0), PATH).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids binary"), PATH).first().decoded == ""


def test_query_equals_the_library(spark, sf, library):
    import hashlib

    found = {r.doc_id: r for r in queries.op13_bpe_codec(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(docs)
    for d in docs:
        ids = library.encode(d.text, add_special_tokens=False).ids
        r = found[d.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
