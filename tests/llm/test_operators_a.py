"""Substring dedup, token counts, secret scans, decontamination and language identification."""

import hashlib
import itertools
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import decontaminate, language_id, secret_scan, substring_dedup, token_counts
from ledgerlens.llm.common import fold

DOCS = "doc_id long, text string, anchor long, place string, words string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with those the operators use inside."""
    return spark.createDataFrame([(i, t, 7, "x", None) for i, t in rows], DOCS)


def brute_repeats(rows, window):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for p in range(len(w) - window + 1):
            k = tuple(w[p: p + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p: p + window])] < i:
                gone[p: p + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("window", [8, 50])
def test_substring_dedup_equals_brute_force(spark, window):
    rng = random.Random(window)
    def word():
        return rng.choice(["ä", "the", "of", "x y", "zeta", "rho", "nu", "mu", "pi", "xi", "tau"])
    passages = [[word() for _ in range(rng.randint(window - 3, 3 * window))] for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [[word() for _ in range(rng.randint(0, 30))] for _ in range(3)]
        for k in rng.sample(range(6), rng.randint(0, 2)):
            parts.insert(rng.randint(0, len(parts)), passages[k])
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w for p in parts for w in p)))
    rows += [(100 + i, rows[i][1]) for i in range(8)]  # copies
    rows += [(200, None), (201, ""), (202, "be " * 300), (203, "be " * 300 + "end")]
    rows.append(rows[3])  # a repeated row
    found = substring_dedup.repeated_words(frame(spark, rows), window)
    got = sorted((r.doc_id, r.n_words, r.n_removed, bytes(r.kept_sha).hex()) for r in found.collect())
    assert got == brute_repeats(rows, window)


def test_substring_dedup_null_ids_and_equal_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (None, text + " more"), (5, "a " + text), (5, text)]
    got = {(r.doc_id, r.n_words): r.n_removed for r in substring_dedup.repeated_words(frame(spark, rows), 10).collect()}
    assert got == {(None, 30): 30, (None, 31): 30, (5, 31): 0, (5, 30): 0}
    assert substring_dedup.repeated_words(frame(spark, []), 10).count() == 0


def test_every_pair_of_positions_meets_on_the_difference_sets():
    for period, cover in substring_dedup.DIFFERENCE_SETS.items():
        for a, b in itertools.product(range(period), repeat=2):
            assert any((a + d) % period in cover and (b + d) % period in cover for d in range(period))


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece
    path = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece.SentencePieceProcessor(model_file=path), token_counts.counter(path)


def test_token_counts_equal_the_library(pieces):
    library, counts = pieces
    rng = random.Random(3)
    alphabet = " \n\t▁abcdeEthing éñ한丝😀.,0159<>/s\x00́ "
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50)))
        want = len(library.encode(text))
        assert token_counts.count_tokens(text, counts) == want, text
        for chunk in (1, 2, 7, 23):
            assert token_counts.count_tokens(text, counts, chunk) == want, (text, chunk)


def test_chunk_maps_compose_associatively(pieces):
    _, counts = pieces
    rng = random.Random(4)
    for _ in range(300):
        a, b, c = (token_counts.chunk_map("".join(rng.choice("▁ab\nthe") for _ in range(rng.randint(0, 6))), counts) for _ in "abc")
        left = token_counts.compose(token_counts.compose(a, b, counts), c, counts)
        assert left == token_counts.compose(a, token_counts.compose(b, c, counts), counts)


def test_token_counts_rows(spark, pieces):
    library, _ = pieces
    long = "word " * 300_000
    rows = [(1, None), (2, ""), (None, "Hällo <s> wörld"), (3, long), (3, long)]
    found = token_counts.token_counts(frame(spark, rows), public_tokenizers.path("piece_bpe_32k.model"))
    got = sorted(((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in found.collect()))
    want = sorted((i or -1, len((t or "").encode()), len(library.encode(t or ""))) for i, t in rows)
    assert got == want
    assert token_counts.token_counts(frame(spark, []), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def secret_rows():
    rng = random.Random(5)
    rows, planted = [], {}
    for i in range(400):
        words = [rng.choice(["the", "river", "stone", "undercurrent", "Notwithstanding", "archive"]) for _ in range(40)]
        kind = i % 8
        if kind == 0:
            value = "".join(rng.choice("0123456789abcdef") for _ in range(40))
            words.insert(9, f'token = "{value}"')
            planted[i] = value
        elif kind == 1:
            value = "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16))
            words.insert(9, value)
            planted[i] = value
        elif kind == 2:
            words.insert(9, f"https://archive.example.com/river/stone/{i}/index.html")
        elif kind == 3:
            words.insert(9, str(rng.randrange(10 ** 15, 10 ** 16)))
        elif kind == 4:
            words.insert(9, "river-stone-undercurrent")
        rows.append((i, " ".join(words)))
    return rows, planted


def test_secret_scan_finds_planted_and_masks(spark):
    rows, planted = secret_rows()
    docs = frame(spark, rows + [(1000, None), (1001, ""), (None, f'secret = "{planted[0][::-1]}"')])
    learned = docs.where(fold("doc_id", 4) != 2)
    model = secret_scan.fit(secret_scan.rule_labels(learned), secret_scan.dictionary(docs))
    got = {(r.doc_id, r.value) for r in secret_scan.secrets(docs, model).collect()}
    assert got == set(planted.items()) | {(None, planted[0][::-1])}
    masked = docs.withColumn("masked", secret_scan.masked_column(spark, model)).where("doc_id IS NOT NULL").collect()
    for r in masked:
        want = r.text if r.doc_id not in planted else r.text.replace(planted[r.doc_id], secret_scan.MASK)
        assert r.masked == want
    for r in secret_scan.secrets(docs.where("doc_id IS NOT NULL"), model).collect():
        assert dict(rows)[r.doc_id][r.start: r.end] == r.value


def test_secret_scan_finds_short_and_punctuated_values(spark):
    rows, planted = secret_rows()
    rng = random.Random(15)
    names = ('password = "{}"', "pwd = '{}'", "api_key: {}", '{{"secret": "{}"}}')
    for i in range(400, 800):
        if i % 2:
            value = "".join(rng.sample("abcdefghijkmnpqrstuvwxyz", 5)) + rng.choice("!@#$%") + str(rng.randrange(10, 1000))
            rows.append((i, f"the river stone {names[i % 4].format(value)} the archive"))
            planted[i] = value
        else:
            rows.append((i, f"the river stone token: {rng.choice(['river', 'stone', 'archive'])} the archive"))
    more = {900: ('password = "S3cr3t!9"', "S3cr3t!9"), 901: ("pwd = 'p@ss-w0rd#1'", "p@ss-w0rd#1"),
            902: ('password = "qhzxkvjwpmrtgblc"', "qhzxkvjwpmrtgblc")}
    rows += [(i, f"the river stone {t} the archive") for i, (t, _) in more.items()]
    planted |= {i: v for i, (_, v) in more.items()}
    docs = frame(spark, rows)
    model = secret_scan.fit(secret_scan.rule_labels(docs), secret_scan.dictionary(docs))
    assert {(r.doc_id, r.value) for r in secret_scan.secrets(docs, model).collect()} == set(planted.items())
    for r in docs.withColumn("masked", secret_scan.masked_column(spark, model)).collect():
        assert r.masked == (r.text.replace(planted[r.doc_id], secret_scan.MASK) if r.doc_id in planted else r.text)


def test_assigned_values_are_candidates():
    for text, want in (('password = "S3cr3t!9"', "S3cr3t!9"), ("(pwd=a(b)c!)", "a(b)c!"), ("auth_token: x9.", "x9"),
                       ("key := 'a b c'", "a b c"), ('"secret" => "qhzxkvjwpmrtgblc"', "qhzxkvjwpmrtgblc"),
                       ('dsn: "db?password=S3cr3t!9 x"', "S3cr3t!9"), ('password = "S3cr3t!9', "S3cr3t!9")):
        assert [c[2] for c in secret_scan.candidates(text)] == [want]
    assert secret_scan.candidates("the author: someone else = 3") == []


def test_secret_model_does_not_change_with_copies(spark):
    rows, _ = secret_rows()
    found = secret_scan.rule_labels(frame(spark, rows)).collect()
    kinds = "value string, before string, after string, label int"
    once, copies = (spark.createDataFrame(found * n, kinds) for n in (1, 20))
    known = ["the", "river", "stone", "archive"]
    a, b = (secret_scan.fit(t, known, sample=20, trees=4) for t in (once, copies))
    assert a.trees and all(np.array_equal(x, y) for s, t in zip(a.trees, b.trees, strict=True) for x, y in zip(s, t, strict=True))


def test_secret_scan_without_labels_or_rows(spark):
    docs = frame(spark, [(1, "token = 0641917ea4e9feb9cda83477b57ac2654884f485")])
    none = secret_scan.fit(secret_scan.rule_labels(frame(spark, [])), [])
    assert secret_scan.secrets(docs, none).count() == 0
    one_kind = secret_scan.fit(secret_scan.rule_labels(docs), [])
    assert secret_scan.secrets(docs, one_kind).count() == 1
    assert secret_scan.secrets(frame(spark, []), one_kind).count() == 0


def bag(words, n=5):
    from collections import Counter
    return Counter(tuple(words[i: i + n]) for i in range(max(1, len(words) - n + 1))) if words else Counter()


def similar(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    def text(n):
        return [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, text(rng.randint(14, 60))) for k in range(12)]
    rows = []
    for i in range(60):
        words = text(rng.randint(20, 120))
        if i % 3 == 0:
            leak = list(items[rng.randrange(12)][1])
            if i % 2:
                leak[-1] = "other"
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() for w in leak]
        elif i % 3 == 1:  # half an item: below the limit
            leak = items[rng.randrange(12)][1]
            words[5:5] = leak[: len(leak) // 2]
        rows.append((i, "  ".join(words)))
    want = {}
    for i, t in rows:
        w = t.lower().split()
        for k, item in items:
            for p in range(max(1, len(w) - len(item) + 1)):
                s = similar(bag(w[p: p + len(item)]), bag(item))
                if s >= 0.8:
                    want[i, k] = max(want.get((i, k), 0), s)
    docs = frame(spark, rows + [(900, None), (901, ""), (None, " ".join(items[0][1])), rows[0]])
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items] + [(50, None), (51, ""), (None, "a b c d e f")],
                                  "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(docs, bench).collect()}
    assert got.keys() == want.keys() and want
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
    blocks = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench, block_rows=50).collect()}
    assert blocks == want.keys()
    left = decontaminate.without_leaks(docs, bench)
    assert left.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in left.collect()) == sorted({r[0] for r in rows} - {i for i, _ in want} | {900, 901, -1})
    assert decontaminate.leaks(frame(spark, []), bench).count() == 0
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_decontamination_finds_edits_inside_an_item_at_any_radius(spark):
    rng = random.Random(16)
    items = [(k, [f"w{rng.randrange(10_000)}" for _ in range(50 + k % 11)]) for k in range(40)]
    items.append((40, (["say", "it", "again", "and"] * 15)[:57]))  # shingles that repeat
    rows = []
    for i in range(1600):
        leak = list(items[i % 41][1])
        leak[rng.randrange(5, len(leak) - 5)] = "other"
        rows.append((i, " ".join(["before", *leak, *(f"after{j}" for j in range(60))])))
    bags = {k: bag(w) for k, w in items}
    want = {}
    for i, t in rows:
        w, k = t.split(), i % 41
        s = max(similar(bag(w[p: p + len(items[k][1])]), bags[k]) for p in range(20))
        if s >= 0.8:
            want[i, k] = s
    assert len(want) > 1500
    docs = frame(spark, rows)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    for options in ({}, {"radius": 0, "block_rows": 50}):
        got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(docs, bench, **options).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_decontamination_bag_similarity_counts_repeats(spark):
    row = spark.sql("SELECT array(1L, 1L, 2L) AS a, array(1L, 2L, 2L) AS b")
    assert row.select(decontaminate.bag_similarity("a", "b")).first()[0] == 0.5


def test_multi_index_keeps_all_within_the_radius():
    rng = random.Random(7)
    for _ in range(2000):
        flips = sum(1 << b for b in rng.sample(range(64), rng.randint(0, decontaminate.RADIUS)))
        assert min((flips >> (16 * k) & 0xFFFF).bit_count() for k in range(4)) <= decontaminate.RADIUS // 4


def test_decontamination_has_no_python_in_its_plan(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    plan = decontaminate.leaks(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(8)
    for _ in range(60):
        lengths = rng.integers(0, 6, 4)
        starts = np.concatenate(([0], np.cumsum(lengths)))
        scores = rng.integers(-9, 1, (int(starts[-1]), 3)).astype(np.float32)
        path = language_id.viterbi(scores, starts, 2.5)
        for a, b in zip(starts[:-1], starts[1:]):
            def value(p):
                return sum(scores[a + i, k] for i, k in enumerate(p)) - 2.5 * sum(x != y for x, y in zip(p, p[1:]))
            if b > a:
                assert value(path[a:b]) == max(map(value, itertools.product(range(3), repeat=int(b - a))))


def test_language_id_spans_scripts_and_edges(spark):
    en = "the cat and the dog were in the house with that man and this woman"
    de = "der hund und die katze sind nicht mit dem mann auf der strasse gegangen"
    ru = "это дом и в нём живёт кот который не любит собак"
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(en, "en"), (de, "de"), (ru, "ru")] * 5)]
    docs = spark.createDataFrame(rows + [(90, None, "xx"), (91, "text", None)], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert model.langs == ["de", "en", "ru"]
    asked = spark.createDataFrame([(1, f"{en} {de} {ru}"), (2, None), (3, ""), (4, "123 ... 45"), (None, ru), (6, de), (6, de)],
                                  "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.identify(asked, model).collect()}
    assert [s.lang for s in got[1].spans] == ["en", "de", "ru"]
    assert got[1].spans[0].end == len(en.split()) and got[1].spans[1].end == len(en.split()) + len(de.split())
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and not got[i].spans for i in (2, 3, 4))
    assert got[None].lang_pred == "ru" and got[6].lang_pred == "de" and got[6].score == 1.0
    assert language_id.identify(asked, model).count() == 7
    nothing = language_id.fit(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(asked, nothing).collect()} == {"und"}


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = fold("doc_id", 4) == 2
    found = language_id.identify(docs.where(held), language_id.fit(docs.where(~held)))
    right = found.join(docs.select("doc_id", "lang"), "doc_id").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.97
