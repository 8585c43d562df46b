"""The pipeline against a plain composition of what its stages decide."""

import numpy as np
import public_tokenizers
import zlib
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlens.llm import decontaminate, queries, secret_scan, simhash_dedup, toxicity


def test_pipeline_equals_the_plain_composition(spark, sf):
    from tokenizers import Tokenizer

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    table = spark.read.parquet(f"{sf}/documents.parquet")
    labels, bench = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    scorer = toxicity.Scorer(queries.toxicity_model(table, labels))
    kept = {i: t for i, t in docs.items() if scorer(t.encode()) < toxicity.THRESHOLD}
    fps = {i: simhash_dedup.fingerprint(t.encode()) for i, t in kept.items()}
    group = {}
    for i in sorted(fps):
        if i not in group:
            todo, group[i] = [i], i
            while todo:
                a = todo.pop()
                for b in fps:
                    if b not in group and (fps[a] ^ fps[b]).bit_count() <= 2:
                        group[b] = i
                        todo.append(b)
    kept = {i: t for i, t in kept.items() if group[i] == i}

    def bag(words):
        from collections import Counter
        return Counter(tuple(words[k: k + 5]) for k in range(max(1, len(words) - 4)))

    items = [(r.text.lower().split(), bag(r.text.lower().split())) for r in bench.collect()]
    known = {s for _, b in items for s in b}

    def leaks(text):
        w = text.lower().split()
        if not known & set(bag(w)):
            return False
        return any(sum((bag(w[p: p + len(x)]) & b).values()) >= 0.8 * sum((bag(w[p: p + len(x)]) | b).values())
                   for x, b in items for p in range(max(1, len(w) - len(x) + 1)))

    kept = {i: t for i, t in kept.items() if not leaks(t)}
    left = spark.createDataFrame(list(kept.items()), "doc_id long, text string")
    forest = queries.secret_model(left)
    for r in secret_scan.secrets(left, forest).orderBy("doc_id", F.desc("start")).collect():
        kept[r.doc_id] = kept[r.doc_id][: r.start] + secret_scan.MASK + kept[r.doc_id][r.end:]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: library.encode(t, add_special_tokens=False).ids + [2] for i, t in kept.items()}

    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == ids.keys()
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    for r in rows:
        assert zlib.crc32(np.array(ids[r.doc_id][r.start: r.start + r.length], "<u4").tobytes()) == r.ids_crc32


def test_stages_take_odd_rows_and_keep_columns(spark, sf):
    rows = [(1, "kind words of the day", "en", "a", 21, "x"), (1, "kind words of the day", "en", "a", 21, "x"),
            (None, None, None, None, None, None), (2, "", None, None, 0, None),
            (3, 'some token = "0641917ea4e9feb9cda83477b57ac2654884f485" here', "en", "b", 99, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string")
    for some in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, some, sf)
            assert out.columns == docs.columns, name
            out.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, some, sf).where("length < 1").count() == 0
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3]


def test_decontamination_matches_the_operator(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    bad = {r.doc_id for r in decontaminate.leaks(docs, bench).collect()}
    left = {r.doc_id for r in corpus_pipeline.drop_leaks(spark, docs, sf).collect()}
    assert bad and left == {r.doc_id for r in docs.select("doc_id").collect()} - bad


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, "a b c d"), (3, "A b  c d"), (3, "quite other words here now"), (3, "quite other words here now"),
            (7, "yet another text of words"), (7, "and this one is different again"), (8, item), (8, "clean words in this row")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash_dedup.keep_one(docs)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted({rows[0], rows[2], *rows[4:]})
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    left = decontaminate.without_leaks(docs, bench)
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in left.collect()) == sorted(r for r in rows if r[1] != item)


def test_stages_keep_columns_whatever_their_names(spark):
    names = ["__id", "__mark", "__masked", "__key", "row", "key", "masked", "leak", "mark", "a.b"]
    schema = "doc_id long, text string, n_chars int, " + ", ".join(f"`{n}` string" for n in names)
    rows = [(1, "some words of a text " * 5, 7, *names), (2, None, None, *names), (None, "", 0, *names), (3, 'password = "S3cr3t!9xyz"', 5, *names)]
    rows += [(1, "some words of a text " * 5, 7, *["other"] * len(names))]
    docs = spark.createDataFrame(rows, schema)
    first = sorted(map(tuple, simhash_dedup.keep_one(docs).collect()), key=str)
    assert first == sorted(map(tuple, simhash_dedup.keep_one(docs.repartition(3)).collect()), key=str) and len(first) == 4
    masked = corpus_pipeline.mask_secrets(spark, docs, "")
    assert masked.columns == docs.columns and masked.count() == 5 and masked.where("`a.b` IS NULL").count() == 0
    bench = spark.createDataFrame([(1, "nothing of this is in there at all")], "item_id long, text string")
    left = decontaminate.without_leaks(docs, bench)
    assert left.columns == docs.columns and left.count() == 5
