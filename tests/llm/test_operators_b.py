"""SimHash near-dedup, nearest neighbours, toxicity, WARC and packing."""

import gzip
import io
import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash

from ledgerlens.llm import ann, packing, simhash_dedup, toxicity, warc
from ledgerlens.llm.common import fold

DOCS = "doc_id long, text string, fp long, key string, component_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "k", None) for i, t in rows], DOCS)


def plain_fingerprint(text, n=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i: i + n]), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, distance=2):
    """{id: smallest id reachable} from {id: fingerprint}, by flooding."""
    out, ids = {}, sorted(fps)
    for i in ids:
        if i not in out:
            todo, out[i] = [i], i
            while todo:
                a = todo.pop()
                for b in ids:
                    if b not in out and (fps[a] ^ fps[b]).bit_count() <= distance:
                        out[b] = i
                        todo.append(b)
    return out


def test_golay_decoding_is_perfect_and_keys_meet():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 4000).astype(np.int64)
    index = simhash_dedup.golay_indices(words)
    assert {len(set(r)) for r in index.tolist()} == {1, 6}
    fps = rng.integers(-(1 << 63), 1 << 63 - 1, 1500)
    other = fps.copy()
    for i in range(len(fps)):
        for b in rng.choice(64, rng.integers(0, 3), replace=False):
            other[i] ^= np.int64(np.uint64(1 << int(b)).view(np.int64))
    row, key = simhash_dedup.golay_keys(np.concatenate([fps, other]))
    keys = [set() for _ in range(2 * len(fps))]
    for r, k in zip(row.tolist(), key.tolist()):
        keys[r].add(k)
    assert all(keys[i] & keys[i + len(fps)] for i in range(len(fps)))


@pytest.mark.parametrize("small_key", [16, 1])
def test_simhash_components_equal_brute_force(spark, monkeypatch, small_key):
    monkeypatch.setattr(simhash_dedup, "SMALL_KEY", small_key)
    rng = random.Random(2)
    rows = []
    for i in range(40):
        words = [rng.choice("abcdefghijklmnop") * rng.randint(1, 4) for _ in range(rng.randint(0, 60))]
        for k in range(rng.randint(1, 4)):
            copy = list(words)
            if copy and k:
                copy[rng.randrange(len(copy))] = rng.choice(["x", "Y"])
            rows.append((len(rows), rng.choice([" ", "\n"]).join(copy)))
    rows += [(500, None), (501, " \t"), (502, "ab"), (503, "AB "), (504, "É")]
    got = {r.doc_id: r for r in simhash_dedup.near_duplicates(frame(spark, rows)).collect()}
    fps = {i: plain_fingerprint(t) for i, t in rows}
    assert {i: r.fp & (1 << 64) - 1 for i, r in got.items()} == fps
    assert {i: r.component_id for i, r in got.items()} == plain_components(fps)


@pytest.mark.parametrize("distance,small_key", [(2, 16), (2, 2), (1, 1), (0, 16)])
def test_linked_fingerprints_equal_brute_force(spark, monkeypatch, distance, small_key):
    monkeypatch.setattr(simhash_dedup, "SMALL_KEY", small_key)
    rng = random.Random(3)
    fps = {}
    for _ in range(12):  # chains and clusters of nearby fingerprints
        fp = rng.getrandbits(64)
        for _ in range(rng.randint(1, 25)):
            fps.setdefault(fp, len(fps))
            for b in rng.sample(range(64), rng.randint(0, 3)):
                fp ^= 1 << b
    classes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), i) for f, i in fps.items()], "fp long, rep long")
    links = simhash_dedup.linked_classes(classes, distance)
    got = {r.node: r.component for r in simhash_dedup.components(links).collect()}
    want = plain_components({i: f for f, i in fps.items()}, distance)
    assert {i: got.get(i, i) for i in want} == want


def test_simhash_keeps_one_document_of_each_group(spark):
    rows = [(5, "a b c d"), (3, "A b  c d"), (3, "A b  c d"), (9, "other words here now"), (None, "a b c d"), (None, None)]
    kept = simhash_dedup.keep_one(frame(spark, rows))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == [
        (-1, ""), (-1, "a b c d"), (3, "A b  c d"), (9, "other words here now")]
    null = [r for r in simhash_dedup.near_duplicates(frame(spark, rows)).collect() if r.doc_id is None]
    assert {r.component_id for r in null} == {3, None}
    assert simhash_dedup.keep_one(frame(spark, [])).count() == 0


def test_chain_components(spark):
    links = spark.range(400).selectExpr("id + 1 AS a", "id AS b")
    got = simhash_dedup.components(links).collect()
    assert len(got) == 401 and {r.component for r in got} == {0}


def test_chi_square_quantiles():
    for p, m, want in [(0.95, 8, 15.5073), (0.99, 8, 20.0902), (0.5, 2, 1.3863), (0.9, 1, 2.7055)]:
        assert math.isclose(ann.chi_square_quantile(p, m), want, rel_tol=1e-4)


def brute_nearest(rows, k):
    good = {i: np.array(v, float) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in (i for i in good if i % 100 == 0):
        near = sorted((math.sqrt(((good[q] - v) ** 2).sum()), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
        out[q] = near[:k]
    return out


def searched(spark, rows, **options):
    table = spark.createDataFrame([(i, v, "c") for i, v in rows], "vec_id long, embedding array<float>, cell string")
    vectors = ann.usable(table)
    out = {}
    for r in ann.nearest(vectors, vectors.where("vec_id % 100 = 0"), **options).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
    return out


def test_nearest_neighbours_recall_and_edges(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((20, 24))
    rows = [(i, (centres[i % 20] + 0.2 * rng.standard_normal(24)).astype(np.float32).tolist()) for i in range(2000)]
    rows += [(5000, None), (5001, []), (5002, [0.0] * 24), (5003, [float("nan")] * 24), (5004, [None] * 24), (5005, [1.0, 2.0])]
    rows += [(5100, rows[0][1]), (5101, rows[0][1]), rows[100]]
    want, got = brute_nearest(rows, 10), searched(spark, rows, k=10, cells=3)
    assert got.keys() == want.keys()
    hit = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hit >= 0.95 * sum(map(len, want.values()))
    assert [i for _, i in got[0][:2]] == [5100, 5101] and got[0][0][0] == 0.0
    for q in want:
        assert all(any(i == j and math.isclose(s, t, rel_tol=1e-12, abs_tol=1e-12) for t, j in brute_nearest(rows, 3000)[q])
                   for s, i in got[q]) if q in (0, 100) else True


def test_nearest_neighbours_few_and_none(spark):
    assert searched(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0])], k=10) == {0: [(1.0, 1)]}
    assert searched(spark, [], k=10) == {}


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(toxicity.labelled_texts(docs, labels.where(fold("doc_id", 3) != 1)))
    rows = toxicity.toxicity(docs, model).join(labels.where(fold("doc_id", 3) == 1), "doc_id").select("toxic", "predicted").collect()
    caught = [r.predicted for r in rows if r.toxic == 1]
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert sum(caught) >= 0.75 * len(caught) and sum(clean) <= 0.01 * len(clean)


def test_toxicity_edges(spark):
    docs = frame(spark, [(i, "you idiot" if i % 2 else "kind words") for i in range(40)] + [(100, None), (101, ""), (None, "idiot"),
                                                                                           (1, "you idiot")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(100, None), (101, 7), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.labelled_texts(docs, labels), steps=200)
    rows = toxicity.toxicity(docs, model, threshold=0.5).collect()
    assert len(rows) == 44 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == r.doc_id % 2 for r in rows if r.doc_id is not None and r.doc_id < 40)
    assert [r.predicted for r in rows if r.doc_id is None] == [1]
    assert len({r.score for r in rows if r.doc_id in (100, 101)}) == 1
    for some in (labels.where("toxic = 1"), labels.limit(0)):
        fixed = toxicity.fit(toxicity.labelled_texts(docs, some))
        assert len({r.score for r in toxicity.toxicity(docs, fixed).collect()}) == 1
    assert toxicity.toxicity(frame(spark, []), model).count() == 0


PAGES = [(7, "http://a/x y\r\n", "<p>é</p>"), (3, None, "<p>é</p>"), (5, "http://b", None), (9, "http://c", ""), (4, "http://d", "one"),
         (None, "http://e", "one"), (3, None, "<p>é</p>"), (11, "http://f", "long " * 200_000)]


def test_warc_round_trip(spark, tmpdir_path):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, offset int")
    got = sorted(((r.page_id or -1, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.payload)
                  for r in warc.archive(pages, tmpdir_path).collect()), key=str)
    want = []
    for i, _, html in PAGES:
        payload = (html or "").encode()
        first = min((j for j, _, h in PAGES if (h or "") == (html or "") and j is not None), default=None)
        revisit = i is not None and i != first
        want.append((i or -1, "revisit" if revisit else "response", first if revisit else None, len(payload),
                     warc.payload_digest(payload), None if revisit else payload.decode()))
    assert got == sorted(want, key=str)
    assert warc.archive(pages.limit(0), tmpdir_path).count() == 0


def test_warc_members_and_sidecar(spark, tmpdir_path):
    import glob
    import json
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_monolithic(warc.with_revisits(pages).coalesce(1), f"{tmpdir_path}/m", roll=500)
    paths = [r.path for r in manifest.collect()]
    warc.normalise(spark.createDataFrame([(p,) for p in paths], "path string"), f"{tmpdir_path}/n").collect()
    whole = b"".join(gzip.decompress(open(p, "rb").read()) for p in sorted(paths))
    members = sorted(glob.glob(f"{tmpdir_path}/n/*.warc.gz"))
    assert len(paths) > 1 and len(members) == len(paths)
    assert b"".join(gzip.decompress(open(p, "rb").read()) for p in members) == whole
    for p in members:
        data = open(p, "rb").read()
        lines = [json.loads(x) for x in open(f"{p}.idx.json")]
        assert sum(x["length"] for x in lines) == len(data)
        for x in lines:
            one = gzip.decompress(data[x["offset"]: x["offset"] + x["length"]])
            assert one.startswith(b"WARC/1.1\r\n") and x["record_id"].encode() in one and one.count(b"WARC/1.1\r\n") == 1


def test_warc_stream_in_small_pieces():
    data = b"".join(warc.record(i, f"http://x/{i}", b"p" * i, None) for i in range(40))
    for step in (1, 3, 1000):
        chunks = (data[i: i + step] for i in range(0, len(data), step))
        assert b"".join(warc.records(chunks)) == data
    many = gzip.compress(data[:1000]) + gzip.compress(data[1000:])
    assert b"".join(warc.inflated(io.BytesIO(many))) == data
    with pytest.raises(ValueError):
        list(warc.records([data[:-5]]))


def test_packer_keeps_every_limit_and_token():
    rng = random.Random(9)
    for _ in range(120):
        packer = packing.Packer(rng.choice([16, 64, 100]), rng.choice([1, 2, 5]), rng.choice([None, 7, 20]), pool=rng.choice([2, 10, 50]))
        docs, out = {}, []
        for key in range(rng.randint(0, 50)):
            length = rng.randint(1, 150)
            docs[key] = length, rng.randint(0, length)
            out += packer.add(key, *docs[key])
        out += packer.finish()
        seen = {}
        for sequence in out:
            assert sum(p[2] for p in sequence) <= packer.limits[0] and len(sequence) <= packer.limits[1]
            assert sum(p[3] for p in sequence) <= packer.limits[2]
            for key, start, length, loss in sequence:
                n, bearing = docs[key]
                assert loss == max(0, start + length - max(start, n - bearing))
                seen.setdefault(key, []).append((start, length))
        for key, (n, _) in docs.items():
            at = 0
            for start, length in sorted(seen[key]):
                assert start == at and length > 0
                at += length
            assert at == n


def test_short_sequences_become_powers_of_two():
    for total in range(1, 200):
        parts = packing.split_short([(0, 0, total, 0)], 256)
        sizes = [sum(p[2] for p in s) for s in parts]
        assert sum(sizes) == total and all(s & (s - 1) == 0 for s in sizes)


def check_pieces(rows, docs, capacity=4096):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t in docs}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        data = np.array(ids[r.doc_id][r.start: r.start + r.length], "<u4").tobytes()
        assert zlib.crc32(data) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    assert by_doc.keys() == ids.keys()
    for i, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids[i])
    padding = 0
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / sum(map(len, ids.values()))


def test_packing_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    packed = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert check_pieces(packed, rows) <= 0.01


def test_packing_edges(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(1, None), (2, ""), (3, "word " * 30_000), (4, "a<|endoftext|>b Ü é don't\x1cx"), (5, "a")]
    packed = packing.pack_documents(frame(spark, rows), path).collect()
    assert check_pieces(packed, rows) == 0
    twice = packing.pack_documents(frame(spark, [(1, "a"), (1, "a"), (None, "b")]), path).collect()
    assert sum(r.length for r in twice) == 6 and sum(r.doc_id is None for r in twice) >= 1
    assert packing.pack_documents(frame(spark, []), path).count() == 0
    half = packing.pack_documents(frame(spark, rows), path, segments=2, loss_limit=1000, loss_share=0.5).collect()
    for _, parts in itertools.groupby(sorted(half, key=lambda r: r.sequence_id), key=lambda r: r.sequence_id):
        parts = list(parts)
        assert len(parts) <= 2 and sum(r.loss_tokens for r in parts) <= 1000


def test_packing_very_short_documents_needs_no_padding(spark):
    rows = [(i, "a b") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    packed = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert check_pieces(packed, rows) == 0
