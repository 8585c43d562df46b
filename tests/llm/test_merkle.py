"""Merkle manifests against trees built in one place."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import merkle, queries


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes):
    """(root, per node its proof: (is the sibling on the left, digest) or None, level by level)."""
    proofs, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, w in enumerate(where):
            other = w ^ 1
            proofs[k].append((w % 2 == 1, nodes[other]) if other < len(nodes) else None)
            where[k] = w // 2
        nodes = [h("".join(nodes[i: i + 2])) for i in range(0, len(nodes), 2)]
    return nodes[0], proofs


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, h("".join(map(field, r))), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: x[:3])
        trees[g] = climb([x[2] for x in groups[g]])
    root, upper = climb([trees[g][0] for g in names])
    out = []
    for g, above in zip(names, upper):
        for (_, _, leaf, r), own in zip(groups[g], trees[g][1]):
            path = own + above
            shown = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                shown = (*r[:3], r[3] + 1, r[4])
            node = h("".join(map(field, shown)))
            for step in path:
                node = h(node if step is None else step[1] + node if step[0] else node + step[1])
            out.append((r[0], leaf, trees[g][0], root, h("".join(s[1] for s in path if s)), node, node == root))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, g int, pos string, node string, m int"


def check(spark, rows, tmp):
    spark.createDataFrame([(*r, 1, "p", "n", 2) for r in rows], SCHEMA).write.parquet(f"{tmp}/documents.parquet")
    got = queries.op12_merkle_manifest(spark, tmp)
    assert sorted((tuple(r)[:7] for r in got.collect()), key=str) == brute(rows)
    return got


def test_manifest_equals_one_tree(spark, tmpdir_path, monkeypatch):
    """Dense, sparse, negative, missing and repeated ids; equal rows; groups of one; several rounds of slot arrays."""
    monkeypatch.setattr(merkle, "BITS", 3)
    monkeypatch.setattr(merkle, "COPIES", 4)
    rows = [(i, "web", "en" if i % 3 else "fr", 10 * i, f"text {i} é") for i in range(150)]
    rows += [(i * 10**16 - 2**63, "s", "en", None, None) for i in range(0, 900, 60)] + [(2**63 - 1, None, "en", 2**63 - 1, "")]
    rows += [(None, "a", "en", 1, f"no id {i}") for i in range(5)] + [(None, None, None, None, None)] * 3
    rows += [(70, "copy", "en", 5, f"other {i}") for i in range(40)] + [(70, "copy", "en", 5, "same")] * 13
    rows += [(1, "x", "日本", 3, "w" * 200_000), (2, "x", "", 3, "b"), (2, "x", "de", 3, "b")]
    check(spark, rows, tmpdir_path)


@pytest.mark.parametrize("n", [1, 2, 3, 257])
def test_small_trees(spark, tmpdir_path, n):
    got = check(spark, [(i, "s", "en", i, "t") for i in range(n)], tmpdir_path)
    assert got.where("not verified").count() == sum(zlib.crc32(str(i).encode()) % 7 == 0 for i in range(n))


def test_empty_table_and_plain_manifest(spark):
    docs = spark.createDataFrame([(1, "s", "en", 4, "text")], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.manifest(docs.limit(0)).count() == 0
    r = merkle.manifest(docs).first()
    assert r.leaf == r.subroot == r.root == r.presented == h("1:1" "1:s" "2:en" "1:4" "4:text") and r.proof == [] and r.position == 0


def test_query_on_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = queries.op12_merkle_manifest(spark, sf)
    assert sorted((tuple(r)[:7] for r in got.collect()), key=str) == brute(rows)
    assert got.select(F.countDistinct("root")).first()[0] == 1
