"""What a task of substring_dedup holds at once: blocks of text, however large an Arrow batch is."""

import pyarrow as pa

from ledgerlens.llm import substring_dedup as sd


class Rows:
    """Stands for a DataFrame: ``mapInArrow`` gives the function itself."""

    def mapInArrow(self, function, schema):
        return function


def test_batches_are_read_in_blocks(monkeypatch):
    seen, real = [], sd.WordHashes.__call__
    monkeypatch.setattr(sd.WordHashes, "__call__", lambda self, texts: seen.append(sum(len(t or b"") for t in texts)) or real(self, texts))
    texts = [" ".join(f"w{i % 97}_{k}" for k in range(30_000)) for i in range(60)] + [None, "", "one word"]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    found = pa.Table.from_batches(sd.anchors(Rows(), 50)(iter([batch]))).to_pydict()
    assert max(seen) <= 1 << 22 < sum(seen)
    alone = [r for i in range(len(texts)) for b in sd.anchors(Rows(), 50)(iter([batch.slice(i, 1)])) for r in b.to_pylist()]
    assert [tuple(r.values()) for r in alone] == list(zip(*found.values(), strict=True))
    places = pa.array([[0, 40, 29_999] if t else [] for t in texts], pa.list_(pa.int64()))
    hits, seen[:] = pa.record_batch([*batch.columns, places], names=["doc_id", "text", "places"]), []
    windows = [r for b in sd._windows(Rows(), 50)(iter([hits])) for r in b.to_pylist()]
    assert max(seen) <= 1 << 22 < sum(seen)
    assert windows == [r for i in range(len(texts)) for b in sd._windows(Rows(), 50)(iter([hits.slice(i, 1)])) for r in b.to_pylist()]
