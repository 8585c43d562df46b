"""Decontamination against every start of every document, and the recall of the SimHash search by itself."""

import random
from collections import Counter

from ledgerlens.llm import decontaminate


def bag(words, n=5):
    return Counter(tuple(words[i: i + n]) for i in range(max(1, len(words) - n + 1))) if words else Counter()


def best_windows(words, item):
    """(similarity, first best start that begins with a shingle of the item or ends the document) over all starts."""
    k, own = min(5, len(item)), bag(item)
    out = None
    for p in range(max(1, len(words) - len(item) + 1)):
        window = words[p: p + len(item)]
        if len(item) < 5 and len(window) < len(item):
            continue
        held = bag(window)
        s = sum((held & own).values()) / max(1, sum((held | own).values()))
        begins = tuple(window[:k]) in own or p + len(item) >= len(words)
        if s >= 0.8 and (out is None or (s, begins) > (out[0], out[2])):
            out = (s, p, begins)
    assert out is None or out[2]  # a best window can always be slid to such a start
    return out and out[:2]


def test_every_start_counts(spark):
    """Halves in reverse order, shuffled parts, repeated shingles, short items, leaks at both ends, documents shorter than an item."""
    rng = random.Random(11)

    def text(n, words=300):
        return [f"w{rng.randrange(words)}" for _ in range(n)]

    items = {k: text(rng.randint(30, 60)) for k in range(10)}
    items |= {20: (["say", "it", "again", "and", "once"] * 12)[:50], 21: ["what", "is", "two", "plus"], 22: ["rare", "pair"], 23: text(5)}
    rows = []
    for i in range(120):
        k = rng.choice(list(items))
        leak, half = list(items[k]), len(items[k]) // 2
        if i % 4 == 1:
            leak = leak[half:] + leak[:half]
        elif i % 4 == 2 and len(leak) > 20:
            cut = rng.randint(6, len(leak) - 6)
            leak = leak[cut:] + leak[:cut]
            leak[rng.randrange(len(leak))] = "other"
        elif i % 4 == 3:
            leak = leak[: max(2, int(len(leak) * 0.93))]
        front, back = text(rng.choice([0, 3, 40])), text(rng.choice([0, 3, 40]))
        rows.append((i, " ".join(front + leak + back)))
    rows += [(200, "What is  TWO plus"), (201, "what is two"), (202, "rare pair " * 5), (203, "x " * 30_000 + " ".join(items[0]) + " y" * 30_000)]
    want = {(i, k): found for i, t in rows for k, item in items.items() if (found := best_windows(t.lower().split(), item))}
    assert sum(i % 4 == 1 for i, _ in want) > 5 and any(k == 21 for _, k in want) and (203, 0) in want
    docs = spark.createDataFrame([(i, t, 1, "n") for i, t in [*rows, rows[0]]], "doc_id long, text string, start int, leak string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in decontaminate.leaks(docs, bench).collect()}
    assert got.keys() == want.keys()
    for key, (s, p) in want.items():
        assert abs(got[key][0] - s) < 1e-12 and got[key][1] == p
    left = decontaminate.without_leaks(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, _ in rows} - {i for i, _ in want}


def test_recall_of_the_blocks_alone():
    """Pairs of bags just above the limit: how many lie within the radius, which is what the blocks alone would find."""
    rng = random.Random(12)

    def print_of(hashes):
        return sum((sum(h >> j & 1 for h in hashes) * 2 > len(hashes)) << j for j in range(64))

    near = 0
    for _ in range(2000):
        m = rng.randint(20, 55)
        shared = -(-8 * 2 * m // 18)  # the fewest shared shingles of two windows with m each
        common = [rng.getrandbits(64) for _ in range(shared)]
        a, b = (print_of(common + [rng.getrandbits(64) for _ in range(m - shared)]) for _ in range(2))
        near += (a ^ b).bit_count() <= decontaminate.RADIUS
    assert near / 2000 > 0.99
