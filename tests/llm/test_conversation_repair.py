"""Conversation repair against a search over all edits, and cells against the chart of all spans and splits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from ledgerlens.llm import conversation_repair as cr
from ledgerlens.llm import queries

GOOD = re.compile(r"(s?(ua)+)?")


def brute_rows(rows):
    """Rows of one conversation after damage, in order: (turn, role, text)."""
    out = []
    for c, t, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        t = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """Dijkstra over (rows read, roles given so far as a state), ordered by (cost, audit)."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, best = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, given = heapq.heappop(heap)
        if (i, state) in best:
            continue
        best.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, given
        for r in "ua":
            if r in after[state]:
                full = {"u": "user", "a": "assistant"}[r]
                heapq.heappush(heap, (cost + 2, audit + "I", i, r, (*given, f"{full}:")))
                if i < len(rows) and marks[i] not in ("blank", "duplicate"):
                    heapq.heappush(heap, (cost + 2 + (marks[i] == "truncated"), audit + "R", i + 1, r, (*given, f"{full}:{rows[i][2]}")))
        if i < len(rows):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, given))
            r = rows[i][1][:1]
            if marks[i] not in ("blank", "duplicate") and r in after[state]:
                heapq.heappush(heap, (cost + (marks[i] == "truncated"), audit + "K", i + 1, r, (*given, f"{rows[i][1]}:{rows[i][2]}")))


def brute(table):
    out = []
    for conv in {r[0] for r in table}:
        rows = brute_rows([r for r in table if r[0] == conv])
        marks = faults(rows)
        cost, audit, given = cheapest(rows, marks)
        assert GOOD.fullmatch("".join(g[0] for g in given))
        turns = [t for t, _, _ in rows if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(marks.count(k) for k in ("blank", "duplicate", "truncated")),
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(given).encode()).hexdigest()))
    return sorted(out, key=str)


SCHEMA = "conv_id long, turn long, role string, text string, m int, mark string, audit string"


def check(spark, rows, tmp):
    spark.createDataFrame([(*r, 3, "x", "y") for r in rows], SCHEMA).write.parquet(f"{tmp}/conversations.parquet")
    got = queries.op11_conversation_repair(spark, tmp)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_repair_equals_a_search_over_all_edits(spark, tmpdir_path):
    rng = random.Random(5)
    rows = []
    for c in range(150):
        for t in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "admin"])
            text = rng.choice([f"t{t}.", "same!", "", " \t", "cut off", "ends. \n", f"q{t}?", "x" * 50])
            rows.append((c, rng.choice([t, t, t + 3, None]), role, text))
    rows += [(None, i, "user", f"{i}.") for i in range(4)] + [(1000, None, None, None), (1001, 2, "user", None)]
    rows += rows[:5]
    check(spark, rows, tmpdir_path)


def test_one_conversation_over_many_tasks_and_long_texts(spark, tmpdir_path):
    """A third of the rows are one conversation, much of it one repeated row; turns collide across task borders."""
    rng = random.Random(6)
    rows = [(7, t // 3, rng.choice(["user", "assistant"]), f"{t}." if t % 5 else "again.") for t in range(400)]
    rows += [(7, 50, "user", "copy.")] * 300 + [(8, 2**62, "user", "w " * 200_000 + "."), (8, -2**62, "assistant", "b.")]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}.") for c in range(100, 250) for t in range(6)]
    check(spark, rows, tmpdir_path)


def test_cells_equal_the_chart_of_all_spans_and_splits():
    rng = random.Random(1)
    for _ in range(60):
        rows = [rng.choice(list(cr.TERMINALS)) for _ in range(rng.randint(1, 9))]
        chart = {(i, i + 1): cr.TERMINALS[r] for i, r in enumerate(rows)}
        for size in range(2, len(rows) + 1):
            for i in range(len(rows) - size + 1):
                cells = [cr.join(chart[i, k], chart[k, i + size]) for k in range(i + 1, i + size)]
                chart[i, i + size] = [min((c[z] for c in cells if c[z]), default=None) for z in range(len(cr.PAIRS))]
        spans = cr.Spans()
        for r in rows:
            spans.add(cr.TERMINALS[r])
        assert spans.whole() == chart[0, len(rows)]
    one = cr.TERMINALS["u", False, True]
    assert cr.power(one, 5) == cr.join(cr.join(cr.join(cr.join(one, one), one), one), one)


def test_repaired_turns_and_edges(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Hi there"), (2, 0, "system", "Be brief."), (3, 0, "user", "")],
                                 "conv_id long, turn long, role string, text string")
    counted = cr.counted(rows)
    found = cr.report(counted)
    assert {r.conv_id: (r.cost, r.audit) for r in found.collect()} == {1: (3, "KR"), 2: (3, "D"), 3: (3, "D")}
    turns = [tuple(r) for r in cr.repaired(counted, found).orderBy("conv_id", "position").collect()]
    assert turns == [(1, 0, "user", "Hi.", "K"), (1, 1, "assistant", "Hi there", "R")]
    assert {r.conv_id: r.repaired_sha256 for r in cr.digests(counted, found).collect()}[1] == hashlib.sha256(
        b"user:Hi.\nassistant:Hi there").hexdigest()
    empty = cr.counted(rows.limit(0))
    assert cr.digests(empty, cr.report(empty)).count() == 0


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_on_the_table(spark, size):
    at = f"/root/testdata/{size}"
    rows = [tuple(r) for r in spark.read.parquet(f"{at}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, queries.op11_conversation_repair(spark, at).collect()), key=str) == brute(rows)
