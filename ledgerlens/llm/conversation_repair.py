"""Repair of conversation structure by weighted CYK parsing.

A conversation is well formed if its roles read ``(s?(ua)+)?``: perhaps a system
turn, then user and assistant in turn.  Each row may be kept (0), given the role
of user or assistant (2) or deleted (3, required for blank and repeated rows);
a turn without text may be inserted anywhere (2); a truncated row that is not
deleted costs 1 more.  The cheapest edits are wanted, and of those the audit
(the initials of the edits in order) that is least in ASCII.

**Grammar.**  The four states of the well-formed language (start, after system,
after user, after assistant) give the nonterminals ``[p,q]``: a span that leads
from state p to state q.  In Chomsky normal form the rules are ``[p,r] -> [p,q]
[q,r]``, and a row is a terminal of every ``[p,q]`` that one of its edits allows.
Insertions need no row, so they are closed beforehand: ``CLOSURE`` holds the
cheapest insertions that lead from p to q, and each row's cell is joined with it
on both sides.

**Cells and spans.**  A cell holds the least (cost, audit) per nonterminal.  An
audit of equal cost over the same rows is never the beginning of another (its
rest could only be insertions, which cost), so the least parts make the least
whole.  Cells are combined bottom-up by span length, 1, 2, 4 and so on: as every
nonterminal is a pair of states, each split of a span gives the same cell, and
one split per span is enough (the tests compare with the chart of all spans and
splits).  Copies of a row are joined by doubling.

**On Spark.**  Equal rows of a conversation are counted before they are shuffled.
The small rows (flags instead of texts) are dealt out by ranges of (conversation,
turn, role, text digest), so a long conversation lies in several tasks; each task
reduces its run of a conversation to one cell, and the few cells of a conversation
are joined in order.  What is held of a conversation at once is one character per
row and cell, never its texts.  ``repaired`` and ``digests`` then stream the rows
past their conversation's audit; a digest of a whole conversation has to be taken
in order, so that pass reads each conversation in one task, a row at a time.

Defined results: rows stand by turn (nulls first), then role, then the text's
SHA-256; a null role or text counts as one blank; a null conversation is one
conversation; a role counts by its first letter; rows that repeat are duplicates
(all but the first); an empty table gives an empty result; texts are never cut;
only the four named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import shuffle_parts, stored

BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: start, after system, after user, after assistant; and the nonterminals, pairs of states that a span can join.
START, SYSTEM, USER, ASSISTANT = range(4)
PAIRS = [(p, q) for p in range(4) for q in range(4)
         if p == q or (q, p) == (USER, ASSISTANT) or q > p]
RULES = [(x, y, PAIRS.index((p, r))) for x, (p, q) in enumerate(PAIRS) for y, (o, r) in enumerate(PAIRS) if o == q]
#: What a turn with this initial leads to from each state.
STEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
Cell = list  # per nonterminal (cost, audit) or None


def cell(entries: dict[tuple[int, int], tuple[int, str]]) -> Cell:
    return [entries.get(p) for p in PAIRS]


def join(left: Cell, right: Cell) -> Cell:
    """The cell of two spans side by side."""
    out: Cell = [None] * len(PAIRS)
    for x, y, z in RULES:
        a, b = left[x], right[y]
        if a is not None and b is not None:
            cost, old = a[0] + b[0], out[z]
            if old is None or cost < old[0]:
                out[z] = (cost, a[1] + b[1])
            elif cost == old[0] and a[1] + b[1] < old[1]:
                out[z] = (cost, a[1] + b[1])
    return out


def _closure() -> Cell:
    """The cheapest insertions from state to state."""
    same = {(p, p): (0, "") for p in range(4)}
    one = {(p, q): (INSERT, "I") for role in "ua" for p, q in STEPS[role].items()}
    step = cell(one | same)
    return join(step, join(step, step))


CLOSURE = _closure()
RUN = pa.schema([
    ("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("mark", pa.binary()), ("costs", pa.list_(pa.int64())),
    ("audits", pa.list_(pa.string())), ("first", pa.string()), ("last", pa.string()), ("low", pa.int64()), ("high", pa.int64()),
    ("turns", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64())])
_RUN = ("conv_id long, turn long, role string, mark binary, costs array<long>, audits array<string>, first string, last string, low long,"
        " high long, turns long, blank long, duplicate long, truncated long, illegal long")
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def terminal(initial: str, delete: bool, truncated: bool) -> Cell:
    """The cell of one row, insertions before and after it included."""
    entries = {(p, p): (DELETE, "D") for p in range(4)}
    if not delete:
        more = TRUNCATED * truncated
        for role in "ua":
            entries |= {(p, q): (REROLE + more, "R") for p, q in STEPS[role].items()}
        entries |= {(p, q): (KEEP + more, "K") for p, q in STEPS.get(initial, {}).items()}
    return join(join(CLOSURE, cell(entries)), CLOSURE)


TERMINALS = {(i, d, t): terminal(i, d, t) for i in ("s", "u", "a", "") for d in (False, True) for t in (False, True)}


def power(one: Cell, times: int) -> Cell:
    """``times`` equal spans side by side."""
    out, square = None, one
    while times:
        if times & 1:
            out = square if out is None else join(out, square)
        times >>= 1
        if times:
            square = join(square, square)
    return CLOSURE if out is None else out


class Spans:
    """The cells of a row of spans, combined by length as rows come in."""

    def __init__(self):
        self._open: list[tuple[int, Cell]] = []

    def add(self, one: Cell) -> None:
        size = 1
        while self._open and self._open[-1][0] == size:
            one = join(self._open.pop()[1], one)
            size *= 2
        self._open.append((size, one))

    def whole(self) -> Cell:
        out = None
        for _, c in reversed(self._open):
            out = c if out is None else join(c, out)
        return CLOSURE if out is None else out


def best(whole: Cell) -> tuple[int, str]:
    """Least (cost, audit) of a conversation: nothing is left, or it ends with an assistant turn."""
    return min(c for c in (whole[PAIRS.index((START, START))], whole[PAIRS.index((START, ASSISTANT))]) if c is not None)


def counted(rows: DataFrame, copies: Column | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """Different rows of each conversation with how often they occur.

    ``copies`` counts a row as so many; one that counts 0 is absent, but its conversation is reported.
    """
    def filled(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    found = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                        filled(role_col).alias("role"), filled(text_col).alias("text"),
                        (F.lit(1) if copies is None else copies).cast("long").alias("m"))
    distinct = found.groupBy("conv_id", "turn", "role", "text").agg(F.sum("m").alias("m"))
    return stored(distinct.withColumn("mark", F.unhex(F.sha2("text", 256))), "repair-rows")


def _symbols(rows: DataFrame) -> DataFrame:
    """What the parser needs of each row: its initial and its first fault, without the text."""
    end = F.rtrim("text", F.lit(BLANKS))
    flags = rows.select("conv_id", "turn", "role", "mark", "m", (end == "").alias("blank"),
                        (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("truncated"))
    place = F.struct(F.col("turn").isNotNull(), "turn")
    again = stored(flags.where("m > 0").groupBy("conv_id", "role", "mark").agg(F.min(place).alias("at"), F.count("*").alias("n"))
                   .where("n > 1").select(F.col("conv_id").alias("oc"), F.col("role").alias("orole"), F.col("mark").alias("om"),
                                          F.col("at.turn").alias("ot")), "repair-repeats")
    on = F.col("conv_id").eqNullSafe(F.col("oc")) & (F.col("role") == F.col("orole")) & (F.col("mark") == F.col("om"))
    later = F.col("om").isNotNull() & ~F.col("turn").eqNullSafe(F.col("ot"))
    return flags.join(again, on, "left").select("conv_id", "turn", "role", "mark", "m", "blank", "truncated", later.alias("later"))


class _Run:
    """Consecutive rows of one conversation, reduced to a cell and some counts."""

    def __init__(self, conv, turn, role, mark):
        self.key = (conv, turn, role, mark)
        self.spans, self.first, self.last, self.low, self.high = Spans(), None, None, None, None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn, role, m, blank, truncated, later):
        initial = role[:1] if role[:1] in STEPS else ""
        if blank:
            self.blank += m
            self.spans.add(power(TERMINALS[initial, True, False], m))
        else:
            self.duplicate += m - (not later)
            self.truncated += truncated and not later
            if not later:
                self.spans.add(TERMINALS[initial, False, truncated])
            if m > (not later):
                self.spans.add(power(TERMINALS[initial, True, False], m - (not later)))
        self.meet(role[:1], role[:1])
        self.illegal += m - 1  # a copy follows a row of its own role
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn

    def meet(self, first, last):
        """Roles that follow: whether the border is legal."""
        if self.first is None:
            self.first = first
        else:
            self.illegal += (self.last + first) not in ("su", "ua", "au")
        self.last = last

    def row(self):
        whole = self.spans.whole()
        return (*self.key, [c[0] if c else None for c in whole], [c[1] if c else None for c in whole], self.first, self.last,
                self.low, self.high, self.turns, self.blank, self.duplicate, int(self.truncated), self.illegal)

    def take(self, r: dict):
        """Join the run that follows."""
        self.spans.add([None if c is None else (c, a) for c, a in zip(r["costs"], r["audits"], strict=True)])
        if r["first"] is not None:
            self.meet(r["first"], r["last"])
        if r["low"] is not None:
            self.turns += r["turns"] - (r["low"] == self.high)
            self.low, self.high = r["low"] if self.low is None else self.low, r["high"]
        self.blank, self.duplicate = self.blank + r["blank"], self.duplicate + r["duplicate"]
        self.truncated, self.illegal = self.truncated + r["truncated"], self.illegal + r["illegal"]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _runs(symbols: DataFrame) -> DataFrame:
    """One row per task and conversation: the cell of the rows that lie there."""
    keys = ["conv_id", "turn", "role", "mark"]

    def run(batches):
        now, done = None, []
        for batch in batches:
            for conv, turn, role, mark, m, blank, truncated, later in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.key[0] != conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Run(conv, turn, role, mark)
                if m:
                    now.add(turn, role, m, blank, truncated, later)
            if done:
                yield _batch(done, RUN)
                done = []
        if now is not None:
            yield _batch([now.row()], RUN)

    return symbols.repartitionByRange(shuffle_parts(symbols.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(run, _RUN)


def report(rows: DataFrame) -> DataFrame:
    """Per conversation of ``counted`` rows: gaps, faults, and the cost and audit of its cheapest repair."""
    kinds = pa.schema([(n, pa.int64()) for n in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
                      + [("audit", pa.string())])
    rest = [c for c in RUN.names if c != "conv_id"]
    runs = _runs(stored(_symbols(rows), "repair-symbols"))
    gathered = runs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("runs"))

    def whole(batches):
        for batch in batches:
            done = []
            for conv, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                all_ = _Run(conv, None, None, None)
                for r in parts:
                    all_.take(r)
                cost, audit = best(all_.spans.whole())
                gaps = 0 if all_.low is None else min(all_.high - all_.low + 1 - all_.turns, 2**63 - 1)
                done.append((conv, gaps, all_.blank, all_.duplicate, all_.truncated, all_.illegal, cost, audit))
            yield _batch(done, kinds)

    return stored(gathered.mapInArrow(whole, REPORT), "repair-report")


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Replays audits: (report row, None) where a conversation begins, then (None, (role, text, edit)) per turn that remains."""
    about, at, state = None, 0, START

    def inserted():
        nonlocal at, state
        while at < len(about["audit"]) and about["audit"][at] == "I":
            at, state = at + 1, ASSISTANT if state == USER else USER
            yield None, ("assistant" if state == ASSISTANT else "user", "", "I")

    for batch in batches:
        for r in batch.to_pylist():
            if r["audit"] is not None:
                if about is not None:
                    yield from inserted()
                about, at, state = r, 0, START
                yield about, None
                continue
            for _ in range(r["m"]):
                yield from inserted()
                edit, at = about["audit"][at], at + 1
                if edit == "R":
                    state = ASSISTANT if state == USER else USER
                    yield None, ("assistant" if state == ASSISTANT else "user", r["text"], edit)
                elif edit == "K":
                    state = STEPS[r["role"][:1]][state]
                    yield None, (r["role"], r["text"], edit)
    if about is not None:
        yield from inserted()


def _in_order(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's report row and then its rows, in order, in one task."""
    both = found.withColumn("kind", F.lit(0)).unionByName(rows.where("m > 0").withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "mark")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: conv_id, position (from 0), role, text, edit."""
    kinds = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])

    def run(batches):
        conv, position, done = None, 0, []
        for about, turn in _turns(batches):
            if turn is None:
                conv, position = about["conv_id"], 0
                continue
            done.append((conv, position, *turn))
            position += 1
            if len(done) == 1000:
                yield _batch(done, kinds)
                done = []
        if done:
            yield _batch(done, kinds)

    return _in_order(rows, found).mapInArrow(run, "conv_id long, position long, role string, text string, edit string")


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The report with ``repaired_sha256``, of the repaired ``role:text`` joined by line feeds (lowercase hex)."""
    columns = [c.split()[0] for c in REPORT.split(", ")]
    kinds = pa.schema([(c, pa.string() if c == "audit" else pa.int64()) for c in columns] + [("repaired_sha256", pa.string())])

    def run(batches):
        done, about, sha, first = [], None, None, True
        for start, turn in _turns(batches):
            if turn is None:
                if about is not None:
                    done.append((*(about[c] for c in columns), sha.hexdigest()))
                about, sha, first = start, hashlib.sha256(), True
                if len(done) == 1000:
                    yield _batch(done, kinds)
                    done = []
            else:
                sha.update(f"{'' if first else chr(10)}{turn[0]}:{turn[1]}".encode())
                first = False
        if about is not None:
            done.append((*(about[c] for c in columns), sha.hexdigest()))
            yield _batch(done, kinds)

    return _in_order(rows, found).mapInArrow(run, REPORT + ", repaired_sha256 string")
