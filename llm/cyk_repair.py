"""Conversation repair by weighted CYK parsing over spans of turns.

A repaired conversation is empty, or an optional system turn followed by pairs of a user and an
assistant turn.  Edits: keep a turn (0), give it the role user or assistant (1), delete it (2,
the only edit for blank and repeated turns), insert an empty turn (5); a truncated
turn that stays adds 5.

*Grammar.*  Between turns a repaired conversation is in one of four places: at the start, after the
system turn, after a user turn, after an assistant turn.  Nonterminal [p q] derives every span
of turns whose repaired form leads from place p to place q.  In Chomsky normal form the rules
are [p q] -> [p r] [r q], and [p q] -> one turn with its edit; rules [p q] -> nothing are the insertions, and
their closure is folded into every cell, on both sides.  The start symbols are [start start] and [start assistant].

*Cells.*  A span has one cell per nonterminal: its least (cost, audit), where the audit holds the initials of
the edits, least in ASCII order among equals.  Edits of equal cost over one span are never each other's proper
prefix (what follows could only be insertions, which cost), so least cells make least cells.

*Spans.*  Cells are combined bottom-up by span length: 1, 2, 4 and so on.  CYK tries every split of a span.
Here one split is enough: nonterminals are pairs of places, so whatever passes from p to q passes
some place r at *every* split, and all splits yield the same cell (tested against the full chart).  So a
conversation costs linear time, and a long one is parsed in parts: turns are dealt by range, every task parses
the spans it holds and only the conversation at its either end is combined with what other tasks hold of it.

*Order.*  Turns go by number, null first, then by role and the MD5 of their text; a turn counts as repeated
from the second time on that role and text occur in its conversation.  Identical rows are counted, not moved one by one.

The repaired text is streamed in order by a task that holds one batch of it, since SHA-256 takes its input in
order; the audit, one letter a turn, is a value of the result and is held whole.

Null roles and texts are one space, null conversation ids make one conversation.  Conversations without turns
have zeros, an empty audit and the digest of the empty string.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import small_batches
from rankloom.runtime import materialize

START, SYSTEM, USER, ASSISTANT = range(4)
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Nonterminals; no edit leads back to the start or to the system turn.
PAIRS = [(p, q) for p in range(4) for q in range(4) if p == q or q > SYSTEM or (p, q) == (START, SYSTEM)]
AT = {pair: i for i, pair in enumerate(PAIRS)}
#: Per nonterminal, its right-hand sides.
RULES = [[(AT[p, r], AT[r, q]) for r in range(4) if (p, r) in AT and (r, q) in AT] for p, q in PAIRS]
#: What a kept turn of that initial does.
KEEPS = {"s": [(START, SYSTEM)], "u": [(START, USER), (SYSTEM, USER), (ASSISTANT, USER)], "a": [(USER, ASSISTANT)]}
LEGAL = ("su", "ua", "au")
#: Leaves parsed at once; such runs are remembered, as most conversations look alike.
LEAVES = 32
LEADING = r"[^\x20\x09-\x0D]"
CLOSED = r"[.!?][\x20\x09-\x0D]*\z"

Cell = tuple  # per nonterminal (cost, audit) or None


def combine(left: Cell, right: Cell) -> Cell:
    """The cells of a span from those of its two parts."""
    cells = []
    for sides in RULES:
        best = None
        for i, j in sides:
            x, y = left[i], right[j]
            if x is not None and y is not None:
                cost = x[0] + y[0]
                if best is None or cost <= best[0]:
                    found = (cost, x[1] + y[1])
                    if best is None or found < best:
                        best = found
        cells.append(best)
    return tuple(cells)


def cells_of(found: dict[tuple[int, int], tuple[int, str]]) -> Cell:
    return tuple(found.get(pair) for pair in PAIRS)


#: Insertion closure: what no turn at all derives.
CLOSURE = cells_of({(p, p): (0, "") for p in range(4)} | {
    (START, USER): (INSERT, "I"), (SYSTEM, USER): (INSERT, "I"), (ASSISTANT, USER): (INSERT, "I"), (USER, ASSISTANT): (INSERT, "I"),
    (START, ASSISTANT): (2 * INSERT, "II"), (SYSTEM, ASSISTANT): (2 * INSERT, "II")})


def leaf(code: str) -> Cell:
    """Closed cells of one turn: x must go; else its role's initial (o: any other), upper-case when truncated."""
    found = {(p, p): (DELETE, "D") for p in range(4)}
    if code != "x":
        extra = TRUNCATED if code.isupper() else 0
        for pair in KEEPS["u"] + KEEPS["a"]:
            found[pair] = (REROLE + extra, "R")
        for pair in KEEPS.get(code.lower(), ()):
            found[pair] = (extra, "K")
    return combine(combine(CLOSURE, cells_of(found)), CLOSURE)


LEAF = {code: leaf(code) for code in "suaoSUAOx"}


@lru_cache(maxsize=1 << 15)
def parse_leaves(codes: str) -> Cell:
    """Cells of a short run of leaves, bottom-up by span length."""
    spans = [LEAF[c] for c in codes]
    while len(spans) > 1:
        joined = [combine(a, b) for a, b in zip(spans[::2], spans[1::2], strict=False)]
        spans = joined + spans[2 * len(joined):]
    return spans[0] if spans else CLOSURE


class Spans:
    """Cells of a growing sequence: neighbouring spans of equal length join, so few are open at a time."""

    def __init__(self) -> None:
        self.open: list[tuple[int, Cell]] = []

    def add(self, cell: Cell, length: int = 1) -> None:
        while self.open and self.open[-1][0] <= length:
            before, left = self.open.pop()
            cell, length = combine(left, cell), before + length
        self.open.append((length, cell))

    def whole(self) -> Cell:
        cell = CLOSURE
        for _, left in reversed(self.open):
            cell = combine(left, cell)
        return cell


def parsed(cell: Cell) -> tuple[int, str]:
    """Cost and audit of a conversation with these cells."""
    return min(x for x in (cell[AT[START, START]], cell[AT[START, ASSISTANT]]) if x is not None)


class Part:
    """What is known of a conversation's consecutive turns."""

    def __init__(self) -> None:
        self.spans, self.pending = Spans(), ""
        self.first_turn = self.last_turn = self.first_role = self.last_role = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, initial: str, n: int, blank: bool, later: bool, cut: bool) -> None:
        """*n* identical turns."""
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        self._meet(initial)
        self.illegal += (n - 1) * (initial * 2 not in LEGAL)
        self.first_role = initial if self.first_role is None else self.first_role
        self.last_role = initial
        gone = blank or later
        self.blank += n if blank else 0
        self.duplicate += 0 if blank else n if later else n - 1
        self.truncated += cut and not gone
        code = "x" if gone else initial if initial in ("s", "u", "a") else "o"
        self.pending += code.upper() if cut and not gone else code
        self._feed(n - 1)

    def _feed(self, more: int) -> None:
        """*more* turns that must go follow the pending ones."""
        while len(self.pending) + more >= LEAVES:
            fill = max(0, LEAVES - len(self.pending))
            more -= fill
            self.pending += "x" * fill
            self.spans.add(parse_leaves(self.pending[:LEAVES]), LEAVES)
            self.pending = self.pending[LEAVES:]
        self.pending += "x" * more

    def _meet(self, initial: str) -> None:
        if self.last_role is not None:
            self.illegal += self.last_role + initial not in LEGAL

    def cell(self) -> Cell:
        return combine(self.spans.whole(), parse_leaves(self.pending))

    def counts(self, cell: Cell) -> tuple:
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, *parsed(cell))

    def state(self, cell: Cell) -> dict:
        return {"first_turn": self.first_turn, "last_turn": self.last_turn, "turns": self.turns, "first_role": self.first_role,
                "last_role": self.last_role, "costs": [x and x[0] for x in cell], "audits": [x and x[1] for x in cell]}

    def follow(self, counts: dict, state: dict) -> None:
        """The part described by *counts* and *state* comes next."""
        if state["first_turn"] is not None:
            self.turns += state["turns"] - (state["first_turn"] == self.last_turn)
            self.first_turn = state["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = state["last_turn"]
        if state["first_role"] is not None:
            self._meet(state["first_role"])
            self.first_role = state["first_role"] if self.first_role is None else self.first_role
            self.last_role = state["last_role"]
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + counts[name])
        self.spans.add(tuple(None if c is None else (c, a) for c, a in zip(state["costs"], state["audits"], strict=True)))


COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
COUNT_NAMES = [x.split()[0] for x in COUNTS.split(", ")]
STATE = pa.struct([("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64()), ("first_role", pa.string()),
                   ("last_role", pa.string()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])
STATE_SQL = ("struct<first_turn:long,last_turn:long,turns:long,first_role:string,last_role:string,"
             "costs:array<long>,audits:array<string>>")


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults planted by the hash of conversation and turn: conv_id, turn, role, text, copies (0: dropped)."""
    def spaced(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    rule = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(rule == 1, "").when(rule == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    return turns.select(
        "conv_id", "turn", F.when(rule == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"),
        F.when(rule == 0, 0).when(rule == 3, 2).otherwise(1).alias("copies"))


def _told_apart(turns: DataFrame) -> DataFrame:
    """Turns (copies taken as 1 where the column is missing) with the digest of their text."""
    copies = F.coalesce("copies", F.lit(1)) if "copies" in turns.columns else F.lit(1)
    text = F.coalesce("text", F.lit(" "))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                        text.alias("text"), copies.cast("long").alias("n"), F.md5(text.cast("binary")).alias("digest"))


def turn_runs(turns: DataFrame) -> DataFrame:
    """Identical turns as one narrow row: conv_id, turn, role, digest, n, blank, cut, later (seen before)."""
    key = ["conv_id", "turn", "role", "digest"]
    runs = materialize(_told_apart(turns).withColumn("blank", ~F.col("text").rlike(LEADING)).withColumn(
        "cut", ~F.col("text").rlike(CLOSED)).groupBy(*key).agg(
        F.sum("n").alias("n"), F.max("blank").alias("blank"), F.max("cut").alias("cut")), "turn-runs")
    repeated = runs.where("n > 0 AND NOT blank").groupBy("conv_id", "role", "digest").agg(
        F.count("*").alias("times"), F.max(F.col("turn").isNull()).alias("unnumbered"), F.min("turn").alias("first")).where(
        "times > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "unnumbered", "first")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    later = F.when(F.col("unnumbered"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first"))
    return runs.join(repeated, same, "left").select(*key, "n", "blank", "cut", F.coalesce(later, F.lit(False)).alias("later"))


def parse_conversations(turns: DataFrame) -> DataFrame:
    """Per conversation of *turns* (conv_id, turn, role, text, maybe copies): conv_id, its counts, cost and audit."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, current, place, first = None, None, 0, True

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            ids, where, edges, counts, states = zip(*rows, strict=True) if rows else [()] * 5
            columns = list(zip(*counts, strict=True)) if counts else [()] * len(COUNT_NAMES)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, ids_type), pa.array(where, pa.int32()), pa.array(edges, pa.bool_()),
                 *(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.string()), pa.array(states, STATE)],
                ["conv_id", "part", "edge", *COUNT_NAMES, "state"])

        def closed(edge: bool) -> tuple:
            cell = part.cell()
            return current, place, edge, part.counts(cell), part.state(cell) if edge else None

        for batch in batches:
            rows = []
            ids_type = batch.column(0).type
            for conv, turn, initial, n, blank, cut, later, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part is None or conv != current:
                    if part is not None:
                        rows.append(closed(first))
                        first = False
                    part, current = Part(), conv
                if n:
                    part.add(turn, initial, n, blank, later, cut)
            yield batch_of(rows)
        if part is not None:
            yield batch_of([closed(True)])

    def join(table: pa.Table) -> pa.Table:
        part = Part()
        for row in sorted(table.drop_columns(["conv_id"]).to_pylist(), key=lambda r: r["part"]):
            part.follow(row, row["state"])
        counts = part.counts(part.cell())
        return pa.table([table["conv_id"].slice(0, 1), *(pa.array([c], pa.int64()) for c in counts[:-1]),
                         pa.array([counts[-1]], pa.string())], names=["conv_id", *COUNT_NAMES])

    order = ["conv_id", "turn", "role", "digest"]
    dealt = turn_runs(turns).repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", "turn", F.left("role", F.lit(1)).alias("initial"), "n", "blank", "cut", "later", F.spark_partition_id().alias("part"))
    found = materialize(dealt.mapInArrow(
        parts, f"conv_id {kind}, part int, edge boolean, {COUNTS}, state {STATE_SQL}"), "conversation-parts")
    at_ends = found.where("edge").groupBy("conv_id").applyInArrow(join, f"conv_id {kind}, {COUNTS}")
    return found.where("NOT edge").select("conv_id", *COUNT_NAMES).unionByName(at_ends)


class Replay:
    """Applies an audit to the turns of one conversation, in order."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.place = audit, 0, START

    def _assigned(self) -> str:
        self.place = ASSISTANT if self.place == USER else USER
        return "assistant" if self.place == ASSISTANT else "user"

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the insertions that come next."""
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            yield "I", self._assigned(), ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of what stands up to and with this turn."""
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.place = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
            yield edit, role, text
        elif edit == "R":
            yield edit, self._assigned(), text


def _in_order(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Every conversation's row of *found* followed by its turns, all in one partition."""
    told = _told_apart(turns).where("n > 0")
    order = ["conv_id", "is_turn", "turn", "role", "digest"]
    return told.withColumn("is_turn", F.lit(True)).unionByName(
        found.withColumn("is_turn", F.lit(False)), allowMissingColumns=True).repartition("conv_id").sortWithinPartitions(
        *order).select("conv_id", "is_turn", "role", "text", "n", *COUNT_NAMES)


def repaired_turns(turns: DataFrame) -> DataFrame:
    """The repaired conversations as rows: conv_id, place (from 0), role, text, edit (K, R or I)."""
    small_batches(turns.sparkSession)
    kind = turns.schema["conv_id"].dataType.simpleString()

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, current, place = None, None, 0
        for batch in batches:
            rows: list[tuple] = []

            def put(found: Iterable[tuple[str, str, str]]) -> None:
                nonlocal place
                for edit, role, text in found:
                    rows.append((current, place, role, text, edit))
                    place += 1

            names = ["conv_id", "is_turn", "role", "text", "n", "audit"]
            for conv, is_turn, role, text, n, audit in zip(*(batch[x].to_pylist() for x in names), strict=True):
                if not is_turn:
                    if replay:
                        put(replay.inserted())
                    replay, current, place = Replay(audit), conv, 0
                else:
                    for _ in range(n):
                        put(replay.turn(role, text))
            yield out(rows, batch.column(0).type)
            last = batch.column(0).type
        if replay:
            rows = []
            for edit, role, text in replay.inserted():
                rows.append((current, place, role, text, edit))
                place += 1
            yield out(rows, last)

    def out(rows: list[tuple], ids: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = [ids, pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                          ["conv_id", "place", "role", "text", "edit"])

    found = materialize(parse_conversations(turns), "parsed-conversations")
    return _in_order(turns, found).mapInArrow(write, f"conv_id {kind}, place long, role string, text string, edit string")


def repair_conversations(turns: DataFrame) -> DataFrame:
    """Per conversation: conv_id, counts, cost, audit and repaired_sha256 of its ``role:text`` lines."""
    small_batches(turns.sparkSession)
    kind = turns.schema["conv_id"].dataType.simpleString()

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = row = hashed = None

        def put(found: Iterable[tuple[str, str, str]]) -> None:
            nonlocal hashed
            for _, role, text in found:
                if hashed is None:
                    hashed = sha256()
                else:
                    hashed.update(b"\n")
                hashed.update(f"{role}:{text}".encode())

        def done() -> tuple[pa.RecordBatch, str]:
            put(replay.inserted())
            return row, (hashed or sha256()).hexdigest()

        def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if rows:
                table = pa.Table.from_batches([r for r, _ in rows]).combine_chunks().append_column(
                    "repaired_sha256", pa.array([h for _, h in rows], pa.string()))
                yield from table.to_batches()

        for batch in batches:
            rows = []
            is_turn, role, text, n = (batch[x].to_pylist() for x in ("is_turn", "role", "text", "n"))
            for i in range(batch.num_rows):
                if not is_turn[i]:
                    if replay:
                        rows.append(done())
                    row = batch.slice(i, 1).select(["conv_id", *COUNT_NAMES])
                    replay, hashed = Replay(row["audit"][0].as_py()), None
                else:
                    for _ in range(n[i]):
                        put(replay.turn(role[i], text[i]))
            yield from out(rows)
        if replay:
            yield from out([done()])

    found = materialize(parse_conversations(turns), "parsed-conversations")
    return _in_order(turns, found).mapInArrow(digest, f"conv_id {kind}, {COUNTS}, repaired_sha256 string")
