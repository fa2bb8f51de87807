"""Repair of the structure of conversations by the cheapest edits.

A conversation's rows are edited until the initials of its roles read (s?(ua)+)?. One macro edit is a run of inserted turns and what
becomes of one given row (D, K or R): the codes I*(D|K|R) are prefix-free, so edits of equally many rows compare as lists of codes, and
a code is a number in that order. The DP goes row by row over four states (nothing yet, after s, after u, after a). A layer keeps a cost
and a rank for each state: the rank replaces the audit string, since of two states the one with the lesser string keeps the lesser
rank whatever codes follow. A layer less its smallest cost is one of a few hundred values, so a step is a look-up. Parent pointers
give the codes back.

A stretch of rows is a table of cost and rank for each state before and after it, and such tables compose as rows do. Rows are ranked by
a sort over ranges and cut into blocks of BLOCK whatever conversations they belong to; a block sends up the tables of its first
and last conversation, blocks of tables send up theirs, until one block is left; states then come down to the rows. So a conversation
of any length is spread over tasks. Only its digest and its audit string, which are sequences by definition, are made in one
task: there the sorted rows stream by, and no text is held but the present one.

Defined results: a null role or text, and a null id or turn in the key of the damage, is one space; rows of one turn are ordered by
role and the text's digest; a null turn comes first; all rows with a null conv_id are one conversation; roles whose initial is none of
s, u, a are never kept; other columns take no part; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import ranked
from ..storage import written
from .common import partitions

#: rows of a block, 4 at least: two tables of each go up
BLOCK = 1 << 12
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
MOST_RUN = 2  # a longer run of inserts comes back to a state it has left
START, SYSTEM, USER, ASSISTANT = range(4)
CODES = sorted("I" * k + e for k in range(MOST_RUN + 1) for e in "DKR")
#: the state that an inserted turn or a new role leads to, and the inserts that a conversation may still need at its end
NEXT = (USER, USER, ASSISTANT, USER)
TAIL = (0, 2, 1, 0)
NAMES = {USER: "user", ASSISTANT: "assistant"}
SPACE = " \t\n\x0b\f\r"
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy of turns as the key's crc32 damages them."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), (F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20).alias("_m"))
    rows = rows.filter("_m <> 0").select("conv_id", "turn", F.expr("if(_m = 4, 'user', role)").alias("role"), F.expr("case _m when 1 then '' when 2 then translate(text, '.!?', '') else text end").alias("text"), F.expr("if(_m = 3, array(0, 1), array(0))").alias("copy"))
    return rows.withColumn("copy", F.explode("copy"))


def keys(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, cls, blank, cut of rows: all that the DP needs, without texts."""
    bare = F.rtrim("text", F.lit(SPACE))
    cls = F.expr("case substr(role, 1, 1) when 's' then 0 when 'u' then 1 when 'a' then 2 else 3 end")
    return rows.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), cls.alias("cls"), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"), "copy", F.spark_partition_id().alias("from"))


def items(rows: DataFrame) -> DataFrame:
    """g, conv_id, turn, role, digest, fault, kind: rows in their order, each with its first fault and its kind of step."""
    order = ["conv_id", "turn", "role", "digest", "from", "copy"]
    placed = written(ranked(keys(rows), [F.col(c) for c in order], "g"), "turns")
    first = placed.groupBy("conv_id", "role", "digest").agg(F.min("g").alias("g")).select("g", F.lit(True).alias("first"))
    fault = F.expr(f"case when blank then {BLANK} when first is null then {DUPLICATE} when cut then {TRUNCATED} else {NONE} end")
    return placed.join(first, "g", "left").select((F.col("g") - 1).cast("long").alias("g"), "conv_id", "turn", "role", "digest", fault.alias("fault"), (F.col("cls") + 4 * fault).alias("kind"))


def table_of(kind: int) -> list[list]:
    """(cost, code) of the best macro edit between each two states, for a kind of row."""
    cls, fault = kind % 4, kind // 4
    best = [[None] * 4 for _ in range(4)]

    def offer(p, q, cost, code):
        now = (cost, CODES.index(code))
        if best[p][q] is None or now < best[p][q]:
            best[p][q] = now

    for p in range(4):
        state = p
        for k in range(MOST_RUN + 1):
            run, cost, cut = "I" * k, INSERT * k, CUT * (fault == TRUNCATED)
            offer(p, state, cost + DELETE, run + "D")
            if fault in (NONE, TRUNCATED):
                offer(p, NEXT[state], cost + REROLE + cut, run + "R")
                if (cls == 0 and state == START) or (cls == 1 and NEXT[state] == USER) or (cls == 2 and NEXT[state] == ASSISTANT):
                    offer(p, (SYSTEM, USER, ASSISTANT)[cls], cost + KEEP + cut, run + "K")
            state = NEXT[state]
    return best


TABLES = [table_of(kind) for kind in range(16)]


def only(state: int) -> tuple:
    return tuple((0, 0) if s == state else None for s in range(4))


def advance(layer: tuple, table: list[list]) -> tuple[tuple, int, tuple]:
    """The next layer less its smallest cost, that cost, and for each state its parent and the code of the step."""
    best = [None] * 4
    for p, own in enumerate(layer):
        if own is not None:
            for q, step in enumerate(table[p]):
                if step is not None:
                    now = (own[0] + step[0], own[1], step[1], p)
                    if best[q] is None or now < best[q]:
                        best[q] = now
    ranks = {k: i for i, k in enumerate(sorted({b[1:3] for b in best if b is not None}))}
    low = min(b[0] for b in best if b is not None)
    return tuple(None if b is None else (b[0] - low, ranks[b[1:3]]) for b in best), low, tuple(None if b is None else (b[3], b[2]) for b in best)


class Chain:
    """The DP over a stretch of items. Steps of rows are looked up; those of tables are worked out."""

    steps: dict[tuple, tuple] = {}

    def __init__(self, of: list, entry: int):
        self.layer, self.cost, self.parents = only(entry), 0, []
        for item in of:
            if isinstance(item, int):
                step = self.steps.get((self.layer, item))
                if step is None:
                    step = self.steps[self.layer, item] = advance(self.layer, TABLES[item])
            else:
                step = advance(self.layer, item)
            self.layer, low, parents = step
            self.cost += low
            self.parents.append(parents)

    def end(self) -> int:
        """The state in which the cheapest edits of a whole conversation leave it, of equal ones the least."""
        return min((own[0] + INSERT * TAIL[s], own[1], s) for s, own in enumerate(self.layer) if own is not None)[2]

    def trace(self, state: int) -> list[tuple[int, int, int]]:
        """State before, state after, and code of each item, for the best way to a state."""
        out = []
        for parents in reversed(self.parents):
            before, code = parents[state]
            out.append((before, state, code))
            state = before
        return out[::-1]


def as_table(of: list) -> bytes:
    """A stretch as one item: cost and rank for each state before it and after it; -1 where there is no way."""
    out = np.full((4, 4, 2), -1, np.int64)
    for p in range(4):
        chain = Chain(of, p)
        for q, own in enumerate(chain.layer):
            if own is not None:
                out[p, q] = chain.cost + own[0], own[1]
    return out.tobytes()


def item(raw) -> int | list:
    if isinstance(raw, int):
        return raw
    return [[None if c < 0 else (c, r) for c, r in row] for row in np.frombuffer(raw, np.int64).reshape(4, 4, 2).tolist()]


def stretches(table: pa.Table) -> list[tuple[int, int]]:
    """Ranges of the rows of each conversation in a sorted block."""
    conv = table.column("conv_id")
    value, known = conv.fill_null(0).to_numpy(), conv.is_valid().to_numpy()
    cuts = np.flatnonzero((value[1:] != value[:-1]) | (known[1:] != known[:-1])) + 1
    edge = [0, *cuts.tolist(), len(value)]
    return list(zip(edge, edge[1:]))


UP = "g long, conv_id long, kind binary"


def sent_up(table: pa.Table) -> pa.Table:
    """The first and the last conversation of a block as items of the level above."""
    table = table.sort_by("g")
    block, kinds = table.column("block")[0].as_py(), [item(k) for k in table.column("kind").to_pylist()]
    found = stretches(table)
    found = [found[0], found[-1]] if len(found) > 1 else found
    conv = table.column("conv_id")
    return pa.table([pa.array([2 * block + k for k in range(len(found))], pa.int64()), pa.array([conv[a].as_py() for a, _ in found], pa.int64()), pa.array([as_table(kinds[a:z]) for a, z in found], pa.binary())], names=["g", "conv_id", "kind"])


def walked(table: pa.Table, given: dict[int, tuple[int, int]]) -> list[tuple[int, int, int]]:
    """State before, state after, and code of each item of a sorted block. given: states around its first (0) and last (1) conversation;
    all others are whole."""
    kinds, out, found = [item(k) for k in table.column("kind").to_pylist()], [], stretches(table)
    for i, (a, z) in enumerate(found):
        side = 0 if i == 0 else 1 if i == len(found) - 1 else None
        entry, leave = given.get(side, (START, None))
        chain = Chain(kinds[a:z], entry)
        out += chain.trace(chain.end() if leave is None else leave)
    return out


EDITS = "conv_id long, turn long, role string, digest binary, g long, fault int, code int"


def edits(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, turn, role, digest, g, fault, code of rows (conv_id, turn, role, text, copy)."""
    cut = lambda d: d.withColumn("block", F.expr(f"g div {block}L"))
    levels = [cut(written(items(rows), "items"))]
    size = levels[0].count()
    while size > block:
        size = 2 * -(-size // block)
        levels.append(cut(written(levels[-1].select("block", "g", "conv_id", "kind").groupBy("block").applyInArrow(sent_up, UP), "tables")))
    given = None
    for level in reversed(levels[1:]):
        columns = level.select("block", "g", "conv_id", "kind")

        def down(table, states):
            table = table.sort_by("g")
            way = walked(table, states)
            return pa.table([table.column("g"), *(pa.array([w[k] for w in way], pa.int32()) for k in (0, 1))], names=["g", "entry", "leave"])

        given = written(by_block(columns, given, down, "g long, entry int, leave int"), "states")

    def rows_out(table, states):
        table = table.sort_by("g")
        code = pa.array([w[2] for w in walked(table, states)], pa.int32())
        return pa.table([*(table.column(c) for c in ("conv_id", "turn", "role", "digest", "g", "fault")), code], names=["conv_id", "turn", "role", "digest", "g", "fault", "code"])

    return by_block(levels[0], given, rows_out, EDITS)


def by_block(level: DataFrame, given: DataFrame | None, run, schema: str) -> DataFrame:
    """run(block, states that the level above has found for its ends)."""
    if given is None:
        return level.groupBy("block").applyInArrow(lambda own: run(own, {}), schema)
    states = given.selectExpr("g div 2 block", "cast(g % 2 as int) side", "entry", "leave")

    def both(own: pa.Table, found: pa.Table) -> pa.Table:
        return run(own, {s: (a, z) for s, a, z in zip(*(found.column(c).to_pylist() for c in ("side", "entry", "leave")))})

    return level.groupBy("block").cogroup(states.groupBy("block")).applyInArrow(both, schema)


class Repair:
    """What comes of one conversation, row by row."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.state, self.cost = conv_id, START, 0
        self.faults, self.illegal, self.last = [0] * 4, 0, None
        self.low = self.high = self.turn = None
        self.turns, self.audit, self.hash, self.lines = 0, [], hashlib.sha256(), 0

    def line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + role + ":" + text).encode())
        self.lines += 1

    def insert(self, many: int) -> None:
        for _ in range(many):
            self.state = NEXT[self.state]
            self.line(NAMES[self.state], "")
        self.cost += INSERT * many

    def row(self, turn: int | None, role: str, text: str, fault: int, code: int) -> None:
        if turn is not None and turn != self.high:
            self.low, self.high = turn if self.low is None else self.low, turn
            self.turns += 1
        self.faults[fault] += 1
        initial = role[:1]
        self.illegal += self.last is not None and self.last + initial not in ("su", "ua", "au")
        self.last = initial
        edit = CODES[code]
        self.audit.append(edit)
        self.insert(len(edit) - 1)
        if edit[-1] == "D":
            self.cost += DELETE
            return
        if edit[-1] == "R":
            self.state, self.cost = NEXT[self.state], self.cost + REROLE
            role = NAMES[self.state]
        else:
            self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[initial]
        self.cost += CUT * (fault == TRUNCATED)
        self.line(role, text)

    def result(self) -> tuple:
        tail = TAIL[self.state]
        self.insert(tail)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv_id, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit) + "I" * tail, self.hash.hexdigest()


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_KINDS = (*[pa.int64()] * 7, pa.string(), pa.string())


def repaired(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of turns (conv_id, turn, role,
    text), after the damage."""
    rows = damaged(turns)
    found = edits(rows, block)
    # of each conversation first a row that names it, then of equal rows the edits and as many texts
    null = lambda kind: F.lit(None).cast(kind)
    marks = turns.select("conv_id").distinct().select("conv_id", F.lit(0).alias("part"), null("long").alias("turn"), null("string").alias("role"), null("binary").alias("digest"), null("long").alias("g"), null("int").alias("fault"), null("int").alias("code"), null("string").alias("text"))
    codes = found.select("conv_id", F.lit(1).alias("part"), "turn", "role", "digest", "g", "fault", "code", null("string").alias("text"))
    texts = rows.select("conv_id", F.lit(1).alias("part"), "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), null("long").alias("g"), null("int").alias("fault"), null("int").alias("code"), "text")
    every = marks.union(codes).union(texts).repartition(partitions(turns.sparkSession), "conv_id")
    every = every.sortWithinPartitions("conv_id", "part", "turn", "role", "digest", F.asc_nulls_last("g"))
    names = [f.split()[0] for f in RESULT.split(", ")]

    def run(batches):
        now, waiting, done = None, deque(), []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "part", "turn", "role", "fault", "code", "text")]
            for conv_id, part, turn, role, fault, code, text in zip(*columns):
                if not part:
                    done += [now.result()] if now else []
                    now = Repair(conv_id)
                elif code is not None:
                    waiting.append((fault, code))
                else:
                    now.row(turn, role, text, *waiting.popleft())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), _KINDS)], names=names)
                done = []
        if now:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(now.result()), _KINDS)], names=names)

    return every.select("conv_id", "part", "turn", "role", "fault", "code", "text").mapInArrow(run, RESULT)
