"""Repairs against all edits where rows are few, and against a DP that keeps whole strings where they are many."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from weft.llm import turns

TURNS = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\f\r"
FORM = re.compile("(s?(ua)+)?").fullmatch


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        m = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if m == 1 else re.sub("[.!?]", "", text) if m == 2 else text
        out += [(conv, turn, "user" if m == 4 else role, text)] * (0 if m == 0 else 2 if m == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))


def fault_of(rows, k):
    bare = rows[k][3].strip(SPACE)
    if not bare:
        return "blank"
    if any(r[2:] == rows[k][2:] for r in rows[:k]):
        return "duplicate"
    return "" if bare[-1] in ".!?" else "truncated"


def choices(row, fault):
    """(cost, initial, kept line or None) of what may become of a row."""
    cut = fault == "truncated"
    out = [(3, "D", None)]
    if fault in ("", "truncated"):
        out += [(cut, "K", row[2:])] + [(2 + cut, "R", (r, row[3])) for r in ("user", "assistant")]
    return out


def exhaustive(rows, faults):
    runs = [c for k in range(3) for c in itertools.product(("user", "assistant"), repeat=k)]
    best = None
    for plan in itertools.product(*[[(run, c) for run in runs for c in choices(r, f)] for r, f in zip(rows, faults)]):
        for tail in runs:
            cost, audit, lines = 0, "", []
            for run, (price, edit, line) in plan:
                cost, audit = cost + price + 2 * len(run), audit + "I" * len(run) + edit
                lines += [(r, "") for r in run] + ([line] if line else [])
            cost, audit, lines = cost + 2 * len(tail), audit + "I" * len(tail), lines + [(r, "") for r in tail]
            if (best is None or (cost, audit) <= best[:2]) and FORM("".join(r[:1] or "-" for r, _ in lines)):
                best = (cost, audit, lines)
    return best


def strings(rows, faults):
    """The same by states that keep their whole cheapest audit and lines."""
    state_of = {"": "", "s": "s", "u": "u", "a": "a"}
    follows = lambda state, initial: (initial == "s" and state == "") or (initial == "u" and state in ("", "s", "a")) or (initial == "a" and state == "u")

    def closed(layer):
        for _ in range(4):
            for state, (cost, audit, lines) in list(layer.items()):
                for role in ("user", "assistant"):
                    if follows(state, role[0]):
                        new = (cost + 2, audit + "I", lines + [(role, "")])
                        if role[0] not in layer or new[:2] < layer[role[0]][:2]:
                            layer[role[0]] = new
        return layer

    layer = {state_of[""]: (0, "", [])}
    for row, fault in zip(rows, faults):
        after = {}
        # inserts that wait may come before or after a row's edit; all layers are kept closed under them
        for state, (cost, audit, lines) in closed(layer).items():
            for price, edit, line in choices(row, fault):
                if line is None or follows(state, line[0][:1]):
                    to = state if line is None else line[0][:1]
                    new = (cost + price, audit + edit, lines + ([line] if line else []))
                    if to not in after or new[:2] < after[to][:2]:
                        after[to] = new
        layer = after
    return min((v for s, v in closed(layer).items() if s in ("", "a")), key=lambda v: v[:2])


def plain(rows, way=strings):
    out = []
    for conv in {r[0] for r in rows}:
        own = damage([r for r in rows if r[0] == conv])
        faults = [fault_of(own, k) for k in range(len(own))]
        cost, audit, lines = way(own, faults)
        at = [r[1] for r in own if r[1] is not None]
        gaps = max(at) - min(at) + 1 - len(set(at)) if at else 0
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def made(seed, convs, most, roles=("user", "assistant", "system"), step=2):
    rng, rows = random.Random(seed), []
    for conv in range(convs):
        turn = 0
        for _ in range(rng.randint(1, most)):
            rows.append((conv, turn, rng.choice(roles), rng.choice(["A b.", "c d!", "open end", "", " \t", "A b.", f"own {rng.random()}?"])))
            turn += rng.randint(0, step)
    rng.shuffle(rows)
    return rows


def run(spark, rows, **how):
    return sorted((tuple(r) for r in turns.repaired(spark.createDataFrame(rows, TURNS).repartition(3), **how).collect()), key=repr)


def test_codes_are_ordered_and_free_of_prefixes():
    assert turns.CODES == sorted(turns.CODES) and not any(a != b and b.startswith(a) for a in turns.CODES for b in turns.CODES)


def test_the_two_brute_forces_agree():
    rows = made(5, 120, 2, ("user", "assistant", "system", "tool", ""))
    assert plain(rows) == plain(rows, exhaustive)


@pytest.mark.parametrize("seed", [1, 2])
def test_small_against_all_edits(spark, seed):
    rows = made(seed, 150, 2, ("user", "assistant", "system", "tool", "U", ""))
    assert run(spark, rows) == plain(rows, exhaustive)


@pytest.mark.parametrize("block", [4096, 7])
def test_conversations_over_blocks(spark, block):
    rows = made(3, 40, 9) + [(1000, t, r, x) for _, t, r, x in made(4, 1, 1)] + [(2000 + i % 2, i, random.Random(i).choice(["user", "assistant", "system"]), random.Random(i).choice(["x.", "y", f"{i}!"])) for i in range(300)]
    assert run(spark, rows, block=block) == plain(rows)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(1, None, "user", "a."), (1, None, None, "b."), (1, 3, "assistant", None), (None, 1, "user", "q."), (None, None, None, None), (2, 1, "user", "z."), (2, 1, "assistant", "z."), (2, 1, "user", "y.")]
    rows += [(3, 5, "user", "same.")] * 30 + [(4, 10**15, "system", "s."), (4, -(10**15), "user", "long " * 50_000 + ".")]
    assert run(spark, rows) == plain(rows)


def test_a_conversation_whose_rows_are_all_dropped(spark):
    lost = [(c, 0, "user", "a.") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert lost and run(spark, lost) == [(*r[:1], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in sorted(lost, key=repr)]


def test_empty_and_other_columns(spark):
    assert run(spark, []) == []
    rows = made(8, 20, 4)
    frame = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], TURNS + ", g int, audit string, block string")
    assert sorted((tuple(r) for r in turns.repaired(frame).collect()), key=repr) == plain(rows)


def test_the_given_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in turns.repaired(frame).collect()), key=repr) == plain(rows)
