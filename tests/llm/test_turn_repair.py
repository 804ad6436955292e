"""Conversation repair against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from fieldspan.llm.turn_repair import MOVES, VECTORS, backward, damaged, repair, repair_damaged

ROWS = "conv_id long, turn long, role string, text string, part string, at int, number int, blank int"
LEGAL = re.compile("(s?(ua)+)?")
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(rows):
    """(cost, audit, lines) by trying every edit from every state, backwards. Rows: (role, text, forced, truncated)."""
    best = {"": (0, "", ()), "s": (6, "II", ("user:", "assistant:")), "u": (3, "I", ("assistant:",)), "a": (0, "", ())}
    name = {"u": "user", "a": "assistant"}
    for role, text, forced, truncated in reversed(rows):
        now = {}
        for state in best:
            ways = []
            for inserted in range(3):
                at, lines = state, []
                for _ in range(inserted):
                    at = NEXT[at]
                    lines.append(f"{name[at]}:")
                edits = [("D", 4, at, [])]
                if not forced:
                    edits.append(("R", 3 + 3 * truncated, NEXT[at], [f"{name[NEXT[at]]}:{text}"]))
                    if (at + role[:1]) in ("s", "u", "su", "ua", "au") and role:
                        edits.append(("K", 3 * truncated, role[:1], [f"{role}:{text}"]))
                for edit, cost, to, line in edits:
                    ways.append((3 * inserted + cost + best[to][0], "I" * inserted + edit + best[to][1], (*lines, *line, *best[to][2])))
            now[state] = min(ways)
        best = now
    return best[""]


def by_hand(given, keep_damage=True):
    found = []
    convs = {}
    for conv, turn, role, text in given:
        convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if keep_damage else 9
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs[conv] += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        seen, marked, counts = set(), [], [0, 0, 0]
        for _, _, role, text in rows:
            shown = VISIBLE.findall(text)
            fault = 0 if not shown else 1 if (role, text) in seen else 2 if shown[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            marked.append((role, text, fault in (0, 1), fault == 2))
        turns = [t for known, t, _, _ in rows if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, lines = cheapest(marked)
        assert LEGAL.fullmatch("".join(x[:1] for x in lines))
        found.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(found, key=repr)


def conversations(seed, n, longest):
    rnd = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rnd.randint(1, longest)):
            role = rnd.choice(["user", "assistant"] * 3 + ["system", "tool", "usher", "", None])
            text = rnd.choice(["Yes.", "No!", "Why?", "cut off", "ends. \n\t", "  ", "", None, "a.b", "日本。", f"Own {rnd.random()}."])
            rows.append((conv, rnd.choice([turn, turn, turn, None, turn * 2, -turn]), role, text))
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (-3, None, None, None), (-4, 5, "system", "Be."), (-5, 1, "user", "x" * 100_000 + ".")]
    return rows + rnd.sample(rows, 10)


def given(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], ROWS)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"chunk_rows": 3}, {"chunk_rows": 2, "fix_ups": 0}])
def test_equals_brute_force(spark, options):
    rows = conversations(3, 120, 14)
    assert found(repair_damaged(given(spark, rows), **options)) == by_hand(rows)
    assert found(repair(given(spark, rows), **options)) == by_hand(rows, keep_damage=False)


def test_cheapest_is_the_cheapest():
    """The checker itself against all strings of edits."""
    rnd = random.Random(2)
    for _ in range(60):
        rows = [(rnd.choice(["user", "assistant", "system", "tool"]), f"t{i}", rnd.random() < 0.2, rnd.random() < 0.3) for i in range(rnd.randint(0, 3))]
        best = None
        for size in range(len(rows), len(rows) + 5):
            for audit in itertools.product("DIKR", repeat=size):
                if sum(x != "I" for x in audit) != len(rows):
                    continue
                state, cost, left, fine = "", 0, iter(rows), True
                for edit in audit:
                    if edit == "I":
                        state, cost = NEXT[state], cost + 3
                        continue
                    role, _, forced, truncated = next(left)
                    if edit == "D":
                        cost += 4
                        continue
                    to = NEXT[state] if edit == "R" else role[0]
                    if forced or state + to not in ("s", "u", "su", "ua", "au"):
                        fine = False
                        break
                    state, cost = to, cost + 3 * truncated + 3 * (edit == "R")
                if fine and state in ("", "a"):
                    best = min(best or (99, ""), (cost, "".join(audit)))
        assert best == cheapest(rows)[:2]


@pytest.mark.parametrize("fix_ups", [0, 2, 50])
def test_rows_that_never_forget_their_future(spark, fix_ups):
    """Only user turns: the costs of a chunk depend on the last one however far away it is."""
    rows = [(1, t, "user", f"Turn {t}.") for t in range(61)] + [(2, t, "assistant", f"Turn {t}.") for t in range(40)] + [(3, t, "tool", f"Turn {t}.") for t in range(41)] + [(4, None, "user", f"{t}.") for t in range(30)]
    assert found(repair(given(spark, rows), chunk_rows=4, fix_ups=fix_ups)) == by_hand(rows, keep_damage=False)


def test_one_turn_repeated_and_one_text_in_all_turns(spark):
    rows = [(1, 7, "user", "Again.")] * 5_000 + [(1, 8, "assistant", "Yes.")] + [(2, t, "user", "Same.") for t in range(3_000)] + [(3, None, "user", "Null.")] * 700
    assert found(repair(given(spark, rows))) == by_hand(rows, keep_damage=False)
    many = [(9, 1, "user", f"{t}.") for t in range(4_000)]
    assert found(repair(given(spark, many), chunk_rows=100)) == by_hand(many, keep_damage=False)


def test_empty(spark):
    assert found(repair(given(spark, []))) == [] and found(repair_damaged(given(spark, []))) == []
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    one = given(spark, [(dropped, 0, "user", "Hi.")])
    assert damaged(one).count() == 0
    assert found(repair_damaged(one)) == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_fix_up_stops_where_nothing_changes():
    rnd = random.Random(4)
    assert len(VECTORS) < 64
    for _ in range(300):
        symbols = [rnd.randrange(8) for _ in range(rnd.randint(1, 60))]
        guessed = backward(symbols, 0)
        for into in range(len(VECTORS)):
            whole = [into]
            for symbol in reversed(symbols):
                whole.insert(0, MOVES[whole[0]][symbol])
            assert backward(symbols, into, guessed) == whole


def test_other_keys(spark):
    df = given(spark, [(1, 0, "user", "Hi."), (1, 1, "assistant", "Ho.")]).withColumn("conv_id", F.lit("a-b"))
    assert [tuple(r)[:8] for r in repair(df).collect()] == [("a-b", 0, 0, 0, 0, 0, 0, "KK")]
