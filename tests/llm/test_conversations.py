"""Repair of conversations against an exhaustive search, in blocks and whole, and on rows with nulls, ties and clashing columns."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

from pyspark.sql import types as T

from oneway.llm.conversation_repair import applied, damage, marked, repair, repaired_messages, search
from tests.llm.cases import cluttered

ROWS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def cheapest(marks: list, most: int) -> tuple[int, str]:
    """By trial of all edit strings with at most ``most`` insertions."""
    best = None
    price = {"K": 0, "R": 2, "D": 3, "I": 2}
    for n in range(len(marks), len(marks) + most + 1):
        for edits in itertools.product("DIKR", repeat=n):
            if sum(e != "I" for e in edits) != len(marks):
                continue
            left, said, cost, ok = iter(marks), "", 0, True
            for e in edits:
                due = "u" if not said or said[-1] != "u" else "a"
                if e == "I":
                    said += due
                else:
                    initial, must, cut = next(left)
                    ok &= e == "D" or not must
                    cost += cut * (e != "D")
                    said += "" if e == "D" else initial if e == "K" else due
                cost += price[e]
            if ok and re.fullmatch("(s?(ua)+)?", said):
                best = min(best or (cost, "".join(edits)), (cost, "".join(edits)))
    return best


def test_search_finds_the_least_of_the_cheapest_edits():
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 3, 4, 4):
        for _ in range(12):
            marks = [(rng.choice("suaat "), must, not must and rng.random() < 0.4) for must in (rng.random() < 0.3 for _ in range(n))]
            assert search(marks)[:2] == cheapest(marks, 4 if n < 4 else 3), marks


def conversations() -> list[tuple]:
    rng = random.Random(9)
    rows = [(None, None, None, None), (None, 3, "user", "Hm."), (1, None, "assistant", "Yes"), (1, None, "user", ""), (1, 4, "user", "é…"), (2, 0, "system", "Be."), (3, 0, "tool", "x\n."), (3, 0, "tool", "x\n.")]
    for conv in range(10, 60):
        for turn in range(rng.randrange(1, 14)):
            rows.append((conv, turn * rng.choice((1, 1, 2)), rng.choice(["user", "assistant", "user", "assistant", "system", "", "ünknown"]), rng.choice(["Yes.", "No?", "cut off", " \t", "", "Well! ", "long " * 300 + "."])))
    return rows + [(99, 1, "user", "Same.")] * 30


def expected(rows: list[tuple]) -> dict:
    out, by = {}, {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        marks = marked(own, [r[1:] in [x[1:] for x in own[:i]] for i, r in enumerate(own)])
        cost, audit, _ = search(marks)
        turns = {r[0] for r in own if r[0] is not None}
        blank = sum(not r[2].strip(" \t\n\x0b\x0c\r") for r in own)
        text = "\n".join(f"{role}:{said}" for _, role, said in applied(own, audit))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, blank, sum(m[1] for m in marks) - blank, sum(m[2] for m in marks), sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:])), cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def test_whole_and_in_blocks(spark):
    rows = conversations()
    random.Random(1).shuffle(rows)
    table = cluttered(spark.createDataFrame(rows, ROWS), "part", "block", "at", "__k", "cost")
    want = expected(rows)
    for long_rows in (4096, 2):
        got = {r["conv_id"]: tuple(r)[1:] for r in repair(table, long_rows).collect()}
        assert got == want, long_rows
    for long_rows in (4096, 3):
        said = repaired_messages(table, long_rows).orderBy("conv_id", "position").collect()
        for conv, (*_, digest) in want.items():
            assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in said if r["conv_id"] == conv).encode()).hexdigest() == digest


def test_damage_keeps_every_conversation(spark):
    rows = [(i, 0, "user", "Yes.") for i in range(200)] + [(None, None, None, None)]
    got = repair(damage(spark.createDataFrame(rows, ROWS)))
    assert {r["conv_id"] for r in got.collect()} == {r[0] for r in rows}
    lost = got.where("audit = ''").collect()
    assert lost and all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in lost)
    assert repair(damage(spark.createDataFrame([], ROWS))).count() == 0
