"""Decisions with rules that requests and operators set meanwhile: against a plain replay, on hot sources, and on streams."""

from __future__ import annotations

import random

import pytest

from oneway.operators import policy as PO
from oneway.streaming.policy import decisions, merged_stream

REQUEST = "seq long, source string, at double, threat_level double"


def replayed(requests: list[tuple], log: list[tuple]) -> dict:
    """Rule and action of each request, one event at a time."""
    rules: dict[str, tuple] = {}
    out = {}
    events = [(at, 0, seq, source, op, expires) for at, seq, source, op, expires, _ in log] + [(at, 1, seq, source, None, level) for seq, source, at, level in requests]
    for at, kind, seq, source, op, x in sorted(events, key=lambda e: e[:3]):
        rule, end = rules.get(source, (None, 0))
        if rule == "temporary" and end <= at:
            rule = rules.pop(source) and None
        if kind == 0:
            if op in ("allow", "block", "temporary"):
                rules[source] = (op, x)
            elif (op, rule) in (("disallow", "allow"), ("unblock", "block"), ("remove", "temporary")):
                del rules[source]
        elif rule:
            out[seq] = {"allow": "allowlist", "block": "blocklist"}.get(rule, rule)
        elif x is not None and 0.6 <= x < 0.9:
            rules[source] = ("temporary", at + 300)
            out[seq] = "high"
        else:
            out[seq] = "default" if x is None or x < 0.3 else "monitor" if x < 0.6 else "critical"
    return out


def traffic(seed: int, n: int) -> tuple[list[tuple], list[tuple]]:
    """Requests, half of them of one source that is hardly ever silent, and a log; many share a time."""
    rng = random.Random(seed)
    sources = ["hot"] * 4 + ["a", "b", "c", "d"]
    requests = [(i, rng.choice(sources), float(rng.randrange(9000)) + rng.choice((0, 0, 0.25)), rng.choice((None, 0.0, 0.29, 0.3, 0.6, 0.7, 0.89, 0.9, 1.0))) for i in range(n)]
    log = []
    for i in range(n // 25):
        at = float(rng.randrange(9000))
        log.append((at, i, rng.choice(sources), rng.choice([*PO.SETS, *PO.SETS.values()]), at + rng.choice((1.0, 120.0, 5000.0)), "by hand"))
    return requests, log


def test_a_high_request_blocks_what_follows(spark):
    asked = spark.createDataFrame([(1, "a", 0.0, 0.7), (2, "a", 10.0, 0.05), (3, "a", 299.9, None), (4, "a", 300.0, 0.05), (5, "b", 10.0, 0.05)], REQUEST)
    got = {r.seq: (r.action, r.rule, r.reason) for r in PO.decide(asked, spark.createDataFrame([], PO.LOG)).collect()}
    assert got[1][:2] == ("BLOCK", "high") and got[4][:2] == got[5][:2] == ("ALLOW", "default")
    assert got[2] == got[3] == ("BLOCK", "temporary", PO.AUTOMATIC_REASON)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_as_of_each_request(spark, seed):
    requests, log = traffic(seed, 1500)
    want = replayed(requests, log)
    assert len(set(want.values())) == 7
    shuffled = random.Random(seed).sample(requests, len(requests))
    frame = spark.createDataFrame(shuffled, REQUEST).repartition(3)
    got = {r.seq: r.rule for r in PO.decide(frame, spark.createDataFrame(log, PO.LOG)).collect()}
    assert got == want


def test_log_is_checked(spark):
    for row, why in (((0.0, 1, "a", "explode", None, None), "no such operation"), ((5.0, 1, "a", "temporary", 5.0, None), "must last"), ((0.0, 1, " ", "allow", None, None), "non-empty")):
        with pytest.raises(Exception, match=why):
            PO.valid_log(spark.createDataFrame([row], PO.LOG)).collect()


def test_state_of_lists(spark):
    log = [(0.0, 1, "a", "block", None, None), (1.0, 2, "a", "disallow", None, None), (2.0, 3, "b", "allow", None, None), (3.0, 4, "b", "disallow", None, None), (4.0, 5, "c", "temporary", 50.0, "x"), (9.0, 6, "d", "allow", None, None)]
    state = lambda now: {r.source: r.state for r in PO.rule_state(spark.createDataFrame(log, PO.LOG), now).collect()}
    assert state(5.0) == {"a": "block", "b": "none", "c": "temporary", "d": "none"} and state(50.0) == {"a": "block", "b": "none", "c": "none", "d": "allow"}


def test_stream_in_random_batches_and_after_a_restart(spark, tmp_path):
    requests, log = traffic(7, 400)
    want = replayed(requests, log)
    rng = random.Random(1)
    cuts = sorted(rng.sample(range(9000), 5))
    land, out = tmp_path / "in", tmp_path / "out"
    columns = "kind long, " + REQUEST + ", op string, expires double, reason string"
    for n, (lo, hi) in enumerate(zip([-1, *cuts], [*cuts, 10_000])):  # batches rise in time; rows inside a batch do not
        rows = [(1, *r, None, None, None) for r in requests if lo < r[2] <= hi] + [(0, seq, s, at, None, op, e, why) for at, seq, s, op, e, why in log if lo < at <= hi]
        rng.shuffle(rows)
        spark.createDataFrame(rows, columns).write.mode("append").parquet(str(land))
        stream = spark.readStream.schema(columns).parquet(str(land))
        rows_ = merged_stream(stream.where("kind = 1"), stream.where("kind = 0"))
        if n % 2:  # a query that starts anew goes on from the checkpoint
            decisions(rows_, 600).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(out)).awaitTermination()
    decisions(rows_, 600).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(out)).awaitTermination()
    rows = spark.read.parquet(str(out)).collect()
    assert {r.seq: r.rule for r in rows if r.seq is not None} == want
    ended = [r for r in rows if r.action == "EXPIRED"]
    assert ended and all(r.rule == "temporary" for r in ended)
