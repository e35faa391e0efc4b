"""Firewall policy on streams: each source's rule is state, and a timer takes temporary rules away when they end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from oneway.operators.policy import AUTOMATIC_REASON, CRITICAL, HIGH, MEDIUM, MONITOR_REASON, REASONS, SETS, TEMPORARY_S, classify, valid_log, valid_source

#: A decision, or (with the action EXPIRED and no seq) the end of a temporary rule.
DECISION = "source string, at double, seq long, rule string, action string, allowed boolean, reason string"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in DECISION.split(", ")]).astype({"seq": "Int64"})


def merged_stream(requests: DataFrame, log: DataFrame) -> DataFrame:
    """Requests and a log of operations as one stream of rows for ``decisions``."""
    level = F.col("threat_level").cast("double")
    asked = requests.select(valid_source(F.col("source")).alias("source"), F.col("at").cast("double").alias("at"), F.lit(1).alias("kind"), F.col("seq").cast("long").alias("seq"), level.alias("level"), F.when(level.isNotNull(), classify(level)).alias("name"))
    done = valid_log(log).select("source", "at", F.lit(0).alias("kind"), "seq", "op", "expires", "reason")
    return asked.unionByName(done, allowMissingColumns=True)


class Rules(StatefulProcessor):
    """One rule per source: its kind, when it ends, and why it was set."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("rule", "kind string, until double, reason string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["at", "kind", "seq"])
        kind, until, why = self.state.get() if self.state.exists() else ("none", 0.0, "")
        out = []
        for r in frame.itertuples():
            if kind == "temporary" and until <= r.at:  # its timer is due later, with the watermark
                out.append((key[0], until, None, "temporary", "EXPIRED", True, why))
                kind = "none"
            if r.kind == 0:
                if r.op in SETS:
                    kind, until, why = r.op, r.expires, r.reason or ""
                elif SETS.get(kind) == r.op:
                    kind = "none"
                continue
            rule = {"allow": "allowlist", "block": "blocklist", "temporary": "temporary"}.get(kind)
            rule = rule or ("critical" if r.level >= CRITICAL else "high" if r.level >= HIGH else "monitor" if r.level >= MEDIUM else "default")
            reason = why if rule == "temporary" else r.name + MONITOR_REASON if rule == "monitor" else REASONS[rule]
            if rule == "high":
                kind, until, why = "temporary", r.at + TEMPORARY_S, AUTOMATIC_REASON
            action = "ALLOW_MONITOR" if rule == "monitor" else "ALLOW" if rule in ("allowlist", "default") else "BLOCK"
            out.append((key[0], r.at, r.seq, rule, action, action != "BLOCK", reason))
        if kind == "none":
            self.state.clear()
        else:
            self.state.update((kind, float(until) if kind == "temporary" else 0.0, why))
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        if kind == "temporary":
            self.handle.registerTimer(int(until * 1000))
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kind, until, why = self.state.get() if self.state.exists() else ("none", 0.0, "")
        if kind == "temporary":
            self.state.clear()
            yield _frame([(key[0], until, None, "temporary", "EXPIRED", True, why)])

    def close(self) -> None:
        pass


def decisions(rows: DataFrame, late_s: int = 60) -> DataFrame:
    """Decisions on a stream of requests and operations (``merged_stream``), in the order of their times inside a batch; a source's rule lives in
    the state store (RocksDB), so a restart goes on with it.  Rows later than ``late_s`` are dropped."""
    timed = rows.withColumn("event_time", F.timestamp_micros((F.col("at") * 1_000_000).cast("long"))).withWatermark("event_time", f"{late_s} seconds")
    return timed.groupBy("source").transformWithStateInPandas(Rules(), DECISION, "append", "EventTime")
