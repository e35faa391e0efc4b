"""Firewall policy: decisions on requests, from rules that operators set and that requests set themselves.

A source is allowed, blocked, blocked for a time, or none of these; every rule replaces the source's former one.  A request that is HIGH and
that no rule settles blocks its source for TEMPORARY_S seconds.  What operators set is carried along a source's time in buckets; what requests set
is a fold over the distinct times of such requests, cut wherever a source is silent for as long as a rule lasts, or is given or freed of a rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from oneway.operators.carry import SPAN_S, last_before
from oneway.operators.shared import written

CRITICAL, HIGH, MEDIUM, LOW = 0.9, 0.6, 0.3, 0.1
TEMPORARY_S = 300
#: Operations of a log: three set a rule, each of the others takes one kind of rule away and does nothing where there is none.
SETS = {"allow": "disallow", "block": "unblock", "temporary": "remove"}
LOG = "at double, seq long, source string, op string, expires double, reason string"
#: The reasons that decisions give.
REASONS = {
    "allowlist": "Source is on allowlist", "blocklist": "Source is permanently blocked", "critical": "Critical threat level detected",
    "high": "High threat level triggered temporary block", "default": "No firewall rule blocked the source",
}
AUTOMATIC_REASON, MONITOR_REASON = "High threat level triggered automatic temporary block", " threat level allowed with monitoring"


def classify(level: Column) -> Column:
    """Label of a threat level in 0..1; UNKNOWN for null, an error outside."""
    bad = F.raise_error(F.concat(F.lit("threat level outside 0..1: "), level.cast("string"))).cast("string")
    return (
        F.when(level.isNull(), "UNKNOWN").when((level < 0) | (level > 1) | F.isnan(level), bad)
        .when(level >= CRITICAL, "CRITICAL").when(level >= HIGH, "HIGH").when(level >= MEDIUM, "MEDIUM").when(level >= LOW, "LOW").otherwise("MINIMAL")
    )


def valid_source(source: Column) -> Column:
    """The trimmed source; an error if it is empty or null."""
    s = F.btrim(source)
    return F.when(s.isNull() | (s == ""), F.raise_error(F.lit("source must be a non-empty string")).cast("string")).otherwise(s)


def valid_log(log: DataFrame) -> DataFrame:
    """A log of operations (at, seq, source, op, expires, reason); an error for an unknown one, or for a rule that ends when it starts."""
    known = [*SETS, *SETS.values()]
    op = F.when(F.col("op").isin(known), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("no such operation: "), F.coalesce("op", F.lit("null")))).cast("string"))
    ends = F.when((F.col("op") != "temporary") | (F.col("expires") > F.col("at")), F.col("expires")).otherwise(F.raise_error(F.lit("a temporary rule must last")).cast("double"))
    return log.select(F.col("at").cast("double").alias("at"), F.col("seq").cast("long").alias("seq"), valid_source(F.col("source")).alias("source"), op.alias("op"), ends.alias("expires"), "reason")


def _bucket() -> Column:
    return F.floor(F.col("at") / SPAN_S)


def _standing(requests: DataFrame, log: DataFrame) -> DataFrame:
    """Requests with the operator's rule in force (allow, block, temporary or null), its reason, and __reset, the last time at which the
    source was given a rule or freed of a temporary one."""
    asked = requests.withColumn("__kind", F.lit(1))
    log = valid_log(log).withColumns({"__kind": F.lit(0), "__op": F.col("op"), "__expires": F.col("expires"), "__why": F.col("reason")}).drop("op", "expires", "reason")
    rows = asked.unionByName(log, allowMissingColumns=True)
    op, order = F.col("__op"), F.struct("at", "seq")
    values = {"__set": F.when(op.isin(*SETS), F.struct("at", "seq", op.alias("op"), F.col("__expires").alias("expires"), F.col("__why").alias("reason")))}
    values |= {f"__{name}": F.when(op == name, order) for name in SETS.values()}
    rows = last_before(rows, ["source"], F.struct("at", "__kind", "seq"), _bucket(), values).where("__kind = 1").drop("__op", "__expires", "__why")
    set_, at = F.col("__set.op"), F.struct("__set.at", "__set.seq")
    taken = F.lit(False)
    for name, away in SETS.items():
        taken = taken | F.coalesce((set_ == name) & (F.col(f"__{away}") > at), F.lit(False))
    over = (set_ == "temporary") & (F.col("__set.expires") <= F.col("at"))
    rule = F.when(~taken & ~F.coalesce(over, F.lit(False)), set_)
    reset = F.greatest(at, F.col("__remove"))  # rules that requests set are temporary, too
    return rows.withColumns({"__rule": rule, "__why": F.col("__set.reason"), "__reset": F.when(set_.isNotNull() | F.col("__remove").isNotNull(), reset)}).drop("__set", *(f"__{x}" for x in SETS.values()))


def _started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the sorted times of each run, those that start a rule: the first, and the first at or past each end."""
    own, end = None, -np.inf
    for batch in batches:
        keys = batch.column("run").dictionary_encode()
        codes, times = keys.indices.to_numpy(zero_copy_only=False), batch.column("at").to_numpy(zero_copy_only=False)
        picked = []
        cut = np.flatnonzero(np.diff(codes, prepend=codes[0] - 1)) if len(codes) else codes
        for lo, hi in zip(cut, np.append(cut[1:], len(codes))):
            key = keys.dictionary[int(codes[lo])].as_py()
            if key != own:
                own, end = key, -np.inf
            at = lo + int(np.searchsorted(times[lo:hi], end))
            while at < hi:
                picked.append(at)
                end = times[at] + TEMPORARY_S
                at = lo + int(np.searchsorted(times[lo:hi], end))
        if picked:
            yield batch.take(pa.array(picked))


def _runs(free: DataFrame) -> DataFrame:
    """The rules that requests set: source, the reset that they follow, the time they start and the seq of the request, of HIGH requests
    that no operator's rule settles."""
    times = written(free.groupBy("source", "__reset", "at").agg(F.min("seq").alias("seq")), "policy-times")
    key = ["source", "__reset"]
    times = written(last_before(times, key, F.col("at"), _bucket(), {"__prior": F.col("at")}, inclusive=False), "policy-gaps")
    begins = F.when(F.col("__prior").isNull() | (F.col("at") >= F.col("__prior") + TEMPORARY_S), F.col("at"))
    times = last_before(times, key, F.col("at"), _bucket(), {"run": begins})
    times = times.select("source", F.col("__reset.at").alias("reset_at"), F.col("__reset.seq").alias("reset_seq"), "run", "at", "seq")
    name = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("reset_at", "reset_seq", "run")), "source")
    times = times.withColumn("run", name).repartition("run").sortWithinPartitions("run", "at")
    return times.mapInArrow(_started, "source string, reset_at double, reset_seq long, run string, at double, seq long")


def _free(standing: DataFrame) -> DataFrame:
    return standing.where(F.col("__rule").isNull() & (F.col("threat_level") >= HIGH) & (F.col("threat_level") < CRITICAL))


def _asked(requests: DataFrame) -> DataFrame:
    rows = requests if "seq" in requests.columns else requests.withColumn("seq", F.lit(0).cast("long"))
    return rows.withColumns({"source": valid_source(F.col("source")), "at": F.col("at").cast("double")})


def decide(requests: DataFrame, log: DataFrame) -> DataFrame:
    """Requests (source, at, seq, threat_level) with rule, allowed, action, reason and classification, as of their time.

    ``log`` has what operators did (at, seq, source, op, expires, reason; op is allow, disallow, block, unblock, temporary or remove).  At one time the
    log goes first; seq orders the rest (requests without one have none before another).  A rule has ended at ``expires`` itself.  The
    first HIGH request that no rule settles is blocked as such and blocks its source for TEMPORARY_S seconds from then on.
    """
    rows = written(_standing(_asked(requests), log), "policy-requests")
    rules = written(_runs(_free(rows)), "policy-rules")
    # a rule's own request is the first by seq at its time; the rule holds for the requests behind it
    reset = F.when(F.col("reset_at").isNotNull(), F.struct(F.col("reset_at").alias("at"), F.col("reset_seq").alias("seq")))
    own = rules.select("source", "at", F.lit(0).alias("__kind"), F.struct("at", reset.alias("reset"), "seq").alias("__start"))
    asked = rows.unionByName(own, allowMissingColumns=True)
    order = F.struct(F.col("at"), "__kind", F.coalesce("seq", F.lit(0)))
    asked = last_before(asked, ["source"], order, _bucket(), {"__auto": F.col("__start")}).where("__kind = 1")
    auto = lambda c: F.col(f"__auto.{c}")
    running = (auto("at") + TEMPORARY_S > F.col("at")) & auto("reset").eqNullSafe(F.col("__reset")) & F.col("__rule").isNull()
    begun = (auto("at") < F.col("at")) | (F.col("seq") > auto("seq"))
    level = F.col("threat_level")
    rule = (
        F.when(F.col("__rule") == "allow", "allowlist").when(F.col("__rule") == "block", "blocklist").when((F.col("__rule") == "temporary") | (running & begun), "temporary")
        .when(level >= CRITICAL, "critical").when(level >= HIGH, "high").when(level >= MEDIUM, "monitor").otherwise("default")
    )
    asked = asked.withColumns({"rule": rule, "classification": F.when(level.isNotNull(), classify(level))})
    reason = F.when(F.col("rule") == "temporary", F.when(F.col("__rule") == "temporary", F.col("__why")).otherwise(F.lit(AUTOMATIC_REASON))).when(F.col("rule") == "monitor", F.concat("classification", F.lit(MONITOR_REASON)))
    for name, text in REASONS.items():
        reason = reason.when(F.col("rule") == name, text)
    action = F.when(F.col("rule").isin("blocklist", "temporary", "critical", "high"), "BLOCK").when(F.col("rule") == "monitor", "ALLOW_MONITOR").otherwise("ALLOW")
    return asked.withColumns({"action": action, "allowed": action != "BLOCK", "reason": reason}).drop("__rule", "__why", "__reset", "__start", "__auto", "__kind")


def lists_as_log(allow: DataFrame, block: DataFrame, temporary: DataFrame) -> DataFrame:
    """Lists that hold from the beginning, and rules with a start, as a log.  A source on both lists is allowed; rules of listed ones are left
    out."""
    start, none = F.lit(float("-inf")), F.lit(None)
    listed = block.select("source", F.lit("block").alias("op"), F.lit(0).alias("seq")).unionByName(allow.select("source", F.lit("allow").alias("op"), F.lit(1).alias("seq"))).distinct()
    rules = temporary.join(listed.select("source").distinct(), "source", "left_anti")
    log = listed.select(start.alias("at"), F.col("seq").cast("long").alias("seq"), "source", "op", none.cast("double").alias("expires"), none.cast("string").alias("reason"))
    return log.unionByName(rules.select(F.col("starts").cast("double").alias("at"), F.lit(2).cast("long").alias("seq"), "source", F.lit("temporary").alias("op"), F.col("expires").cast("double").alias("expires"), "reason"))


def evaluate(requests: DataFrame, allow: DataFrame, block: DataFrame, temporary: DataFrame) -> DataFrame:
    """Decisions where the lists of sources ``allow`` and ``block`` hold throughout; ``temporary`` has source, starts, expires and reason."""
    return decide(requests, lists_as_log(allow, block, temporary))


def automatic_rules(requests: DataFrame, log: DataFrame) -> DataFrame:
    """The temporary rules that requests set, as source, starts, expires, reason."""
    rows = _standing(_asked(requests), log)
    return _runs(_free(rows)).select("source", F.col("at").alias("starts"), (F.col("at") + TEMPORARY_S).alias("expires"), F.lit(AUTOMATIC_REASON).alias("reason"))


def rule_state(log: DataFrame, now: float) -> DataFrame:
    """The rule that each source of a log has at a time: allow, block, temporary, or none."""
    sources = log.select(valid_source(F.col("source")).alias("source")).distinct()
    asked = sources.select("source", F.lit(float(now)).alias("at"), F.lit(0).cast("long").alias("seq"), F.lit(None).cast("double").alias("threat_level"))
    log = log.where(F.col("at") <= now)
    rows = _standing(asked, log)
    return rows.select("source", F.coalesce("__rule", F.lit("none")).alias("state"))


def upsert(table: DataFrame, changes: DataFrame, key: str = "source", order: str = "seq") -> DataFrame:
    """The table after changes: for each key its latest change, or the row it had."""
    columns = [c for c in changes.columns if c != order]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("__last")).select("__last.*")
    return table.join(last.select(key), key, "left_anti").unionByName(last, allowMissingColumns=True)


def decision_summary(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("action").agg(F.count("*").alias("requests"), F.count_if("allowed").alias("allowed"))


def last_events(decisions: DataFrame, n: int, order: str = "at") -> DataFrame:
    return decisions.orderBy(F.desc(order)).limit(n)
