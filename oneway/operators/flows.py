"""Packets to one-directional flows.

A flow is one 5-tuple.  First and last follow arrival order (frame_no), not the clock.  Counters, sums and min_by/max_by aggregate
map-side; ordered lists are separate builders, so plans that do not need them never carry them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from oneway.schema import ACK, FIN, FLOW_KEY, PSH, RST, SYN

MOD32, HALF32 = 1 << 32, 1 << 31


def flow_key() -> Column:
    """src:sport->dst:dport/proto"""
    return F.concat("src_ip", F.lit(":"), F.col("src_port").cast("string"), F.lit("->"), "dst_ip", F.lit(":"), F.col("dst_port").cast("string"), F.lit("/"), "proto")


def has(flags: int) -> Column:
    return (F.col("proto") == "TCP") & (F.coalesce("tcp_flags", F.lit(0)).bitwiseAND(flags) == flags)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, 0 where undefined."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def counters() -> list[Column]:
    """The aggregates of a flow that need no lists."""
    synack = has(SYN | ACK)
    return [
        F.min("frame_no").alias("flow_seq"), F.min_by("ts", "frame_no").alias("start_ts"), F.max_by("ts", "frame_no").alias("last_ts"),
        F.count("*").alias("packets"), F.sum(F.col("length").cast("long")).alias("bytes"),
        F.count_if(has(SYN) & ~synack).alias("syn"), F.count_if(synack).alias("synack"), F.count_if(has(FIN)).alias("fin"),
        F.count_if(has(RST)).alias("rst"), F.count_if(has(ACK)).alias("ack"), F.count_if(has(PSH)).alias("psh"),
        F.count_if(F.coalesce("http_partial", F.lit(False))).alias("http_partial_count"),
        F.count("tcp_tsval").alias("tsval_samples"), F.count_if((F.col("tcp_tsecr").isNotNull()) & (F.col("tcp_tsecr") != 0)).alias("tsecr_samples"),
        F.count_if((F.col("proto") == "TCP") & has(ACK) & F.col("tcp_ack").isNotNull()).alias("ack_samples"),
    ]


def derived(flows: DataFrame) -> DataFrame:
    """Duration, byte rate and mean packet size; 0 where undefined."""
    span = F.greatest(F.col("last_ts") - F.col("start_ts"), F.lit(0.0))
    flows = flows.withColumn("duration", span)
    return flows.withColumns({"byte_rate": ratio("bytes", F.when(F.col("duration") > 0, F.col("duration"))), "mean_size": ratio("bytes", "packets"), "flow_key": flow_key()})


def flows(packets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Flows; those of different values in ``by`` (a window, a sensor) are different flows."""
    return derived(packets.groupBy(*by, *FLOW_KEY).agg(*counters()))


def ordered(value: Column, order: str = "frame_no") -> Column:
    """An aggregate: the non-null values in arrival order."""
    pairs = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(F.col(order).alias("o"), value.alias("v")))))
    return F.transform(pairs, lambda x: x["v"])


def arrival_lists(packets: DataFrame) -> DataFrame:
    """Arrival times and sizes per flow, in arrival order."""
    return packets.groupBy(*FLOW_KEY).agg(ordered(F.col("ts")).alias("arrivals"), ordered(F.col("length")).alias("sizes"))


def tsval_lists(packets: DataFrame) -> DataFrame:
    """(ts, tsval) and (ts, tsecr) samples per TCP flow; a tsecr of 0 is none."""
    tcp = packets.where("proto = 'TCP'")
    val = F.when(F.col("tcp_tsval").isNotNull(), F.struct("ts", F.col("tcp_tsval").alias("val")))
    ecr = F.when(F.col("tcp_tsecr").isNotNull() & (F.col("tcp_tsecr") != 0), F.struct("ts", F.col("tcp_tsecr").alias("val")))
    return tcp.groupBy(*FLOW_KEY).agg(ordered(val).alias("tsvals"), ordered(ecr).alias("tsecrs"))


def dns_questions(packets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per question, kept exploded, with the columns of ``by``; an absent type means A."""
    asked = packets.where("dns_qname is not null and dns_qname <> ''")
    return asked.select(*by, "frame_no", "ts", "src_ip", "dst_ip", F.col("dns_qname").alias("qname"), F.coalesce("dns_qtype", F.lit("A")).alias("qtype"), flow_key().alias("flow_key"))


def ack_progress(packets: DataFrame) -> DataFrame:
    """ack_first, ack_last, ack_wraps, ack_total and ack_samples per TCP flow.

    A later ACK counts if it lies less than 2**31 ahead modulo 2**32; the accepted steps add up to the bytes acknowledged.  The
    fold keeps only the last accepted value, the total and the count, so the array is the one thing that grows with a flow.
    """
    lists = packets.where(_acknowledges()).groupBy(*FLOW_KEY).agg(ordered(F.col("tcp_ack")).alias("acks"))
    return folded_acks(lists).drop("acks")


def _acknowledges() -> Column:
    return has(ACK) & F.col("tcp_ack").isNotNull()


def folded_acks(lists: DataFrame) -> DataFrame:
    """Adds what a flow's ordered acks add up to."""
    start = F.struct(F.element_at("acks", 1).alias("last"), F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("wraps"))

    def step(s: Column, a: Column) -> Column:
        ahead = F.pmod(a - s["last"], F.lit(MOD32))
        ok = (ahead > 0) & (ahead < HALF32)
        return F.struct(F.when(ok, a).otherwise(s["last"]).alias("last"), (s["total"] + F.when(ok, ahead).otherwise(F.lit(0))).alias("total"), (s["wraps"] + F.when(ok & (a < s["last"]), 1).otherwise(0)).alias("wraps"))

    folded = lists.withColumn("s", F.when(F.size("acks") > 0, F.aggregate("acks", start, step)))
    return folded.withColumns({"ack_first": F.try_element_at("acks", F.lit(1)), "ack_last": F.col("s.last"), "ack_wraps": F.col("s.wraps"), "ack_total": F.col("s.total"), "ack_samples": F.size("acks").cast("long")}).drop("s")


def flows_with_samples(packets: DataFrame) -> DataFrame:
    """Flows with their ordered acks and (ts, tsval) samples, from one aggregation."""
    val = F.when((F.col("proto") == "TCP") & F.col("tcp_tsval").isNotNull(), F.struct("ts", F.col("tcp_tsval").alias("val")))
    return derived(packets.groupBy(*FLOW_KEY).agg(*counters(), ordered(F.when(_acknowledges(), F.col("tcp_ack"))).alias("acks"), ordered(val).alias("tsvals")))


def ack_progress_monotone(packets: DataFrame) -> DataFrame:
    """The same totals for trains without stale ACKs, by a window instead of a list: any length, bounded memory."""
    acks = packets.where(has(ACK) & F.col("tcp_ack").isNotNull())
    w = W.partitionBy(*FLOW_KEY).orderBy("frame_no")
    steps = acks.withColumn("step", F.pmod(F.col("tcp_ack") - F.lag("tcp_ack").over(w), F.lit(MOD32)))
    return steps.groupBy(*FLOW_KEY).agg(F.coalesce(F.sum("step"), F.lit(0)).alias("ack_total"), F.count("*").alias("ack_samples"))
