"""Flood family, per destination.

Every rule reads one aggregate.  It is built in two levels, (destination, source) then destination, so the victim of a flood, which
is the hot key by nature, is reduced to one row per source before its rows meet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from oneway.operators.estimators import half_open_ratio, liveness
from oneway.operators.flows import ratio

# Services whose answers are larger than their requests, by source port.
AMPLIFIERS = {
    17: "QOTD",
    19: "chargen",
    53: "DNS",
    69: "TFTP",
    111: "Portmap",
    123: "NTP",
    137: "NetBIOS",
    161: "SNMP",
    389: "CLDAP",
    500: "ISAKMP",
    520: "RIP",
    1900: "SSDP",
    3702: "WS-Discovery",
    4500: "IPsec-NAT-T",
    5060: "SIP",
    5683: "CoAP",
    10001: "Ubiquiti",
    11211: "memcached",
    27015: "SrcDS",
    37810: "DVR/IoT",
}
WEB_PORTS = (80, 443, 8080, 8443)


def clip1(x: Column) -> Column:
    return F.least(F.lit(1.0), x)


def service() -> Column:
    out = F.lit(None).cast("string")
    for port, name in AMPLIFIERS.items():
        out = F.when(F.col("src_port") == port, name).otherwise(out)
    return out


def destinations(flows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per destination (of each value of ``by``) with all that the rules need.  ``flows`` may carry hz and r2; without them there is no clock."""
    for name, default in (("hz", F.lit(None).cast("double")), ("r2", F.lit(0.0))):
        if name not in flows.columns:
            flows = flows.withColumn(name, default)
    tcp, udp = F.col("proto") == "TCP", F.col("proto") == "UDP"
    syn_flow = tcp & (F.col("syn") + F.col("synack") > 0)
    amp = udp & F.col("src_port").isin(*AMPLIFIERS)
    slow = tcp & F.col("dst_port").isin(*WEB_PORTS) & (F.col("duration") > 8) & (F.col("byte_rate") < 40) & ((F.col("http_partial_count") > 0) | ((F.col("packets") > 3) & (F.col("mean_size") < 80)))
    flows = flows.withColumns({"half_open": half_open_ratio(), "liveness": liveness()})
    total = lambda c, on=None: F.sum(F.when(on, F.col(c)) if on is not None else F.col(c))
    by_source = flows.groupBy(*by, "dst_ip", "src_ip").agg(
        F.min("start_ts").alias("first"), F.max("last_ts").alias("last"), F.count("*").alias("n"), F.min_by("flow_key", "flow_seq").alias("key"), F.min("flow_seq").alias("seq"),
        F.count_if(syn_flow).alias("syn_flows"), total("syn", syn_flow).alias("syn"), total("half_open", syn_flow).alias("half_open"), total("liveness", syn_flow).alias("live"),
        total("synack", tcp).alias("synack"), F.count_if(udp).alias("udp_flows"), total("packets", udp).alias("udp_packets"), total("bytes", udp).alias("udp_bytes"),
        total("packets", amp).alias("amp_packets"), total("bytes", amp).alias("amp_bytes"), F.max(amp.cast("int")).alias("reflects"),
        F.count_if(slow).alias("slow"), total("duration", slow).alias("slow_s"), total("byte_rate", slow).alias("slow_rate"), F.count_if(slow & (F.col("http_partial_count") > 0)).alias("partial"),
    )
    n_all = F.sum("n").alias("flows")
    entropy_parts = F.sum(F.col("n") * F.log2("n")).alias("n_log_n")
    rows = by_source.groupBy(*by, "dst_ip").agg(
        F.greatest(F.lit(0.5), F.max("last") - F.min("first")).alias("w"), F.count("*").alias("sources"), n_all, entropy_parts, F.min_by("key", "seq").alias("flow_key"), F.min("seq").alias("flow_seq"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("syn_flows", "syn", "half_open", "live", "synack", "udp_flows", "udp_packets", "udp_bytes", "amp_packets", "amp_bytes", "reflects", "slow", "slow_s", "slow_rate", "partial")),
    )
    # -sum p log p over sources of n flows each is log N - sum(n log n) / N
    raw = F.log2("flows") - F.col("n_log_n") / F.col("flows")
    entropy = F.when(F.col("sources") > 1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw / F.log2("sources")))).otherwise(0.0)
    return rows.withColumns({"entropy": entropy, "mean_half_open": ratio("half_open", "syn_flows"), "mean_live": ratio("live", "syn_flows")})


def top_amplifier(flows: DataFrame) -> DataFrame:
    """Per destination the commonest amplifier port of its flows, ties to the one seen first."""
    ports = flows.where((F.col("proto") == "UDP") & F.col("src_port").isin(*AMPLIFIERS)).groupBy("dst_ip", "src_port").agg(F.count("*").alias("n"), F.min("flow_seq").alias("seq"))
    first = F.row_number().over(W.partitionBy("dst_ip").orderBy(F.desc("n"), "seq"))
    return ports.withColumn("__r", first).where("__r = 1").select("dst_ip", service().alias("amplifier"))


def _found(threat: str, fires: Column, score: Column, confidence: Column, evidence: dict[str, Column]) -> Column:
    pairs = F.map_from_arrays(F.array(*(F.lit(k) for k in evidence)), F.array(*(v.cast("double") for v in evidence.values())))
    row = F.struct(F.lit(threat).alias("threat"), F.round(score, 4).alias("score"), F.round(confidence, 4).alias("confidence"), pairs.alias("evidence"))
    return F.when(fires, row)


def syn_flood(rate: float = 40.0) -> Column:
    hz = F.col("syn") / F.col("w")
    drive = 0.4 * clip1(hz / rate) + 0.25 * F.col("mean_half_open") + 0.2 * F.col("entropy") + 0.15 * (1 - F.col("mean_live"))
    fires = (F.col("syn") > 0) & (hz >= rate) & (F.col("mean_half_open") > 0.6)
    return _found("syn_flood", fires, clip1(drive), clip1(drive) * (0.7 + 0.3 * (1 - F.col("mean_live"))), {"syn_rate_hz": F.round(hz, 1), "unique_sources": F.col("sources"), "src_ip_entropy": F.round("entropy", 3), "half_open_ratio": F.round("mean_half_open", 3), "mean_liveness": F.round("mean_live", 3)})


def synack_reflection(rate: float = 40.0) -> Column:
    hz = F.col("synack") / F.col("w")
    drive = 0.5 * clip1(hz / (4 * rate)) + 0.5 * F.col("entropy")
    fires = (F.col("synack") > 0) & (hz >= rate) & (F.col("sources") >= 20) & (F.col("synack") > F.col("syn"))
    return _found("reflection_amplification", fires, clip1(F.greatest(F.lit(0.6), drive)), clip1(F.greatest(F.lit(0.55), 0.9 * drive)), {"synack_rate_hz": F.round(hz, 1), "reflector_sources": F.col("sources"), "src_ip_entropy": F.round("entropy", 3)})


def _amplifies() -> tuple[Column, Column]:
    bps = F.col("udp_bytes") / F.col("w")
    fires = (F.col("udp_flows") > 0) & (ratio("amp_packets", "udp_packets") > 0.5) & (ratio("amp_bytes", "amp_packets") > 180) & (bps >= 100_000) & (F.col("reflects") >= 10)
    return fires, bps


def udp_amplification(pps: float = 500.0) -> Column:
    fires, bps = _amplifies()
    drive = clip1(bps / (300 * pps))
    return _found("reflection_amplification", fires, F.greatest(F.lit(0.6), drive), F.greatest(F.lit(0.55), 0.9 * drive), {"byte_rate_bps": F.floor(bps), "reflector_sources": F.col("reflects"), "mean_response_size": F.round(ratio("amp_bytes", "amp_packets"), 1)})


def udp_flood(pps: float = 500.0) -> Column:
    """Only where amplification does not fire."""
    amplifies, _ = _amplifies()
    rate = F.col("udp_packets") / F.col("w")
    drive = 0.6 * clip1(rate / pps / 2) + 0.4 * F.col("entropy")
    return _found("udp_flood", (F.col("udp_flows") > 0) & ~amplifies & (rate >= pps), clip1(drive), 0.85 * clip1(drive), {"pps": F.round(rate, 1), "unique_sources": F.col("sources"), "src_ip_entropy": F.round("entropy", 3)})


def slowloris(connections: int = 20) -> Column:
    mean = ratio("slow_s", "slow")
    drive = 0.6 * clip1(F.col("slow") / (2.0 * connections)) + 0.4 * clip1(mean / 60)
    return _found("slowloris", F.col("slow") >= connections, clip1(drive), 0.9 * clip1(drive), {"concurrent_slow_conns": F.col("slow"), "mean_duration_s": F.round(mean, 1), "mean_byte_rate_bps": F.round(ratio("slow_rate", "slow"), 1), "partial_http_flows": F.col("partial")})


RULES = (syn_flood, synack_reflection, udp_amplification, udp_flood, slowloris)


def flood_findings(flows: DataFrame, rules=RULES, by: Sequence[str] = ()) -> DataFrame:
    """One row per destination and rule that fires, in rule order."""
    found = F.array(*(F.struct(F.lit(i).alias("ordinal"), rule().alias("r")) for i, rule in enumerate(rules)))
    rows = destinations(flows, by).select(*by, "dst_ip", "flow_key", "flow_seq", F.explode(found).alias("f")).where("f.r is not null")
    return rows.select(*by, "dst_ip", "flow_key", "flow_seq", F.col("f.ordinal").alias("ordinal"), "f.r.*")
