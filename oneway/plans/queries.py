"""All registered queries of the traffic engine, named by operator, over whole tables; and their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oneway.functions.canonical import number
from oneway.functions.lexical import model_label, ngram_buckets, second_level, subdomain
from oneway.operators import alerts as AL
from oneway.operators import beacon as BE
from oneway.operators import conformal as CO
from oneway.operators import dga as DG
from oneway.operators import estimators as ES
from oneway.operators import floods as FL
from oneway.operators import flows as FW
from oneway.operators import incidents as IN
from oneway.operators import ledger as LE
from oneway.operators import metrics as ME
from oneway.operators import policy as PO
from oneway.operators import profile as PR
from oneway.operators import tunnel as TU
from oneway.operators.shared import written
from oneway.plans import oracle as O
from oneway.plans.adapters import adapter, duck
from oneway.schema import FLOW_KEY
from oneway.sources import tables as TB
from oneway.streaming.windows import first_alerts, unaligned_windows, windowed_flows

SIGNING_KEY = b"sensor-signing-key"
#: Packets in a capture file of the round trip, about.
CAPTURE_PACKETS = 50_000
Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query, and its SQL if it has one."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        _queries[key] = f
        if sql is not None:
            _oracles[key] = sql
        return f

    return add


def r(column: Column | str, digits: int = 6, name: str | None = None) -> Column:
    out = F.round(column, digits)
    return out.alias(name or column) if name or isinstance(column, str) else out


# --- flows ---------------------------------------------------------------------------------------------------------------

_EV, _LI, _FL = duck("pkt_events"), duck("pkt_lineitem"), duck("pkt_flood")


@query(f"SELECT {O.KEY}, flow_key, flow_seq, start_ts, last_ts, packets, bytes, round(duration, 6) AS duration, round(byte_rate, 6) AS byte_rate, round(mean_size, 6) AS mean_size FROM ({O.flows(_EV)})")
def F1_flows(spark, d):
    return FW.flows(adapter(spark, d, "pkt_events")).select(*FLOW_KEY, "flow_key", "flow_seq", "start_ts", "last_ts", "packets", "bytes", r("duration"), r("byte_rate"), r("mean_size"))


@query(f"SELECT {O.KEY}, packets, bytes, flow_seq, start_ts, last_ts FROM ({O.flows(_LI)})")
def F3_first_last(spark, d):
    return FW.flows(adapter(spark, d, "pkt_lineitem")).select(*FLOW_KEY, "packets", "bytes", "flow_seq", "start_ts", "last_ts")


@query(f"SELECT {O.KEY}, syn, synack, fin, rst, ack, psh, http_partial_count FROM ({O.flows(_EV)})")
def F4_flags(spark, d):
    return FW.flows(adapter(spark, d, "pkt_events")).select(*FLOW_KEY, "syn", "synack", "fin", "rst", "ack", "psh", "http_partial_count")


@query(f"SELECT {O.KEY}, string_agg(length::VARCHAR, ',' ORDER BY frame_no) AS sizes, count(*) AS n FROM ({_EV}) p GROUP BY ALL")
def F5_arrival_lists(spark, d):
    rows = FW.arrival_lists(adapter(spark, d, "pkt_events"))
    return rows.select(*FLOW_KEY, F.array_join(F.transform("sizes", lambda x: x.cast("string")), ",").alias("sizes"), F.size("arrivals").cast("long").alias("n"))


@query(f"SELECT {O.KEY}, string_agg(tcp_tsval::VARCHAR, ',' ORDER BY frame_no) AS tsvals, count(*) FILTER (tcp_tsecr <> 0) AS tsecrs FROM ({_LI}) p WHERE proto = 'TCP' GROUP BY ALL")
def F6_timestamp_samples(spark, d):
    rows = FW.tsval_lists(adapter(spark, d, "pkt_lineitem"))
    return rows.select(*FLOW_KEY, F.array_join(F.transform("tsvals", lambda x: x["val"].cast("string")), ",").alias("tsvals"), F.size("tsecrs").cast("long").alias("tsecrs"))


@query(f"SELECT * FROM ({O.ACKS.format(_LI)})")
def F7_ack_fold(spark, d):
    return FW.ack_progress(adapter(spark, d, "pkt_lineitem")).withColumn("ack_wraps", F.col("ack_wraps").cast("long"))


@query(f"SELECT qname, coalesce(dns_qtype, 'A') AS qtype, count(*) AS n, min(frame_no) AS first FROM (SELECT *, dns_qname AS qname FROM ({_EV}) p WHERE dns_qname <> '') GROUP BY ALL")
def F9_dns_questions(spark, d):
    return FW.dns_questions(adapter(spark, d, "pkt_events")).groupBy("qname", "qtype").agg(F.count("*").alias("n"), F.min("frame_no").alias("first"))


# --- half-flow estimators --------------------------------------------------------------------------------------------------


@query(f"SELECT {O.KEY}, {O.ROLE} AS role FROM ({O.flows(_EV)})")
def H1_roles(spark, d):
    return FW.flows(adapter(spark, d, "pkt_events")).select(*FLOW_KEY, ES.role().alias("role"))


@query(f"SELECT {O.KEY}, round(hz, 3) AS hz, round(r2, 5) AS r2 FROM ({O.CLOCK.format(_LI)})")
def H2_ts_clock(spark, d):
    rows = FW.tsval_lists(adapter(spark, d, "pkt_lineitem")).withColumn("c", ES.clock("tsvals"))
    return rows.select(*FLOW_KEY, r("c.hz", 3, "hz"), r("c.r2", 5, "r2"))


@query(f"""SELECT {O.KEY}, CASE WHEN n >= 3 AND gaps[floor(len(gaps) * 0.1)::INTEGER + 1] <= 3 THEN round(gaps[floor(len(gaps) * 0.1)::INTEGER + 1] * 1000, 2) END AS rtt_ms FROM (
  SELECT {O.KEY}, count(*) AS n, list_sort(list(gap) FILTER (gap > 0)) AS gaps FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY {O.KEY} ORDER BY frame_no) AS gap FROM ({_EV}) p) GROUP BY ALL)""")
def H5_passive_rtt(spark, d):
    return FW.arrival_lists(adapter(spark, d, "pkt_events")).select(*FLOW_KEY, ES.passive_rtt("arrivals", F.lit(1)).alias("rtt_ms"))


@query(f"SELECT {O.KEY}, round({O.HALF_OPEN}, 6) AS half_open, round({O.LIVE_NO_CLOCK}, 6) AS liveness FROM ({O.flows(_EV)})")
def H6_half_open(spark, d):
    rows = FW.flows(adapter(spark, d, "pkt_events")).withColumns({"hz": F.lit(None).cast("double"), "r2": F.lit(0.0)})
    return rows.select(*FLOW_KEY, r(ES.half_open_ratio(), 6, "half_open"), r(ES.liveness(), 6, "liveness"))


@query(f"""SELECT {O.KEY}, role, round(m * bytes, 4) AS reverse_bytes, round(bytes * greatest(0.0, m - d), 4) AS reverse_low, round(m * bytes + d * bytes, 4) AS reverse_high,
  round(CASE WHEN proto = 'TCP' AND role = 'client' AND bytes > 0 THEN (1 - least(1.0, ack / packets)) * m / d ELSE 0.0 END, 6) AS asym_z
  FROM (SELECT *, {O.ROLE} AS role FROM ({O.flows(_EV)})) f LEFT JOIN {O.PRIORS} ON p = proto AND s = role""")
def H8_return_prior(spark, d):
    rows = FW.flows(adapter(spark, d, "pkt_events")).withColumns({"ack_samples": F.lit(0), "ack_total": F.lit(0)})
    return ES.return_estimate(rows).select(*FLOW_KEY, "role", r("reverse_bytes", 4), r("reverse_low", 4), r("reverse_high", 4), r("asym_z"))


@query(f"""SELECT {O.KEY}, role, round(CASE WHEN hz IS NOT NULL AND r2 > 0.9 THEN 0.9 + 0.1 * least(1.0, r2) WHEN tsval_samples > 0 THEN 0.5 * r2 WHEN syn + synack > 0 THEN 0.25 ELSE 0.6 END, 5) AS liveness,
  ack_samples >= 2 AND ack_total > 0 AS by_acks, round(CASE WHEN ack_samples >= 2 AND ack_total > 0 THEN ack_total ELSE m * bytes END, 3) AS reverse_bytes,
  round(CASE WHEN ack_samples >= 2 AND ack_total > 0 THEN ack_total * (1 - greatest(0.02, 1 / sqrt(ack_samples))) ELSE bytes * greatest(0.0, m - d) END, 3) AS reverse_low
  FROM (SELECT f.* EXCLUDE (ack_samples), {O.ROLE} AS role, coalesce(a.ack_samples, 0) AS ack_samples, coalesce(a.ack_total, 0) AS ack_total, c.hz, coalesce(c.r2, 0.0) AS r2 FROM ({O.flows(_LI)}) f
    LEFT JOIN ({O.ACKS.format(_LI)}) a USING ({O.KEY}) LEFT JOIN ({O.CLOCK.format(_LI)}) c USING ({O.KEY})) x LEFT JOIN {O.PRIORS} ON p = proto AND s = role""")
def H10_estimate(spark, d):
    return ES.estimate(adapter(spark, d, "pkt_lineitem")).select(*FLOW_KEY, "role", r("liveness", 5), "by_acks", r("reverse_bytes", 3), r("reverse_low", 3))


@query(f"SELECT {O.KEY}, CASE WHEN ack_samples >= 2 AND ack_total > 0 THEN ack_total::DOUBLE END AS reverse_bytes FROM ({O.ACKS.format(_LI)})")
def H7_reverse_bytes(spark, d):
    """The form for trains without stale ACKs, whose memory does not grow with a flow."""
    rows = FW.ack_progress_monotone(adapter(spark, d, "pkt_lineitem"))
    return rows.select(*FLOW_KEY, F.when((F.col("ack_samples") >= 2) & (F.col("ack_total") > 0), F.col("ack_total").cast("double")).alias("reverse_bytes"))


@query(f"""SELECT flow_key, round({O.HALF_OPEN}, 4) AS half_open, round(CASE WHEN proto <> 'TCP' THEN 0.6 WHEN hz IS NOT NULL AND r2 > 0.9 THEN 0.9 + 0.1 * least(1.0, r2) WHEN tsval_samples > 0 THEN 0.5 * r2 WHEN syn + synack > 0 THEN 0.25 ELSE 0.6 END, 4) AS liveness,
  round(r2, 4) AS r2, round(hz, 3) AS hz, round(byte_rate, 3) AS byte_rate FROM (SELECT f.*, c.hz, coalesce(c.r2, 0.0) AS r2 FROM ({O.flows(_LI)}) f LEFT JOIN ({O.CLOCK.format(_LI)}) c USING ({O.KEY}))""")
def H11_feature_map(spark, d):
    return ES.feature_map(ES.estimate(adapter(spark, d, "pkt_lineitem"))).select("flow_key", *(f"features.{c}" for c in ("half_open", "liveness", "r2", "hz", "byte_rate")))


# --- detectors ---------------------------------------------------------------------------------------------------------------


@query(f"SELECT dst_ip, sources, round(w, 6) AS w, round(entropy, 6) AS entropy, syn, synack, udp_packets, slow FROM (SELECT * REPLACE (syn::BIGINT AS syn, synack::BIGINT AS synack, udp_packets::BIGINT AS udp_packets) FROM ({O.destinations(_FL)}))")
def D1_destinations(spark, d):
    rows = FL.destinations(FW.flows(adapter(spark, d, "pkt_flood")))
    return rows.select("dst_ip", "sources", r("w"), r("entropy"), "syn", "synack", "udp_packets", "slow")


@query(f"SELECT dst_ip, round(entropy, 6) AS entropy FROM ({O.ENTROPY.format(O.flows(_EV))})")
def D2_source_entropy(spark, d):
    return FL.destinations(FW.flows(adapter(spark, d, "pkt_events"))).select("dst_ip", r("entropy"))


def _flood(name: str, rule) -> None:
    def run(spark, d, rule=rule):
        ordinal = FL.RULES.index(rule)
        rows = FL.flood_findings(FW.flows(adapter(spark, d, "pkt_flood")), (rule,))
        return rows.select("dst_ip", "flow_key", "flow_seq", F.lit(ordinal).alias("ordinal"), "threat", "score", "confidence")

    query(O.flood_rule(name, _FL), name)(run)


for _name, _rule in zip(O.FLOOD_RULES, FL.RULES):
    _flood(_name, _rule)


@query(O.floods(_FL))
def D8_floods(spark, d):
    return FL.flood_findings(FW.flows(adapter(spark, d, "pkt_flood"))).drop("evidence")


@query(f"""SELECT dst_ip, arg_max(s, n * 1000000000000 - first) AS amplifier FROM (SELECT dst_ip, src_port, count(*) AS n, min(flow_seq) AS first FROM ({O.flows(_FL)}) f WHERE proto = 'UDP' AND src_port IN ({O.PORTS}) GROUP BY ALL) x
  JOIN (VALUES {', '.join(f"({p}, '{s}')" for p, s in FL.AMPLIFIERS.items())}) v(p, s) ON p = src_port GROUP BY dst_ip""")
def D5_amplifier_service(spark, d):
    return FL.top_amplifier(FW.flows(adapter(spark, d, "pkt_flood")))


_BE = duck("pkt_beacon")


@query(f"SELECT src_ip, dst_ip, count(*) AS n FROM ({O.channels(_BE)}) GROUP BY ALL")
def D9_channels(spark, d):
    return BE.channels(FW.flows(adapter(spark, d, "pkt_beacon"))).select("src_ip", "dst_ip", "n")


@query(f"SELECT src_ip, dst_ip, round(robust_cv, 6) AS robust_cv FROM ({O.beacons(_BE)})")
def D10_robust_cv(spark, d):
    return BE.robust_cv(BE.channel_events(FW.flows(adapter(spark, d, "pkt_beacon")))).select("src_ip", "dst_ip", r("robust_cv"))


@query(f"SELECT src_ip, dst_ip, round(best_r, 6) AS best_r, round(fap, 6) AS fap FROM ({O.beacons(_BE)}) WHERE best_r > 0")
def D11_rayleigh(spark, d):
    return BE.rayleigh(BE.channel_events(FW.flows(adapter(spark, d, "pkt_beacon")))).select("src_ip", "dst_ip", r("best_r"), r("fap"))


@query(f"SELECT src_ip, dst_ip, round(size_regularity, 6) AS size_regularity FROM ({O.beacons(_BE)})")
def D12_size_regularity(spark, d):
    return BE.sizes(BE.channel_events(FW.flows(adapter(spark, d, "pkt_beacon")))).select("src_ip", "dst_ip", r("size_regularity"))


@query(f"SELECT src_ip, dst_ip, n, round(score, 5) AS score, round(fap, 5) AS fap, is_beacon FROM ({O.beacons(_BE)})")
def D13_beacon(spark, d):
    return BE.score_beacons(FW.flows(adapter(spark, d, "pkt_beacon"))).select("src_ip", "dst_ip", "n", r("score", 5), r("fap", 5), "is_beacon")


_DNS, _MIX = duck("dns"), duck("labels_mix")


@query(f"SELECT frame_no, domain, {O.SUB} AS sub FROM (SELECT *, {O.SLD} AS domain FROM ({_DNS}) q)")
def D14_domains(spark, d):
    rows = adapter(spark, d, "dns").withColumn("domain", second_level(F.col("qname")))
    return rows.select("frame_no", "domain", subdomain(F.col("qname"), F.col("domain")).alias("sub"))


@query(f"SELECT domain, queries, first, round(mean_len, 4) AS mean_len, round(mean_entropy, 4) AS mean_entropy, round(unique_ratio, 6) AS unique_ratio, round(exotic_ratio, 6) AS exotic_ratio, score, confidence, is_tunnel, uplink_bytes FROM ({O.tunnels(_DNS)})")
def D17_tunnel(spark, d):
    rows = TU.score_tunnels(adapter(spark, d, "dns"))
    return rows.select("domain", "queries", "first", r("mean_len", 4), r("mean_entropy", 4), r("unique_ratio"), r("exotic_ratio"), "score", "confidence", "is_tunnel", "uplink_bytes")


@query(f"SELECT frame_no, qname, label, label_length, entropy, digit_ratio, vowel_ratio, max_cons_run, englishness, dict_word_hits FROM ({O.features(_MIX)})")
def D20_label_features(spark, d):
    rows = DG.score_names(adapter(spark, d, "labels_mix"))
    return rows.select("frame_no", "qname", "label", *(F.col(c).cast("long").alias(c) if c in ("label_length", "max_cons_run", "dict_word_hits") else c for c in ("label_length", "entropy", "digit_ratio", "vowel_ratio", "max_cons_run", "englishness", "dict_word_hits")))


@query(f"SELECT frame_no, qname, prob, is_dga, family FROM ({O.dga(_MIX)})")
def D22_dga(spark, d):
    return DG.score_names(adapter(spark, d, "labels_mix")).select("frame_no", "qname", "prob", "is_dga", "family")


@query(O.contributions(_MIX))
def D24_contributions(spark, d):
    return DG.contribution_rows(adapter(spark, d, "labels_mix"), ["frame_no", "qname"])


@query(f"SELECT frame_no, string_split({O._TRIM}, '.')[1] AS label FROM ({_MIX}) n")
def D25_model_label(spark, d):
    return adapter(spark, d, "labels_mix").select("frame_no", model_label(F.col("qname")).alias("label"))


@query(f"""SELECT frame_no, len(g) AS grams, list_sum(list_transform(g, lambda s: list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(s, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) % 16384))::BIGINT AS total
  FROM (SELECT frame_no, flatten(list_transform([1, 2, 3, 4], lambda k: list_transform(range(1, length(l) - k + 2), lambda i: substr(l, i, k)))) AS g FROM (SELECT frame_no, string_split({O._TRIM}, '.')[1] AS l FROM ({_MIX}) n))""")
def D26_ngram_hash(spark, d):
    rows = adapter(spark, d, "labels_mix").select("frame_no", ngram_buckets(model_label(F.col("qname"))).alias("b"))
    return rows.select("frame_no", F.size("b").cast("long").alias("grams"), F.aggregate("b", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query()
def D28_ngram_net(spark, d):
    """Train on ``TRAINING_ROWS`` names (hashed ones are positives), score all."""
    names = adapter(spark, d, "labels_mix")
    rows = DG.model_inputs(names).withColumn("y", (F.col("frame_no") < 200000000).cast("int"))
    sample = rows.orderBy(F.xxhash64("frame_no")).limit(DG.TRAINING_ROWS).select("buckets", *DG.STATS, "y").toPandas()
    return DG.score_with_net(names, DG.train_net(sample))


def _fixed_net() -> DG.NgramNet:
    """A network whose weights are a formula, so that SQL can have the same."""
    j, h = np.arange(16384 + len(DG.STATS))[:, None], np.arange(2)[None, :]
    return DG.NgramNet(((j * 7 + h * 3) % 11 - 5) / 40.0, np.array([0.1, -0.2]), np.array([0.8, -0.6]), -0.1, 0.5)


_W = lambda j, h: f"((({j}) * 7 + {h * 3}) % 11 - 5) / 40.0"
_NAMED = O.features(_MIX).replace(f"{O.LABEL} AS label", f"string_split({O._TRIM}, '.')[1] AS label")
_GRAM = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(s, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) % 16384"
_STATS = ("label_length / 32", "entropy / 5", "digit_ratio", "vowel_ratio", "max_cons_run / 10", "englishness")
_HIDDEN = [f"greatest(0.0, coalesce(list_sum(list_transform(g, lambda b: {_W('b', h)})), 0) + {' + '.join(f'({x}) * {_W(16384 + i, h)}' for i, x in enumerate(_STATS))} + {b})" for h, b in ((0, 0.1), (1, -0.2))]


@query(f"""SELECT qname, label, round(p, 6) AS prob, p >= 0.5 AS is_dga FROM (SELECT qname, label, CASE WHEN label_length < 4 THEN 0.0 ELSE 1 / (1 + exp(-(0.8 * {_HIDDEN[0]} - 0.6 * {_HIDDEN[1]} - 0.1))) END AS p FROM (
  SELECT *, list_transform(flatten(list_transform([1, 2, 3, 4], lambda k: list_transform(range(1, length(label) - k + 2), lambda i: substr(label, i, k)))), lambda s: {_GRAM}) AS g FROM ({_NAMED}) f))""")
def D28_net_scores(spark, d):
    return DG.score_with_net(adapter(spark, d, "labels_mix"), _fixed_net()).withColumn("prob", F.round("prob", 6))


# --- alerts ------------------------------------------------------------------------------------------------------------------


def _questions(spark, d) -> DataFrame:
    dns = adapter(spark, d, "dns")
    single = adapter(spark, d, "labels_mix").select("frame_no", F.lit(0.0).alias("ts"), F.lit("10.9.0.2").alias("src_ip"), F.lit("192.0.2.53").alias("dst_ip"), "qname", F.lit("A").alias("qtype"))
    return dns.unionByName(single)


def _alerts(spark, d) -> DataFrame:
    packets = adapter(spark, d, "pkt_flood").unionByName(adapter(spark, d, "pkt_beacon"))
    return AL.alerts(packets, 30.0, _questions(spark, d))


_ALERT = ["branch", "detector", "threat", "severity", "confidence", "flow_key", "subject", "seq"]


@query(f"SELECT {', '.join(_ALERT)} FROM ({O.alerts()})")
def L1_alerts(spark, d):
    return _alerts(spark, d).select(_ALERT)


@query(f"SELECT domain FROM ({O.excluded()})")
def L4_excluded_domains(spark, d):
    q = _questions(spark, d)
    return AL.excluded_domains(q, TU.score_tunnels(q))


@query(f"SELECT frame_no, qname, domain FROM ({O.candidates()})")
def L5_first_labels(spark, d):
    q = _questions(spark, d)
    return AL.dga_candidates(q, TU.score_tunnels(q)).select("frame_no", "qname", "domain")


@query(f"SELECT flow_key, list_reduce(list_transform(range(least(packets, 64)), lambda i: sha256(concat(flow_key, ':', i))), lambda a, b: sha256(a || b)) AS folded, least(packets, 64) AS n FROM ({O.flows(_FL)})")
def L7_packet_hashes(spark, d):
    rows = AL.packet_hashes(FW.flows(adapter(spark, d, "pkt_flood")))
    folded = F.aggregate(F.slice("packet_hashes", 2, 64), F.element_at("packet_hashes", 1), lambda a, b: F.sha2(F.concat(a, b), 256))
    return rows.select("flow_key", folded.alias("folded"), F.size("packet_hashes").cast("long").alias("n"))


@query(f"SELECT threat, concat('*->', dst_ip) AS flow_key, flow_key AS evidence_key, seq FROM (SELECT *, flow_seq * 8 + ordinal AS seq FROM ({O.floods(_FL)}))")
def L2_victim_flow(spark, d):
    """The first flow towards the victim of each flood, as alerts carry it to the ledger."""
    return AL.alerts(adapter(spark, d, "pkt_flood")).where("branch = 1").select("threat", "flow_key", "evidence_key", "seq")


@query(f"SELECT {', '.join(_ALERT)} FROM ({O.alerts()}) ORDER BY confidence DESC, branch, seq LIMIT 25")
def L10_ranked(spark, d):
    return AL.ranked(_alerts(spark, d).select(_ALERT), 25)


# --- calibration ---------------------------------------------------------------------------------------------------------------


def _scores(spark, d, part: str) -> DataFrame:
    return adapter(spark, d, "scores").where(F.col("part") == part)


_SC = duck("scores")


@query(f"SELECT class, n, round(q, 6) AS q, round(threshold, 6) AS threshold FROM ({O.FIT})")
def C2_fit(spark, d):
    return CO.fit(_scores(spark, d, "fit")).select("class", "n", r("q"), r("threshold"))


@query(f"SELECT id, class, score / (1 + 0.5 * uncertainty) >= coalesce(threshold, 0.9) AS covered FROM ({_SC}) s LEFT JOIN ({O.FIT}) f USING (class) WHERE part = 'test'")
def C3_covered(spark, d):
    return CO.covered(_scores(spark, d, "test"), CO.fit(_scores(spark, d, "fit"))).select("id", "class", "covered")


@query(f"SELECT t.id, round((count(c.id) FILTER ({O.NONCONF.replace('score', 'c.score').replace('uncertainty', 'c.uncertainty')} >= {O.NONCONF.replace('score', 't.score').replace('uncertainty', 't.uncertainty')}) + 1) / (count(c.id) + 1), 6) AS p FROM (SELECT * FROM ({_SC}) s WHERE part = 'test') t JOIN (SELECT * FROM ({_SC}) s WHERE part = 'fit') c USING (class) GROUP BY t.id")
def C4_p_values(spark, d):
    return CO.p_values(_scores(spark, d, "test"), _scores(spark, d, "fit")).select("id", r("p"))


@query(f"SELECT class, count(*) AS tested, round(avg((score / (1 + 0.5 * uncertainty) >= coalesce(threshold, 0.9))::INTEGER), 6) AS coverage FROM ({_SC}) s LEFT JOIN ({O.FIT}) f USING (class) WHERE part = 'test' GROUP BY class")
def C5_coverage(spark, d):
    return CO.coverage(_scores(spark, d, "test"), CO.fit(_scores(spark, d, "fit"))).select("class", "tested", r("coverage"))


# --- evidence ledger -------------------------------------------------------------------------------------------------------------


def _bundle_parts(changed: Column | None = None) -> tuple:
    """Alert, flow, packet root, features and model of the alerts adapter's rows; ``changed`` stands in for the flow's key."""
    key = F.col("flow_key") if changed is None else changed
    alert = {"note": F.expr(O.NOTE.replace("chr(92)", "char(92)").replace("chr(10)", "char(10)").replace("chr(127)", "char(127)")), "flow_key": key, "confidence": number(F.col("confidence")), **{c: F.col(c) for c in ("seq", "detector", "threat")}}
    return alert, {"key": key}, F.lit(LE.NO_PACKETS), {"ts": number(F.col("ts"))}, F.lit("rules@1")


def _bundles(spark, d) -> DataFrame:
    return adapter(spark, d, "alerts").select(F.col("detector").alias("sensor_id"), "seq", "ts", LE.bundle_digest(*_bundle_parts()).alias("digest"))


@query(f"SELECT seq, {O.bundle()} AS canonical, sha256({O.bundle()}) AS digest FROM ({duck('alerts')}) a")
def E6_bundle_digests(spark, d):
    """What is hashed of each bundle, character by character."""
    return adapter(spark, d, "alerts").select("seq", LE.bundle_json(*_bundle_parts()).alias("canonical"), LE.bundle_digest(*_bundle_parts()).alias("digest"))


def _chain(spark, d) -> DataFrame:
    return LE.seal(LE.batches(_bundles(spark, d)), SIGNING_KEY)


@query(f'SELECT sensor_id, "index", len(digests) AS n, {O.merkle("digests")} AS merkle_root FROM ({O.blocks()}) b')
def E3_merkle(spark, d):
    return LE.merkle_root(LE.batches(_bundles(spark, d)), "digests", 8).select("sensor_id", "index", F.size("digests").cast("long").alias("n"), "merkle_root")


@query(f"SELECT sensor_id, block, index::INTEGER AS index, array_to_string(list_transform(steps, lambda s: s.side || substr(s.sibling, 1, 12)), ' ') AS proof, verified, wrong FROM ({O.proofs()})")
def E4_proofs(spark, d):
    """Every step of every proof, where it leads, and that it leads from no other digest."""
    rows = LE.bundle_proofs(_chain(spark, d))
    steps = F.array_join(F.transform("proof", lambda s: F.concat(s["side"], F.substring(s["sibling"], 1, 12))), " ")
    wrong = LE.verify_proof(F.sha2(F.lit("another"), 256), F.col("proof"), F.col("merkle_root"))
    return rows.select("sensor_id", "block", "index", steps.alias("proof"), "verified", wrong.alias("wrong"))


@query(f'SELECT sensor_id, "index", {O.hmac(SIGNING_KEY, "header_hash")} AS signature FROM ({O.chain()})')
def E8_signatures(spark, d):
    return _chain(spark, d).select("sensor_id", "index", "signature")


@query(f'SELECT sensor_id, "index", ts, merkle_root, prev_hash, header_hash FROM ({O.chain()})')
def E10_chain(spark, d):
    return _chain(spark, d).select("sensor_id", "index", "ts", "merkle_root", "prev_hash", "header_hash")


_HEX = "('0x' || substr(md5(sensor_id), 1, 1))::INTEGER"


def _tampered(chain: DataFrame) -> DataFrame:
    """A block of each sensor changed: its root, its signature, one of its digests, or a later block left out, by the sensor's hash."""
    kind = F.conv(F.substring(F.md5("sensor_id"), 1, 1), 16, 10).cast("int") % 5
    at = lambda k, index: (kind == k) & (F.col("index") == index)
    other = F.sha2(F.lit("other"), 256)
    return chain.where(~at(3, 5)).withColumns(
        {
            "merkle_root": F.when(at(0, 2), other).otherwise(F.col("merkle_root")), "signature": F.when(at(1, 3), other).otherwise(F.col("signature")),
            "digests": F.when(at(2, 4), F.transform("digests", lambda x, i: F.when(i == 1, other).otherwise(x))).otherwise(F.col("digests")),
        }
    )


@query(f"""SELECT sensor_id, copy, CASE WHEN copy = 'tampered' AND k = 3 AND n > 5 THEN n - 1 ELSE n END AS blocks, b AS broken_at, b IS NULL AS intact FROM (
  SELECT *, CASE WHEN copy = 'sealed' THEN NULL WHEN k = 0 AND n > 2 THEN 2 WHEN k = 1 AND n > 3 THEN 3 WHEN k = 2 AND n > 4 THEN 4 WHEN k = 3 AND n > 6 THEN 6 END::BIGINT AS b
  FROM (SELECT sensor_id, {_HEX} % 5 AS k, count(*) AS n FROM ({O.chain()}) GROUP BY sensor_id), (VALUES ('sealed'), ('tampered')) c(copy))""")
def E15_verify_chain(spark, d):
    """The chain as sealed, and after one block of each sensor was changed: the first block that does not hold."""
    chain = _chain(spark, d)
    sealed = LE.verify_chain(chain, SIGNING_KEY).withColumn("copy", F.lit("sealed"))
    return sealed.unionByName(LE.verify_chain(_tampered(chain), SIGNING_KEY).withColumn("copy", F.lit("tampered")))


@query(f'SELECT c.sensor_id, bundles, blocks, substr(head, 1, 16) AS head, blocks - 1 AS anchored, true AS intact FROM (SELECT sensor_id, count(*) AS blocks, arg_max(header_hash, "index") AS head FROM ({O.chain()}) GROUP BY sensor_id) c JOIN (SELECT sensor_id, sum(len(digests))::BIGINT AS bundles FROM ({O.blocks()}) b GROUP BY sensor_id) b USING (sensor_id)')
def E16_summary(spark, d):
    return LE.summary(_chain(spark, d), SIGNING_KEY).select("sensor_id", "bundles", "blocks", "head", "anchored", "intact")


# --- profiles and windows -----------------------------------------------------------------------------------------------------------

_PROFILE = """count(*) AS packets, sum(length)::BIGINT AS bytes, count(*) FILTER (upper(proto) = 'TCP') AS tcp, count(*) FILTER (upper(proto) = 'UDP') AS udp, count(*) FILTER (upper(proto) NOT IN ('TCP', 'UDP')) AS other,
  count(*) FILTER (dns_qname IS NOT NULL OR src_port = 53 OR dst_port = 53) AS dns, count(DISTINCT src_ip) AS src_ips, count(DISTINCT dst_ip) AS dst_ips, round(greatest(0.0, arg_max(ts, frame_no) - arg_min(ts, frame_no)), 6) AS duration,
  round(coalesce(count(*) / nullif(greatest(0.0, arg_max(ts, frame_no) - arg_min(ts, frame_no)), 0), 0), 6) AS packets_per_s, round(avg(length), 6) AS mean_size, 100.0::DOUBLE AS quality_pct"""
_PCOLS = ["packets", "bytes", "tcp", "udp", "other", "dns", "src_ips", "dst_ips"]


@query(f"SELECT {_PROFILE} FROM ({_EV}) p")
def R1_profile(spark, d):
    return PR.profile(adapter(spark, d, "pkt_events")).select(*_PCOLS, r("duration"), r("packets_per_s"), r("mean_size"), "quality_pct")


@query(f"""SELECT b.bucket, b.bucket * 2.0::DOUBLE AS start_s, coalesce(n, 0) AS packets, coalesce(s, 0)::BIGINT AS bytes, coalesce(n, 0) / 2.0 AS packets_per_s, coalesce(s, 0) / 2.0 AS bytes_per_s FROM (
  WITH x AS (SELECT floor(greatest(0.0, ts - (SELECT arg_min(ts, frame_no) FROM ({_EV}) p)) / 2.0)::BIGINT AS bucket, length FROM ({_EV}) p),
  g AS (SELECT bucket, count(*) AS n, sum(length) AS s FROM x GROUP BY bucket) SELECT r.bucket, n, s FROM (SELECT unnest(range((SELECT max(bucket) FROM g) + 1)) AS bucket) r LEFT JOIN g USING (bucket)) b""")
def R2_buckets(spark, d):
    return PR.rate_buckets(adapter(spark, d, "pkt_events"), 2.0)


@query(" UNION ALL ".join(f"SELECT '{n}' AS scenario, {_PROFILE} FROM ({duck(n)}) p" for n in ("pkt_events", "pkt_flood", "pkt_lineitem")))
def R8_compare(spark, d):
    rows = PR.compare({n: adapter(spark, d, n) for n in ("pkt_events", "pkt_flood", "pkt_lineitem")})
    return rows.select("scenario", *_PCOLS, r("duration"), r("packets_per_s"), r("mean_size"), "quality_pct")


@query(f"SELECT floor(ts / 60)::BIGINT * 60 AS window_start, {O.KEY}, count(*) AS packets, sum(length)::BIGINT AS bytes FROM ({_EV}) p GROUP BY ALL")
def T1_aligned_windows(spark, d):
    rows = windowed_flows(adapter(spark, d, "pkt_events"))
    return rows.select(F.unix_seconds("window.start").alias("window_start"), *FLOW_KEY, "packets", "bytes")


@query(O.unaligned(_EV, 60))
def T1_unaligned_windows(spark, d):
    packets = adapter(spark, d, "pkt_events").withColumn("sensor_id", F.col("dst_ip"))
    rows = unaligned_windows(packets, 60.0)
    return rows.groupBy("sensor_id", "window_no", "window_start").agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"))


@query(f"SELECT min(seq) AS seq, detector, flow_key, arg_min(confidence, seq) AS confidence FROM ({duck('alerts')}) a GROUP BY detector, flow_key")
def T3_first_alerts(spark, d):
    return first_alerts(adapter(spark, d, "alerts")).select("seq", "detector", "flow_key", "confidence")


# --- incidents and policy -------------------------------------------------------------------------------------------------------------

_AL = duck("alerts")


@query(f"SELECT host, bucket, alerts, detectors, first_ts, last_ts, confidence, threat_score, severity FROM ({O.groups()})")
def K1_incident_groups(spark, d):
    return IN.groups(adapter(spark, d, "alerts")).select("host", "bucket", "alerts", "detectors", "first_ts", "last_ts", "confidence", "threat_score", "severity")


@query(f"SELECT concat('INC-', CASE WHEN n < 10000 THEN lpad(n::VARCHAR, 4, '0') ELSE n::VARCHAR END) AS incident_id, host, bucket, threat_score FROM (SELECT *, row_number() OVER (ORDER BY host, bucket) AS n FROM ({O.groups()}))")
def K1_incidents(spark, d):
    return IN.correlate(adapter(spark, d, "alerts")).select("incident_id", "host", "bucket", "threat_score")


@query(f"SELECT seq, {O.HOST} AS host, upper(threat) AS type, strftime(make_timestamp(floor(ts * 1000000 + 0.5)::BIGINT), '%Y-%m-%dT%H:%M:%S+00:00') AS timestamp FROM ({_AL}) a")
def K4_timeline(spark, d):
    return IN.timeline(adapter(spark, d, "alerts")).select("seq", "host", "type", "timestamp")


@query(f"SELECT concat('ALT-', CASE WHEN n < 10000 THEN lpad(n::VARCHAR, 4, '0') ELSE n::VARCHAR END) AS id, concat('EV-', CASE WHEN n < 10000 THEN lpad(n::VARCHAR, 4, '0') ELSE n::VARCHAR END) AS evidence_id, seq, split_part(flow_key, '->', 1) AS source, split_part(flow_key, '->', 2) AS destination FROM (SELECT *, row_number() OVER (ORDER BY seq) AS n FROM ({_AL}) a)")
def K5_alert_records(spark, d):
    return IN.alert_records(adapter(spark, d, "alerts")).select("id", "evidence_id", "seq", "source", "destination")


@query(f"SELECT seq, seq % 10 <> 3 AS verified FROM ({_AL}) b")
def K7_verify_evidence(spark, d):
    """Alerts against the sealed digests, a tenth of them changed after sealing."""
    digest = LE.bundle_digest(*_bundle_parts(F.when(F.col("seq") % 10 == 3, F.lit("elsewhere")).otherwise(F.col("flow_key"))))
    alerts = adapter(spark, d, "alerts").select("seq", F.col("detector").alias("sensor_id"), digest.alias("digest"))
    chain = written(_chain(spark, d), "chain")
    proofs = LE.bundle_proofs(chain).join(LE.verify_chain(chain, SIGNING_KEY).select("sensor_id", "intact"), "sensor_id")
    proofs = proofs.select("sensor_id", F.col("leaf").alias("digest"), (F.col("verified") & F.col("intact")).alias("verified"))
    return alerts.join(proofs, ["sensor_id", "digest"], "left").select("seq", F.coalesce("verified", F.lit(False)).alias("verified"))


@query(f"SELECT seq, detector, confidence FROM ({_AL}) a ORDER BY confidence DESC, seq LIMIT 50 OFFSET 100")
def K8_page(spark, d):
    return IN.page(adapter(spark, d, "alerts").select("seq", "detector", "confidence"), [F.desc("confidence"), "seq"], 50, 100)[0]


@query(f"SELECT detector, count(*) AS alerts, count(DISTINCT {O.HOST}) AS hosts, max(confidence) AS max_confidence FROM ({_AL}) a GROUP BY detector")
def K13_detector_status(spark, d):
    return IN.detector_status(adapter(spark, d, "alerts"))


_STATES = "(VALUES ('queued'), ('processing'), ('completed'), ('failed')) s(status)"
_JOB = "CASE event_id % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'processing' WHEN 4 THEN 'failed' ELSE 'completed' END"
_JOBS = f"SELECT s.status, count(job_id) AS jobs FROM {_STATES} LEFT JOIN (SELECT user_id AS job_id, arg_max({_JOB}, event_id) AS status FROM events GROUP BY user_id) j USING (status) GROUP BY s.status"


def _jobs(spark, d) -> DataFrame:
    changes = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("version"), F.expr(_JOB).alias("status"))
    return TB.job_counts(TB.latest_jobs(changes))


@query(_JOBS)
def K11_job_counts(spark, d):
    return _jobs(spark, d)


@query(f"""SELECT packets AS packets_processed, flows AS flows_created, alerts AS alerts_generated, incidents AS incidents_created, (SELECT jobs FROM ({_JOBS}) WHERE status = 'queued') AS jobs_queued, (SELECT jobs FROM ({_JOBS}) WHERE status = 'processing') AS jobs_processing,
  (SELECT jobs FROM ({_JOBS}) WHERE status = 'completed') AS jobs_completed, (SELECT jobs FROM ({_JOBS}) WHERE status = 'failed') AS jobs_failed, blocks, bundles, true AS intact, round(packets / span, 6) AS packets_per_s
  FROM (SELECT sum(packets)::BIGINT AS packets, count(*) AS flows, max(last_ts) - min(start_ts) AS span FROM ({O.flows(_EV)})), (SELECT count(*) AS alerts FROM events), (SELECT count(*) AS incidents FROM ({O.groups()})),
  (SELECT sum(len(digests))::BIGINT AS bundles, (count(*) + count(DISTINCT sensor_id))::BIGINT AS blocks FROM ({O.blocks()}) b)""")
def K13_service_status(spark, d):
    found = adapter(spark, d, "alerts")
    row = IN.service_status(FW.flows(adapter(spark, d, "pkt_events")), found, IN.groups(found), _jobs(spark, d), LE.summary(_chain(spark, d), SIGNING_KEY))
    return row.withColumn("packets_per_s", F.round("packets_per_s", 6))


_CLASS = "CASE WHEN confidence >= 0.9 THEN 'CRITICAL' WHEN confidence >= 0.6 THEN 'HIGH' WHEN confidence >= 0.3 THEN 'MEDIUM' WHEN confidence >= 0.1 THEN 'LOW' ELSE 'MINIMAL' END"


@query(f"SELECT {_CLASS} AS classification, count(*) AS n FROM ({_AL}) a GROUP BY ALL")
def W1_classify(spark, d):
    return adapter(spark, d, "alerts").groupBy(PO.classify(F.col("confidence")).alias("classification")).agg(F.count("*").alias("n"))


def _requests(spark, d) -> DataFrame:
    return adapter(spark, d, "alerts").select("seq", IN.host(F.col("flow_key")).alias("source"), F.col("ts").alias("at"), F.col("confidence").alias("threat_level"))


def _policy(spark, d) -> DataFrame:
    requests = _requests(spark, d)
    sources = requests.select("source").distinct().withColumn("h", F.conv(F.substring(F.md5("source"), 1, 2), 16, 10).cast("int"))
    temporary = sources.where("h % 5 = 2").select("source", F.lit(0.0).alias("starts"), F.lit(1704100000.0).alias("expires"), F.lit("seeded rule").alias("reason"))
    return PO.evaluate(requests, sources.where("h % 5 = 0"), sources.where("h % 5 = 1"), temporary)


#: Operations that a part of the alerts stands for.
_DONE = "CASE seq // 29 % 6 WHEN 0 THEN 'allow' WHEN 1 THEN 'disallow' WHEN 2 THEN 'block' WHEN 3 THEN 'unblock' WHEN 4 THEN 'temporary' ELSE 'remove' END"
_ASKED = f"SELECT {O.HOST} AS source, ts AS t, seq, confidence AS level FROM ({_AL}) a"
_LISTED = f"SELECT source, CASE WHEN h % 5 = 2 THEN 0.0::DOUBLE ELSE -1.0 END AS t, 0 AS seq, CASE h % 5 WHEN 0 THEN 'allow' WHEN 1 THEN 'block' ELSE 'temporary' END AS op, 1704100000.0::DOUBLE AS expires FROM (SELECT DISTINCT {O.HOST} AS source, ('0x' || substr(md5({O.HOST}), 1, 2))::INTEGER AS h FROM ({_AL}) a) WHERE h % 5 < 3"
_LOG = f"SELECT {O.HOST} AS source, ts AS t, seq, {_DONE} AS op, ts + 86400 * (1 + seq % 40) AS expires FROM ({_AL}) a WHERE seq % 29 = 3"
_POLICY = f"""SELECT p.*, {_CLASS} AS classification, CASE WHEN rule IN ('blocklist', 'temporary', 'critical', 'high') THEN 'BLOCK' WHEN rule = 'monitor' THEN 'ALLOW_MONITOR' ELSE 'ALLOW' END AS action
  FROM (SELECT source, seq, rule FROM ({{}}) WHERE rule IS NOT NULL) p JOIN ({_AL}) a USING (seq)"""
_BY_LISTS, _BY_LOG = _POLICY.format(O.policy(_ASKED, _LISTED)), _POLICY.format(O.policy(_ASKED, _LOG))


@query(f"SELECT seq, source, rule, action, classification, action <> 'BLOCK' AS allowed FROM ({_BY_LISTS})")
def W2_policy(spark, d):
    """Lists, rules with an end, and rules that HIGH requests set, all as of each request."""
    return _policy(spark, d).select("seq", "source", "rule", "action", "classification", "allowed")


def _log(spark, d) -> DataFrame:
    rows = _requests(spark, d).where("seq % 29 = 3").withColumn("op", F.expr(_DONE.replace("//", "div")))
    return rows.select("at", "seq", "source", "op", (F.col("at") + 86400 * (1 + F.col("seq") % 40)).alias("expires"), F.lit("by hand").alias("reason"))


@query(f"SELECT seq, source, rule, action, CASE rule WHEN 'temporary' THEN NULL ELSE action <> 'BLOCK' END AS allowed FROM ({_BY_LOG})")
def W2_policy_log(spark, d):
    """The same under a log in which operators set and take away rules of all kinds meanwhile."""
    return PO.decide(_requests(spark, d), _log(spark, d)).select("seq", "source", "rule", "action", F.when(F.col("rule") != "temporary", F.col("allowed")).alias("allowed"))


_OPS = "CASE event_id % 6 WHEN 0 THEN 'allow' WHEN 1 THEN 'block' WHEN 2 THEN 'temporary' WHEN 3 THEN 'remove' WHEN 4 THEN 'disallow' ELSE 'unblock' END"


@query(f"""SELECT source, CASE WHEN k = 'temporary' AND e <= 9000000 THEN 'none' ELSE k END AS state FROM (SELECT source, arg_max(k, seq) AS k, arg_max(e, seq) AS e FROM (
  {O.policy("SELECT 'x' AS source, 0.0::DOUBLE AS t, 0 AS seq, 0.0 AS level WHERE false", f"SELECT concat('u', user_id) AS source, event_id::DOUBLE AS t, event_id AS seq, {_OPS} AS op, (event_id + 1 + event_id % 9000 * 10000)::DOUBLE AS expires FROM events")}) GROUP BY source)""")
def W3_rule_state(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("seq"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source"), F.expr(_OPS).alias("op"), F.expr("CAST(event_id AS DOUBLE)").alias("at"), F.expr("CAST(event_id + 1 + event_id % 9000 * 10000 AS DOUBLE)").alias("expires"), F.lit("by hand").alias("reason"))
    return PO.rule_state(events, 9000000.0).select("source", "state")


@query(f"SELECT source, t AS starts, t + 300 AS expires FROM ({O.policy(_ASKED, _LOG)}) WHERE rule = 'high'")
def W5_automatic_rules(spark, d):
    return PO.automatic_rules(_requests(spark, d), _log(spark, d)).select("source", "starts", "expires")


@query(f"SELECT action, count(*) AS requests, count(*) FILTER (action <> 'BLOCK') AS allowed FROM ({_BY_LISTS}) GROUP BY action")
def W6_decision_summary(spark, d):
    return PO.decision_summary(_policy(spark, d))


# --- evaluation --------------------------------------------------------------------------------------------------------------------


def _judged(spark, d) -> DataFrame:
    return adapter(spark, d, "scores").withColumns({"actual": F.col("label").cast("string"), "predicted": (F.col("score") >= 0.5).cast("int").cast("string")})


_JU = f"SELECT *, label::VARCHAR AS actual, (score >= 0.5)::INTEGER::VARCHAR AS predicted FROM ({_SC}) s"
_PL = f"""SELECT label, tp, fp, fn, coalesce(tp / nullif(tp + fp, 0), 1.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 1.0) AS recall FROM (
  SELECT l.label, count(*) FILTER (j.actual = l.label AND predicted = l.label) AS tp, count(*) FILTER (j.actual <> l.label AND predicted = l.label) AS fp, count(*) FILTER (j.actual = l.label AND predicted <> l.label) AS fn
  FROM (SELECT DISTINCT unnest([actual, predicted]) AS label FROM ({_JU})) l CROSS JOIN ({_JU}) j GROUP BY l.label)"""


@query(f"SELECT label, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1 FROM ({_PL})")
def V1_per_label(spark, d):
    return ME.per_label(_judged(spark, d)).select("label", "tp", "fp", "fn", r("precision"), r("recall"), r("f1"))


@query(f"SELECT class, n, round(mean, 6) AS mean, round(std, 6) AS std, x[least(n - 1, floor(0.5 * n)::BIGINT) + 1] AS median, x[least(n - 1, floor(0.9 * n)::BIGINT) + 1] AS p90, x[least(n - 1, floor(0.95 * n)::BIGINT) + 1] AS p95, x[-1] AS max, x[1] AS min FROM (SELECT class, count(*) AS n, avg(score) AS mean, stddev_pop(score) AS std, list_sort(list(score)) AS x FROM ({_SC}) s GROUP BY class)")
def V3_summary_stats(spark, d):
    return ME.summary_stats(adapter(spark, d, "scores"), "score", "class").select("class", "n", r("mean"), r("std"), "median", "p90", "p95", "max", "min")


@query(f"SELECT actual, predicted, count(*) AS n FROM ({_JU}) GROUP BY ALL")
def V4_confusion(spark, d):
    return ME.confusion(_judged(spark, d))


@query(f"SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0)), 6) AS f1 FROM ({_PL})")
def V4_macro(spark, d):
    return ME.macro(ME.per_label(_judged(spark, d))).select(r("precision"), r("recall"), r("f1"))


@query(f"SELECT host, first(threat ORDER BY confidence DESC, seq) AS predicted FROM (SELECT *, {O.HOST} AS host FROM ({_AL}) a) GROUP BY host")
def V5_top_label(spark, d):
    return ME.top_label(adapter(spark, d, "alerts").withColumn("host", IN.host(F.col("flow_key"))), "host")


@query(f"SELECT host, bool_or(threat IN ('click_threat', 'purchase_threat') AND contains(flow_key, '->203')) AS matched FROM (SELECT *, {O.HOST} AS host FROM ({_AL}) a) GROUP BY host")
def V6_matches(spark, d):
    rows = adapter(spark, d, "alerts").withColumns({"host": IN.host(F.col("flow_key")), "title": F.lit("")})
    truth = rows.select("host").distinct().withColumns({"threats": F.array(F.lit("click_threat"), F.lit("purchase_threat")), "target": F.lit("->203")})
    return ME.matches(rows, truth, "host")


@query(f"SELECT count(*) AS n, round(avg(abs(a.ack_total - t.cents) / t.cents), 6) AS mean_error FROM ({O.ACKS.format(_LI)}) a JOIN (SELECT {O.KEY}, sum(length)::BIGINT AS cents FROM ({_LI}) p GROUP BY ALL) t USING ({O.KEY}) WHERE t.cents > 0")
def V7_reconstruction(spark, d):
    packets = adapter(spark, d, "pkt_lineitem")
    truth = packets.groupBy(*FLOW_KEY).agg(F.sum(F.col("length").cast("long")).alias("truth"))
    rows = ME.relative_errors(FW.ack_progress_monotone(packets).join(truth, FLOW_KEY), "ack_total", "truth")
    return rows.agg(F.count("*").alias("n"), r(F.avg("error"), 6, "mean_error"))


_SPLIT = f"""SELECT a.alpha, s.split, e.id, e.error, ('0x' || substr(md5(concat(s.split, ':', e.id)), 1, 1))::INTEGER % 2 = 0 AS fit FROM (SELECT id, round(1 - score, 6) AS error FROM ({_SC}) s) e, range(200) s(split), (VALUES (0.05::DOUBLE), (0.1), (0.2)) a(alpha)"""


@query(f"""WITH r AS ({_SPLIT}), f AS (SELECT *, row_number() OVER (PARTITION BY alpha, split ORDER BY error, id) AS k, count(*) OVER (PARTITION BY alpha, split) AS n FROM r WHERE fit),
  w AS (SELECT alpha, split, error AS width FROM f WHERE k = least(n, greatest(1, ceil((n + 1) * (1 - alpha))))),
  h AS (SELECT alpha, split, width, avg((error <= width)::INTEGER) AS inside FROM r JOIN w USING (alpha, split) WHERE NOT fit GROUP BY ALL)
  SELECT alpha, count(*) AS splits, round(avg(inside), 6) AS coverage, round(avg(width), 6) AS half_width FROM h GROUP BY alpha""")
def V8_split_intervals(spark, d):
    rows = adapter(spark, d, "scores").select(F.col("id"), F.round(1 - F.col("score"), 6).alias("error"))
    return CO.split_intervals(rows).select("alpha", "splits", r("coverage"), r("half_width"))


@query(f"SELECT n1, n0, round((rs - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS auc FROM (SELECT count(*) FILTER (label = 1) AS n1, count(*) FILTER (label <> 1) AS n0, sum(rk) FILTER (label = 1) AS rs FROM (SELECT *, row_number() OVER (ORDER BY score, id) AS rk FROM ({_SC}) s))")
def V13_auc(spark, d):
    return ME.auc(adapter(spark, d, "scores")).select("n1", "n0", r("auc"))


_TH = f"SELECT count(*) FILTER (score >= 0.6 AND label = 1) AS tp, count(*) FILTER (score >= 0.6 AND label <> 1) AS fp, count(*) FILTER (score < 0.6 AND label = 1) AS fn, count(*) FILTER (score < 0.6 AND label <> 1) AS tn FROM ({_SC}) s"


@query(f"SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS fpr, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall FROM ({_TH})")
def V14_threshold(spark, d):
    return ME.at_threshold(adapter(spark, d, "scores"), 0.6).select("tp", "fp", "fn", "tn", r("accuracy"), r("fpr"), r("recall"))


_CURVE = f"""SELECT i::INTEGER AS i, round(threshold, 6) AS threshold, round(coalesce(tp / nullif(called, 0), 1.0), 6) AS precision, round(tp / n1, 6) AS recall FROM (
  SELECT i, any_value(t) AS threshold, count(*) FILTER (score >= t AND label = 1) AS tp, count(*) FILTER (score >= t) AS called, count(*) FILTER (label = 1) AS n1
  FROM (SELECT i, lo + (hi - lo) * i / 25 AS t FROM (SELECT min(score) AS lo, max(score) AS hi FROM ({_SC}) s), range(26) x(i)) g CROSS JOIN ({_SC}) s GROUP BY i)"""


@query(_CURVE)
def V15_pr_curve(spark, d):
    return ME.pr_curve(adapter(spark, d, "scores")).select("i", r("threshold"), r("precision"), r("recall"))


@query(f"SELECT round(sum(precision * step), 4) AS average_precision FROM (SELECT precision, recall - coalesce(lag(recall) OVER (ORDER BY recall, i DESC), 0) AS step FROM ({_CURVE}))")
def V15_average_precision(spark, d):
    return ME.average_precision(ME.pr_curve(adapter(spark, d, "scores"))).select(r("average_precision", 4))


@query(f"SELECT id, class, CASE WHEN k <= 30 THEN 'train' ELSE 'test' END AS part FROM (SELECT id, class, row_number() OVER (PARTITION BY class ORDER BY md5(concat('1:', id)), id) AS k FROM ({_SC}) s) WHERE k <= 50")
def V16_stratified(spark, d):
    return ME.stratified(adapter(spark, d, "scores").drop("part"), "class", 30, 20).where("part is not null").select("id", "class", "part")


@query(f"SELECT class, round(avg((score >= 0.6)::INTEGER), 6) AS recall, count(*) AS n FROM ({_SC}) s WHERE label = 1 GROUP BY class")
def V17_recall_by_class(spark, d):
    return ME.recall_by(adapter(spark, d, "scores").where("label = 1"), "class", 0.6).select("class", r("recall"), "n")


@query(f"WITH c AS (SELECT detector, avg(confidence) AS m FROM ({_AL}) a GROUP BY detector) SELECT detector, round(m, 6) AS m, 'top' AS \"end\" FROM (FROM c ORDER BY m DESC, detector LIMIT 2) UNION ALL SELECT detector, round(m, 6), 'bottom' FROM (FROM c ORDER BY m, detector LIMIT 2)")
def V18_extremes(spark, d):
    rows = adapter(spark, d, "alerts").groupBy("detector").agg(F.avg("confidence").alias("m"))
    return ME.extremes(rows, "m", 2, "detector").withColumn("m", F.round("m", 6))


_ENDS = {"src_ip": "concat('10.', event % 7, '.', event // 256 % 256, '.', event % 256)", "dst_ip": "concat('198.51.100.', event % 250)"}


@query(f"""SELECT row_number() OVER (ORDER BY frame_no) - 1 AS frame_no, ts, {_ENDS["src_ip"].replace("event", "frame_no")} AS src_ip, {_ENDS["dst_ip"].replace("event", "frame_no")} AS dst_ip, src_port, dst_port, proto, tcp_flags, dns_qname AS qname,
  CASE WHEN dns_qname IS NOT NULL THEN coalesce(dns_qtype, 'A') END AS qtype, http_partial AND dst_port = 80 AND proto = 'TCP' AS http_partial FROM (SELECT * REPLACE (round(ts, 6) AS ts) FROM ({_EV}) p)""")
def S1_capture_round_trip(spark, d):
    """Packets written to capture files that follow one another and read again, in ranges of them."""
    from oneway.operators.shared import shared_folder
    from oneway.sources.pcap import PcapDataSource, read_captures, write_pcap

    spark.dataSource.register(PcapDataSource)
    ends = {k: F.expr(v.replace("event", "frame_no").replace("//", "div")) for k, v in _ENDS.items()}
    path = f"{shared_folder(spark)}/oneway-capture-{uuid.uuid4().hex}"
    write_pcap(adapter(spark, d, "pkt_events").withColumns(ends).where("proto in ('TCP', 'UDP')"), path, CAPTURE_PACKETS)
    rows = read_captures(spark, path, 1 << 18, through=True)
    return rows.select("frame_no", r("ts"), "src_ip", "dst_ip", "src_port", "dst_port", "proto", "tcp_flags", F.col("dns_qname").alias("qname"), F.col("dns_qtype").alias("qtype"), "http_partial")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
