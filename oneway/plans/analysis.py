"""Whole jobs: one capture to stored results, and the evaluation over labelled scenarios."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oneway.functions import fixtures as X
from oneway.functions.canonical import number
from oneway.operators import incidents as IN
from oneway.operators import ledger as LE
from oneway.operators import metrics as ME
from oneway.operators.alerts import alerts, packet_hashes
from oneway.operators.beacon import score_beacons
from oneway.operators.estimators import estimate
from oneway.operators.flows import flows
from oneway.operators.dga import score_names
from oneway.operators.profile import profile
from oneway.operators.shared import written
from oneway.sources.pcap import PcapDataSource, write_pcap
from oneway.streaming.windows import unaligned_windows


@dataclass
class Analysis:
    """The results of a window of packets.  Alerts, findings and the chain lie in the shared folder, since the others read them."""

    flows: DataFrame
    alerts: DataFrame
    chain: DataFrame
    evidence: DataFrame
    incidents: DataFrame
    profile: DataFrame

    def save(self, path: str) -> None:
        """One folder per kind; a later run replaces its own results only."""
        for name in ("flows", "alerts", "chain", "evidence", "incidents", "profile"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")


def windowed_alerts(packets: DataFrame, window_s: float) -> DataFrame:
    """The first alert of each sensor's threat and flow key over unaligned windows, with sensor_id (that of the packets, or ``capture`` where they
    have none) and window_no.  Window and sensor are columns that all detectors group by, so windows never mix and names stay as they are."""
    named = packets if "sensor_id" in packets.columns else packets.withColumn("sensor_id", F.lit("capture"))
    found = alerts(unaligned_windows(named, window_s), window_s, by=["sensor_id", "window_no"])
    first = F.min_by(F.struct(*(c for c in found.columns if c not in ("sensor_id", "threat", "flow_key"))), F.struct("window_no", "branch", "seq"))
    return found.groupBy("sensor_id", "threat", "flow_key").agg(first.alias("a")).select("sensor_id", "threat", "flow_key", "a.*")


def analyze(packets: DataFrame, window_s: float = 60.0, sensor: str = "sensor-1", key: bytes = b"sensor-signing-key", now: float | None = None, windows: bool = False) -> Analysis:
    """Flows, alerts, sealed evidence, incidents and a profile of one window, or with ``windows`` of as many as the packets fill, of which
    each threat and flow key is told once.  Packets that name their sensor (sensor_id) are judged and sealed per sensor.

    Evidence hashes stand for the packets of the first flow an alert rests on; each alert's digest is sealed in order, eight to a block.
    """
    by = ["sensor_id"] if "sensor_id" in packets.columns else []
    table = flows(packets, by)
    end = F.lit(float(now)) if now is not None else None
    found = windowed_alerts(packets, window_s) if windows else alerts(packets, window_s, by=by)
    last = packets.agg((F.max_by("ts", "frame_no") + 1).alias("ts"))  # one row
    found = found.join(F.broadcast(last), F.lit(True)) if end is None else found.withColumn("ts", end)
    # alerts, evidence, incidents and the chain all read what was found
    found = written(found.withColumn("order", F.col("branch").cast("long") * (1 << 56) + F.col("seq")), "alerts")
    # only flows that an alert rests on are hashed
    own = [*by, "evidence_key"]
    named = found.select(*own).where("evidence_key is not null").distinct()
    hashed = packet_hashes(table.select(*by, F.col("flow_key").alias("evidence_key"), "packets").join(named, own, "left_semi"), "evidence_key")
    roots = LE.merkle_root(hashed, "packet_hashes", 64, "pkt_root").select(*own, "pkt_root")
    rows = found.join(roots, own, "left").withColumn("pkt_root", F.coalesce("pkt_root", F.lit(LE.NO_PACKETS)))
    # the order makes digests of equal findings differ
    alert = {"order": F.col("order"), **{c: F.col(c) for c in ("detector", "threat", "severity", "flow_key", "title")}, "confidence": number(F.round("confidence", 4))}
    sensor_id = F.col("sensor_id") if by else F.lit(sensor)
    rows = rows.withColumns({"sensor_id": sensor_id, "digest": LE.bundle_digest(alert, {"key": F.col("evidence_key")}, F.col("pkt_root"), {"subject": F.col("subject")}, F.lit("rules@1"))})
    rows = written(rows, "findings")
    chain = written(LE.seal(LE.batches(rows, order="order"), key), "chain")
    proofs = LE.bundle_proofs(chain).select("sensor_id", F.col("leaf").alias("digest"), "block", "merkle_root", "verified")
    evidence = rows.join(proofs, ["sensor_id", "digest"], "left").join(LE.verify_chain(chain, key).select("sensor_id", "intact"), "sensor_id", "left")
    evidence = evidence.withColumn("verified", F.coalesce(F.col("verified") & F.col("intact"), F.lit(False)))
    groups = IN.correlate(found.withColumn("seq", F.col("order")))
    return Analysis(estimate(packets), found, chain, evidence.drop("intact"), groups, profile(packets))


def explanation(incidents: DataFrame, incident_id: str) -> DataFrame:
    return IN.by_id(incidents, "incident_id", incident_id).select("incident_id", "reasons", "supporting_detectors", "recommendation")


def _tagged(packets: Iterable[dict], tag: str) -> list[dict]:
    """Packets whose addresses and names belong to one trial, so that all trials share one job."""
    out = []
    for p in packets:
        name = p["dns_qname"]
        out.append(p | {"src_ip": f"{tag}/{p['src_ip']}", "dst_ip": f"{tag}/{p['dst_ip']}", "dns_qname": name and f"{name}{tag}"})
    return out


def evaluate(spark: SparkSession, trials: int = 5, scenarios=X.SCENARIOS) -> dict[str, DataFrame]:
    """Every scenario ``trials`` times over background traffic, judged in one job: alerts, verdicts, confusion, per_label, macro, alarms."""
    packets, truth = [], []
    for s, (name, make, threat) in enumerate(scenarios):
        for t in range(trials):
            tag = f"s{s}t{t}"
            packets += _tagged(make(1000 * s + t) + (X.background(5000 + t) if threat else []), tag)
            truth.append((tag, name, threat or "benign"))
    found = alerts(X.frame(spark, packets))
    trial = F.regexp_extract(F.concat_ws(" ", "flow_key", "subject"), "(s[0-9]+t[0-9]+)", 1)
    found = found.withColumn("trial", trial)
    top = ME.top_label(found, "trial")
    known = spark.createDataFrame(truth, "trial string, scenario string, actual string")
    verdicts = known.join(top, "trial", "left").withColumn("predicted", F.coalesce("predicted", F.lit("benign")))
    labels = ME.per_label(verdicts)
    alarms = verdicts.where("actual = 'benign'").agg(F.avg((F.col("predicted") != "benign").cast("int")).alias("false_alarm_rate"), F.count("*").alias("n"))
    return {"alerts": found, "verdicts": verdicts, "confusion": ME.confusion(verdicts), "per_label": labels, "macro": ME.macro(labels), "alarms": alarms}


def jitter_sweep(spark: SparkSession, counts=(15, 40), jitters=(0.0, 0.1, 0.2, 0.3, 0.4), trials: int = 20, period: float = 60.0) -> DataFrame:
    """Share of trials in which a beacon of so many check-ins and so much jitter is found: the whole grid in one job."""
    rows = []
    for n in counts:
        for j in jitters:
            for t in range(trials):
                for i, p in enumerate(X.beacon(9000 + t, n, period, 2 * j)[::3]):
                    rows.append((f"{n}|{j}|{t}", "d", p["ts"], 512, 443, i))
    frame = spark.createDataFrame(rows, "src_ip string, dst_ip string, start_ts double, bytes long, dst_port int, flow_seq long")
    parts = F.split("src_ip", "[|]")
    got = score_beacons(frame).select(parts[0].cast("int").alias("beacons"), parts[1].cast("double").alias("jitter"), F.col("is_beacon").cast("int").alias("hit"))
    return got.groupBy("beacons", "jitter").agg((F.sum("hit") / trials).alias("rate"))


def spoofed_or_crowd(packets: DataFrame) -> DataFrame:
    """Per destination the mean liveness of its SYN flows: under one half is spoofed, else a crowd."""
    rows = estimate(packets).where("proto = 'TCP' and syn + synack > 0").groupBy("dst_ip").agg(F.avg("liveness").alias("mean_liveness"))
    return rows.withColumn("verdict", F.when(F.col("mean_liveness") < 0.5, "spoofed").otherwise("crowd"))


def validate_captures(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Captures with the threats found (capture, threat) against those expected (capture, threats): any overlap passes."""
    sets = found.groupBy("capture").agg(F.array_sort(F.collect_set("threat")).alias("found"))
    rows = expected.join(sets, "capture", "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    return rows.withColumns({"passed": F.arrays_overlap("threats", "found"), "extra": F.array_except("found", "threats")})


def degradation(spark: SparkSession, trials: int = 10) -> DataFrame:
    """What is left of a beacon when it hides in other protocols: per variant the shares of trials with a beacon and with a generated name
    raised, and of flows whose unseen side is known from acknowledgements rather than from the prior."""
    variants = (("plain", X.beacon), ("doh", X.doh_beacon), ("quic", X.quic_beacon))
    packets = [p for name, make in variants for t in range(trials) for p in _tagged(make(7000 + t), f"{name}{t}")]
    frame = X.frame(spark, packets)
    variant, trial = (lambda c: F.regexp_extract(c, "^([a-z]+)", 1)), (lambda c: F.regexp_extract(c, "^([a-z]+[0-9]+)/", 1))
    raised = alerts(frame).withColumn("trial", trial("flow_key")).groupBy("trial").agg(F.max((F.col("threat") == "c2_beaconing").cast("int")).alias("beacon"), F.max((F.col("threat") == "dga_domain").cast("int")).alias("dga"))
    known = spark.createDataFrame([(n, f"{n}{t}") for n, _ in variants for t in range(trials)], "variant string, trial string")
    rates = known.join(raised, "trial", "left").groupBy("variant").agg(F.avg(F.coalesce("beacon", F.lit(0))).alias("beacon_rate"), F.avg(F.coalesce("dga", F.lit(0))).alias("dga_rate"))
    acks = estimate(frame).groupBy(variant("src_ip").alias("variant")).agg(F.avg(F.col("by_acks").cast("int")).alias("known_by_acks"))
    return rates.join(acks, "variant")


def name_auc(spark: SparkSession, n: int = 150) -> DataFrame:
    """How well the name score ranks generated names over ordinary ones."""
    names = [(x, 1) for x in X.arithmetic_names(11, n)] + [(f"www.{a}{b}.org", 0) for a in X.NAMES for b in ("", *X.NAMES)]
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(names)], "id long, qname string, generated int")
    return ME.auc(score_names(rows), "prob", "generated")


def write_captures(spark: SparkSession, folder: str, seed: int = 1) -> DataFrame:
    """The labelled captures, one folder each, on a path the executors mount; returns capture and threats."""
    spark.dataSource.register(PcapDataSource)
    for name, makers, _ in X.CAPTURES:
        write_pcap(X.frame(spark, [p for i, make in enumerate(makers) for p in make(seed + i)]), f"{folder}/{name}")
    return spark.createDataFrame([(n, list(t)) for n, _, t in X.CAPTURES], "capture string, threats array<string>")


def tampered(chain: DataFrame, index: int = 1) -> DataFrame:
    """The chain with one block's root exchanged."""
    return chain.withColumn("merkle_root", F.when(F.col("index") == index, F.sha2(F.lit("tampered"), 256)).otherwise(F.col("merkle_root")))
