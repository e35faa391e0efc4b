"""Alerts correlated to incidents: one per host and five minutes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oneway.functions.canonical import canonical, number
from oneway.operators.alerts import numbered
from oneway.sources.tables import JOB_STATES

BUCKET_S = 300
# What incidents say of their reasons, and advise.
PERIODIC, GENERATED, NAMING = "Periodic outbound communication", "Suspicious generated domain", "High-capacity DNS naming pattern"
UNNAMED = "Anomalous network behavior scored by the detection ensemble"
ISOLATE, MONITOR = "Investigate and isolate host", "Continue monitoring"


def host(flow_key: Column) -> Column:
    """What stands before the first colon of the key; ``unknown`` for a wildcard or nothing."""
    h = F.split_part(F.coalesce(flow_key, F.lit("")), F.lit(":"), F.lit(1))
    return F.when((h == "") | h.startswith("*"), "unknown").otherwise(h)


def iso(ts: Column) -> Column:
    return F.date_format(F.timestamp_micros(F.floor(ts * 1_000_000 + 0.5).cast("long")), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def score(max_confidence: Column, detectors: Column) -> Column:
    """0 to 100: confidence, and a bonus for detectors that agree."""
    return F.least(F.lit(100), F.bround(70 * max_confidence + F.least(F.lit(30), 15 * (detectors - 1)), 0)).cast("int")


def severity(points: Column) -> Column:
    return F.when(points >= 85, "critical").when(points >= 70, "high").when(points >= 50, "medium").when(points >= 30, "low").otherwise("info")


def groups(alerts: DataFrame) -> DataFrame:
    """Host, bucket, counts, score and severity; the alerts need seq, ts, detector, threat, confidence and flow_key.  Distinct
    detectors are counted over (host, bucket, detector) groups, so a noisy host is reduced before it meets."""
    rows = alerts.withColumns({"host": host(F.col("flow_key")), "bucket": F.floor(F.col("ts") / BUCKET_S).cast("long")})
    by = rows.groupBy("host", "bucket", "detector").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.max((F.col("threat") == "c2_beaconing").cast("int")).alias("c2"), F.max((F.col("threat") == "dga_domain").cast("int")).alias("dg"), F.max((F.col("threat") == "dns_tunnelling").cast("int")).alias("dt"))
    g = by.groupBy("host", "bucket").agg(
        F.sum("n").alias("alerts"), F.count("*").alias("detectors"), F.max("confidence").alias("max_confidence"), F.min("first").alias("first_ts"), F.max("last").alias("last_ts"), F.array_sort(F.collect_list("detector")).alias("supporting_detectors"),
        F.max("c2").alias("c2"), F.max("dg").alias("dg"), F.max("dt").alias("dt"),
    )
    g = g.withColumn("threat_score", score(F.col("max_confidence"), F.col("detectors"))).withColumn("severity", severity(F.col("threat_score")))
    has = lambda d: F.array_contains("supporting_detectors", d)
    reasons = F.filter(
        F.array(
            F.when(has("beaconing") | (F.col("c2") == 1), PERIODIC), F.when(has("dga") | (F.col("dg") == 1), GENERATED),
            F.when(has("dns_tunnel") | (F.col("dt") == 1), NAMING),
        ), lambda r: r.isNotNull(),
    )
    reasons = F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit(UNNAMED)))
    advice = F.when(F.col("severity").isin("high", "critical"), ISOLATE).otherwise(MONITOR)
    return g.withColumns({"confidence": F.round("max_confidence", 4), "reasons": reasons, "recommendation": advice}).drop("c2", "dg", "dt", "max_confidence")


def correlate(alerts: DataFrame) -> DataFrame:
    """Incidents with their numbers, in the order of (host, bucket)."""
    rows = numbered(groups(alerts), "INC-", ["host", "bucket"])
    return rows.withColumnRenamed("id", "incident_id").withColumn("chain", F.concat(F.array(F.lit("PCAP"), F.lit("FLOW")), "supporting_detectors", F.array(F.lit("CORRELATION"), F.lit("LEDGER"))))


def timeline(alerts: DataFrame) -> DataFrame:
    """One row per detection of an incident, in time order: kept as rows, for an incident has no bound on its detections."""
    rows = alerts.withColumns({"host": host(F.col("flow_key")), "bucket": F.floor(F.col("ts") / BUCKET_S).cast("long")})
    return rows.select("host", "bucket", "seq", "ts", iso(F.col("ts")).alias("timestamp"), F.upper("threat").alias("type"), "detector", "confidence")


def alert_records(alerts: DataFrame) -> DataFrame:
    """ALT- and EV-numbered records with source and destination."""
    rows = numbered(alerts, "ALT-", ["seq"])
    ends = F.split(F.col("flow_key"), "->")
    return rows.withColumns({"evidence_id": F.replace(F.col("id"), F.lit("ALT-"), F.lit("EV-")), "source": F.element_at(ends, 1), "destination": F.coalesce(F.try_element_at(ends, F.lit(2)), F.lit(""))})


def alert_json(rows: DataFrame) -> Column:
    """An alert's record as canonical JSON: all of its columns but ids, which follow from the order."""
    told = {"confidence": number(F.round("confidence", 4)), "ts": number(F.col("ts"))}
    return canonical(**{c: told.get(c, F.col(c)) for c in rows.columns if c in ("seq", "ts", "detector", "threat", "severity", "confidence", "flow_key", "title")})


def evidence_records(alerts: DataFrame, proofs: DataFrame | None = None) -> DataFrame:
    """Digest per alert; with ledger proofs (seq, merkle_root, verified) also its own block's root and whether it verifies."""
    rows = alert_records(alerts)
    rows = rows.withColumn("digest", F.sha2(alert_json(rows), 256))
    return rows if proofs is None else rows.join(proofs, "seq", "left").withColumn("verified", F.coalesce("verified", F.lit(False)))


def page(rows: DataFrame, order: list, limit: int = 50, offset: int = 0) -> tuple[DataFrame, dict]:
    """A page of ordered rows, with total and next offset; the limit lies in 1..200."""
    limit = min(200, max(1, limit))
    total = rows.count()
    following = offset + limit if offset + limit < total else None
    return rows.orderBy(*order).offset(offset).limit(limit), {"total": total, "limit": limit, "offset": offset, "next_offset": following}


def by_id(rows: DataFrame, column: str, value) -> DataFrame:
    return rows.where(F.col(column) == value)


def detector_status(alerts: DataFrame) -> DataFrame:
    """Alerts, hosts and highest confidence per detector."""
    rows = alerts.withColumn("host", host(F.col("flow_key"))).groupBy("detector", "host").agg(F.count("*").alias("n"), F.max("confidence").alias("c"))
    return rows.groupBy("detector").agg(F.sum("n").alias("alerts"), F.count("*").alias("hosts"), F.max("c").alias("max_confidence"))


def service_status(flows: DataFrame, alerts: DataFrame, incidents: DataFrame, jobs: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row: packets, flows, alerts and incidents so far, packets a second over the time that flows span, jobs by state (``jobs`` as
    ``job_counts`` gives them), and the ledger's blocks, bundles and whether all of it is intact (``ledger`` as ``summary`` gives it)."""
    span = F.max("last_ts") - F.min("start_ts")
    row = flows.agg(F.coalesce(F.sum("packets"), F.lit(0)).alias("packets_processed"), F.count("*").alias("flows_created"), span.alias("span"))
    for name, table in (("alerts_generated", alerts), ("incidents_created", incidents)):
        row = row.crossJoin(table.agg(F.count("*").alias(name)))  # one row each
    states = jobs.agg(*(F.coalesce(F.max(F.when(F.col("status") == s, F.col("jobs"))), F.lit(0)).alias(f"jobs_{s}") for s in JOB_STATES))
    chain = ledger.agg(F.coalesce(F.sum("blocks"), F.lit(0)).alias("blocks"), F.coalesce(F.sum("bundles"), F.lit(0)).alias("bundles"), F.coalesce(F.min("intact"), F.lit(False)).alias("intact"))
    rate = F.coalesce(F.try_divide("packets_processed", F.when(F.col("span") > 0, F.col("span"))), F.lit(0.0))
    return row.crossJoin(states).crossJoin(chain).withColumn("packets_per_s", rate).drop("span")
