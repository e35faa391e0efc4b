"""From findings to ranked alerts: one UNION ALL of the detector branches, severities, exclusions and first-seen rules.

The flow that stands for a finding travels through the aggregates as min_by(key, flow_seq), so no branch joins back to the flows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oneway.functions.lexical import heuristic_label, second_level
from oneway.operators.beacon import score_beacons
from oneway.operators.dga import score_names
from oneway.operators.floods import flood_findings
from oneway.operators.flows import dns_questions, flow_key, flows
from oneway.operators.ranges import positions
from oneway.operators.shared import written
from oneway.operators.tunnel import domains, scored

#: Names that one second-level domain may have before its names are the tunnel detector's affair.
MANY_NAMES = 12


def severity(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "critical").when(confidence >= 0.7, "high").when(confidence >= 0.5, "medium").when(confidence >= 0.3, "low").otherwise("info")


def title_case(threat: Column) -> Column:
    return F.initcap(F.replace(threat, F.lit("_"), F.lit(" ")))


def excluded_domains(questions: DataFrame, tunnels: DataFrame, by: Sequence[str] = (), table: DataFrame | None = None) -> DataFrame:
    """Domains whose names are not judged one by one: detected tunnels, and those with many distinct names.  ``table``: the rows of
    ``domains``, where they are at hand."""
    if table is None:
        named = questions.select(*by, "qname").distinct().withColumn("domain", second_level(F.col("qname")))
        table = named.groupBy(*by, "domain").agg(F.count("*").alias("distinct_names"))
    many = table.where(F.col("distinct_names") >= MANY_NAMES).select(*by, "domain")
    return tunnels.where("is_tunnel").select(*by, "domain").union(many).distinct()


def dga_candidates(questions: DataFrame, tunnels: DataFrame, by: Sequence[str] = (), excluded: DataFrame | None = None) -> DataFrame:
    """The first name of each label, outside the excluded domains, by arrival."""
    excluded = excluded_domains(questions, tunnels, by) if excluded is None else excluded
    rows = questions.withColumn("domain", second_level(F.col("qname"))).join(excluded, [*by, "domain"], "left_anti")
    rows = rows.withColumn("dedupe", heuristic_label(F.col("qname")))
    first = F.min_by(F.struct(*(c for c in rows.columns if c != "dedupe" and c not in by)), F.struct("frame_no", "qname"))  # reduced before it meets
    return rows.groupBy(*by, "dedupe").agg(first.alias("__first")).select(*by, "__first.*")


def alerts(packets: DataFrame, window_s: float = 30.0, questions: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """All alerts of a window of packets: branch, detector, threat, severity, confidence, flow_key, subject, title, seq, and evidence_key,
    the key of the first flow that the finding rests on (null for questions handed in without flows).

    With ``by``, columns of the packets such as a sensor and a window's number, every value is judged for itself, in one plan, and the alerts
    carry these columns.  The four branches read the flows and questions many times with different columns, which would scan and shuffle the
    packets as often; so flows, questions, domains and those excluded are written once to the shared folder.  Of the excluded ones the planner then
    knows the size: few are sent to the questions, which stay in place.
    """
    by = list(by)
    table = written(flows(packets, by).drop("flow_key"), "flows").withColumn("flow_key", flow_key())
    questions = dns_questions(packets, by) if questions is None else questions
    questions = written(questions, "questions")
    lit = F.lit
    floods = flood_findings(table, by=by)
    beacons = score_beacons(table, by).where("is_beacon")
    named = written(domains(questions, by), "domains")
    tunnels = scored(named, window_s)
    excluded = written(excluded_domains(questions, tunnels, by, named), "excluded")
    names = score_names(dga_candidates(questions.drop("ts", "qtype"), tunnels, by, excluded)).where("is_dga")
    if "flow_key" not in names.columns:
        names = names.withColumn("flow_key", F.lit(None).cast("string"))
    found = tunnels.where("is_tunnel")

    def branch(rows: DataFrame, number: int, detector: str, threat: Column, confidence: Column, key: Column, subject: Column, seq: Column, title: Column) -> DataFrame:
        named = {"branch": lit(number), "detector": lit(detector), "threat": threat, "confidence": F.round(confidence, 4), "flow_key": key, "subject": subject, "seq": seq.cast("long"), "title": title, "evidence_key": F.col("flow_key")}
        return rows.select(*by, *(c.alias(n) for n, c in named.items()))

    rows = [
        branch(floods, 1, "floods", F.col("threat"), F.col("confidence"), F.concat(lit("*->"), "dst_ip"), F.col("dst_ip"), F.col("flow_seq") * 8 + F.col("ordinal"), F.concat(title_case(F.col("threat")), lit(" against "), "dst_ip")),
        branch(beacons, 2, "beaconing", lit("c2_beaconing"), F.col("confidence"), F.concat("src_ip", lit("->"), "dst_ip"), F.col("src_ip"), F.col("flow_seq"), F.concat(lit("C2 beacon "), "src_ip", lit(" -> "), "dst_ip")),
        branch(found, 3, "dns_tunnel", lit("dns_tunnelling"), F.col("confidence"), F.concat(lit("*->"), "domain"), F.col("domain"), F.col("first"), F.concat(lit("DNS tunnel over "), "domain", lit(": ~"), F.col("uplink_bytes").cast("string"), lit(" B uplink encoded"))),
        branch(names, 4, "dga", lit("dga_domain"), F.col("prob"), F.concat("src_ip", lit("->"), "dst_ip"), F.col("qname"), F.col("frame_no"), F.concat(lit("DGA domain observed: "), "qname", lit(" ("), "family", lit(")"))),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.withColumn("severity", severity(F.col("confidence")))


def packet_hashes(rows: DataFrame, key: str = "flow_key", packets: str = "packets", most: int = 64) -> DataFrame:
    """Adds the hashes that stand for a flow's packets: sha256 of ``key:i`` for the first 64."""
    ids = F.sequence(F.lit(0), F.greatest(F.least(F.col(packets), F.lit(most)).cast("int") - 1, F.lit(0)))
    hashes = F.transform(ids, lambda i: F.sha2(F.concat(F.col(key), F.lit(":"), i.cast("string")), 256))
    return rows.withColumn("packet_hashes", F.when(F.col(packets) > 0, hashes).otherwise(F.array().cast("array<string>")))


def ranked(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """By falling confidence, ties in branch and arrival order."""
    out = rows.orderBy(F.desc("confidence"), "branch", "seq")
    return out.limit(limit) if limit else out


def numbered(rows: DataFrame, prefix: str, order: list[str]) -> DataFrame:
    """Adds number and id (PREFIX0001 ...) in order."""
    rows = positions(rows, [], order, "__n").withColumn("number", F.col("__n") + 1).drop("__n")
    text = F.col("number").cast("string")
    return rows.withColumn("id", F.concat(F.lit(prefix), F.when(F.length(text) < 4, F.lpad(text, 4, "0")).otherwise(text)))
