"""DNS tunnels, per second-level domain.  Questions stay exploded rows, so the work is linear in their number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oneway.functions.lexical import entropy, second_level, subdomain
from oneway.operators.floods import clip1
from oneway.operators.flows import ratio

# Question types that carry data.
EXOTIC = ("TXT", "NULL", "CNAME", "MX", "AAAA?")


def domains(questions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per second-level domain (of each value of ``by``).  Distinct subdomains and names are counted in two levels, per name then per domain, so a
    domain with most of the traffic is spread over its names.  Domain and subdomain follow from the name, so they are cut from distinct names; flow keys
    travel only where questions have them, since texts in an aggregate make it sort."""
    keyed = "flow_key" in questions.columns
    key = lambda order: [F.min_by("flow_key", order).alias("flow_key")] if keyed else []
    names = questions.groupBy(*by, "qname").agg(F.count("*").alias("n"), F.count_if(F.upper("qtype").isin(*EXOTIC)).alias("exotic"), F.min("frame_no").alias("first"), *key("frame_no"))
    names = names.withColumn("domain", second_level(F.col("qname")))
    names = names.withColumn("sub", subdomain(F.col("qname"), F.col("domain")))
    subs = names.groupBy(*by, "domain", "sub").agg(F.sum("n").alias("n"), F.sum("exotic").alias("exotic"), F.count("*").alias("names"), F.min("first").alias("first"), *key("first"))
    subs = subs.withColumns({"len": F.length("sub"), "ent": entropy(F.col("sub"))})
    some = F.col("sub") != ""
    rows = subs.groupBy(*by, "domain").agg(
        F.sum("n").alias("queries"), F.sum("exotic").alias("exotic"), F.sum("names").alias("distinct_names"), F.min("first").alias("first"), *key("first"),
        F.coalesce(F.sum(F.when(some, F.col("n"))), F.lit(0)).alias("with_sub"), F.count_if(some).alias("distinct_subs"),
        F.coalesce(F.sum(F.when(some, F.col("n") * F.col("len"))), F.lit(0)).alias("sub_chars"), F.coalesce(F.sum(F.when(some, F.col("n") * F.col("ent"))), F.lit(0.0)).alias("sub_bits"),
    )
    return rows if keyed else rows.withColumn("flow_key", F.lit(None).cast("string"))


def score_tunnels(questions: DataFrame, window_s: float = 30.0, threshold: float = 0.6, min_queries: int = 15, by: Sequence[str] = ()) -> DataFrame:
    """Domains with enough questions: features, score, gate, confidence and the bytes that the names could carry."""
    return scored(domains(questions, by), window_s, threshold, min_queries)


def scored(table: DataFrame, window_s: float = 30.0, threshold: float = 0.6, min_queries: int = 15) -> DataFrame:
    """As ``score_tunnels``, of the rows of ``domains``."""
    rows = table.where(F.col("queries") >= min_queries)
    rows = rows.withColumns(
        {
            "mean_len": ratio("sub_chars", "with_sub"), "mean_entropy": ratio("sub_bits", "with_sub"), "unique_ratio": ratio("distinct_subs", "with_sub"),
            "exotic_ratio": ratio("exotic", "queries"), "rate": F.col("queries") / F.lit(float(window_s)) if window_s > 0 else F.lit(0.0),
        }
    )
    score = (
        0.20 * clip1(F.col("mean_len") / 40) + 0.12 * clip1(F.greatest(F.lit(0.0), (F.col("mean_entropy") - 2.8) / 1.5)) + 0.24 * clip1(F.col("unique_ratio") / 0.6)
        + 0.18 * F.col("exotic_ratio") + 0.10 * clip1(F.col("rate") / 20) + 0.16 * clip1(F.col("queries") / 300)
    )
    rows = rows.withColumn("raw", score)
    fires = (F.col("raw") >= threshold) & (F.col("mean_len") > 15)
    return rows.withColumns({"is_tunnel": fires, "score": F.round("raw", 4), "confidence": F.round(F.when(fires, F.col("raw")).otherwise(F.col("raw") * 0.6), 4), "uplink_bytes": F.floor(F.col("sub_chars") * 0.6)}).drop("raw")
