"""Traffic profiles: totals, rates and gap-free rate buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oneway.operators.flows import ratio


def profile(packets: DataFrame, by: list[str] | None = None, malformed: int = 0, unsupported: int = 0) -> DataFrame:
    """Totals, counts per protocol, distinct addresses, first- and last-seen times and rates, for each group of ``by``.

    Distinct addresses are counted in two levels (per address, then in total), so no task holds a set of them.
    """
    by = by or []
    dns = (F.col("dns_qname").isNotNull()) | (F.col("src_port") == 53) | (F.col("dst_port") == 53)
    base = packets.groupBy(*by).agg(
        F.count("*").alias("packets"), F.coalesce(F.sum(F.col("length").cast("long")), F.lit(0)).alias("bytes"), F.count_if(F.upper("proto") == "TCP").alias("tcp"), F.count_if(F.upper("proto") == "UDP").alias("udp"),
        F.count_if(~F.upper("proto").isin("TCP", "UDP")).alias("other"), F.count_if(dns).alias("dns"), F.min_by("ts", "frame_no").alias("first_ts"), F.max_by("ts", "frame_no").alias("last_ts"),
    )
    for side in ("src", "dst"):
        n = packets.select(*by, f"{side}_ip").distinct().groupBy(*by).agg(F.count(f"{side}_ip").alias(f"{side}_ips"))
        base = base.join(n, by) if by else base.join(n, F.lit(True))
    base = base.withColumn("duration", F.greatest(F.lit(0.0), F.coalesce(F.col("last_ts") - F.col("first_ts"), F.lit(0.0))))
    span = F.when(F.col("duration") > 0, F.col("duration"))
    seen = F.col("packets") + malformed + unsupported
    return base.withColumns({"packets_per_s": ratio("packets", span), "bytes_per_s": ratio("bytes", span), "mean_size": ratio("bytes", "packets"), "quality_pct": 100 * ratio("packets", F.when(seen > 0, seen))})


def rate_buckets(packets: DataFrame, width: float = 1.0) -> DataFrame:
    """Packets and bytes per bucket of ``width`` seconds since the first-seen packet, empty buckets included; rates are per second
    whatever the width."""
    if width <= 0:
        raise ValueError("bucket width must be positive")
    first = packets.agg(F.min_by("ts", "frame_no").alias("first"))
    rows = packets.join(F.broadcast(first), F.lit(True)).withColumn("bucket", F.floor(F.greatest(F.lit(0.0), F.col("ts") - F.col("first")) / width))
    found = rows.groupBy("bucket").agg(F.count("*").alias("packets"), F.sum(F.col("length").cast("long")).alias("bytes"))
    # sequences are cut in runs so that a long capture's buckets are made by many tasks
    runs = found.agg(F.max("bucket").alias("top")).where("top is not null").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("top").cast("long"), F.lit(100_000).cast("long"))).alias("lo"), "top")
    every = runs.select(F.explode(F.sequence("lo", F.least(F.col("lo") + 99_999, F.col("top")))).alias("bucket"))
    rows = every.join(found, "bucket", "left")
    rows = rows.select("bucket", (F.col("bucket") * width).alias("start_s"), F.coalesce("packets", F.lit(0)).alias("packets"), F.coalesce("bytes", F.lit(0)).alias("bytes"))
    return rows.withColumns({"packets_per_s": F.col("packets") / width, "bytes_per_s": F.col("bytes") / width})


def compare(captures: dict[str, DataFrame]) -> DataFrame:
    """One profile row per named capture."""
    out = None
    for name, packets in captures.items():
        rows = packets.withColumn("scenario", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return profile(out, ["scenario"])


def with_quality(profiles: DataFrame, counts: DataFrame, by: str = "scenario") -> DataFrame:
    """Profiles with malformed and unsupported frames as counted (by name), and the share of packets in all frames."""
    seen = F.col("packets") + F.col("malformed") + F.col("unsupported")
    return profiles.drop("quality_pct").join(counts, by).withColumn("quality_pct", 100 * ratio("packets", F.when(seen > 0, seen)))
