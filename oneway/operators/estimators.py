"""Half-flow estimators: what one direction tells about the other.  All are projections over flow columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oneway.operators.flows import HALF32, MOD32, flows_with_samples, folded_acks, ratio

# Mean and deviation of the ratio of return bytes to observed bytes, by protocol and role.
RETURN_RATIO = {
    ("TCP", "client"): (6.0, 5.0),
    ("TCP", "server"): (0.18, 0.15),
    ("TCP", "unknown"): (1.0, 2.0),
    ("UDP", "client"): (2.5, 3.0),
    ("UDP", "server"): (0.5, 0.6),
    ("UDP", "unknown"): (1.0, 2.0),
}
WELL_KNOWN = 1024


def role() -> Column:
    """Which side the observed sender is."""
    return (
        F.when((F.col("synack") > 0) & (F.col("syn") == 0), "server")
        .when((F.col("dst_port") <= WELL_KNOWN) & (F.col("src_port") > WELL_KNOWN), "client")
        .when((F.col("src_port") <= WELL_KNOWN) & (F.col("dst_port") > WELL_KNOWN), "server")
        .when(F.col("syn") > F.col("synack"), "client")
        .otherwise("unknown")
    )


def prior(which: int) -> Column:
    """Mean (0) or deviation (1) of the return ratio; null for protocols without a prior."""
    out = F.lit(None).cast("double")
    for (proto, side), values in RETURN_RATIO.items():
        out = F.when((F.col("proto") == proto) & (F.col("role") == side), F.lit(values[which])).otherwise(out)
    return out


def half_open_ratio() -> Column:
    """Share of SYNs without a sign of completion; 0 without SYNs."""
    syns = F.col("syn") + F.col("synack")
    done = F.least(syns, F.col("fin") + F.col("rst")) + F.when((F.col("psh") > 0) | (F.col("bytes") > 100 * syns), 1).otherwise(0)
    return F.when(syns > 0, F.greatest(F.lit(0.0), 1 - done / syns)).otherwise(F.lit(0.0))


def clock(samples: str) -> Column:
    """hz and r2 of a sender's timestamp clock from (ts, val) samples, as a struct.

    Samples are sorted by (ts, val); those that step back modulo 2**32 are stale and dropped; kept steps add up to the
    unwrapped series, and its moments are updated in the same fold.  Under 4 samples, before or after, there is no clock.
    hz is the slope if positive; r2 of a constant series is 0.
    """
    none = F.struct(F.lit(None).cast("double").alias("hz"), F.lit(0.0).alias("r2"))
    rows = F.array_sort(samples)
    head = F.element_at(rows, 1)
    zero = [F.lit(0.0).alias(c) for c in ("my", "xx", "xy", "yy")]
    start = F.struct(head["val"].alias("last"), F.lit(0).cast("long").alias("y"), F.lit(1.0).alias("n"), head["ts"].alias("mx"), *zero)

    def step(s: Column, r: Column) -> Column:
        ahead = F.pmod(r["val"] - s["last"], F.lit(MOD32))
        y, n = s["y"] + ahead, s["n"] + 1
        dx, dy = r["ts"] - s["mx"], y.cast("double") - s["my"]
        mx, my = s["mx"] + dx / n, s["my"] + dy / n
        moved = F.struct(
            r["val"].alias("last"), y.alias("y"), n.alias("n"), mx.alias("mx"), my.alias("my"),
            (s["xx"] + dx * (r["ts"] - mx)).alias("xx"), (s["xy"] + dx * (y.cast("double") - my)).alias("xy"), (s["yy"] + dy * (y.cast("double") - my)).alias("yy"),
        )
        return F.when(ahead < HALF32, moved).otherwise(s)

    def done(s: Column) -> Column:
        slope = F.try_divide(s["xy"], s["xx"])
        r2 = F.coalesce(F.try_divide(s["xy"] * s["xy"], s["xx"] * s["yy"]), F.lit(0.0))
        return F.when(s["n"] < 4, none).otherwise(F.struct(F.when(slope > 0, slope).alias("hz"), F.greatest(F.lit(0.0), r2).alias("r2")))

    return F.when(F.size(samples) < 4, none).otherwise(F.aggregate(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), start, step, done))


def passive_rtt(arrivals: str, retransmits: Column) -> Column:
    """Milliseconds: the gap at the lower tenth of the positive gaps, under 3 s; needs retransmissions and 3 arrivals."""
    a = F.col(arrivals)
    gaps = F.transform(F.sequence(F.lit(1), F.greatest(F.size(a) - 1, F.lit(1))), lambda i: F.try_element_at(a, i + 1) - F.try_element_at(a, i))
    gaps = F.array_sort(F.filter(gaps, lambda g: g > 0))
    at = F.try_element_at(gaps, (F.floor(F.size(gaps) * 0.1) + 1).cast("int"))
    return F.when((retransmits > 0) & (F.size(a) >= 3) & (at <= 3), F.round(at * 1000, 2))


def liveness() -> Column:
    """How much a flow looks like a live TCP stack, 0 to 1; needs columns hz and r2."""
    tcp = F.when(F.col("hz").isNotNull() & (F.col("r2") > 0.9), 0.9 + 0.1 * F.least(F.lit(1.0), F.col("r2"))).when(F.col("tsval_samples") > 0, 0.5 * F.col("r2")).when(F.col("syn") + F.col("synack") > 0, 0.25).otherwise(0.6)
    return F.when(F.col("proto") == "TCP", F.greatest(F.lit(0.0), F.least(F.lit(1.0), tcp))).otherwise(F.lit(0.6))


def return_estimate(rows: DataFrame) -> DataFrame:
    """Bytes of the unseen direction: the prior, or acknowledged bytes where at least two ACKs were seen."""
    rows = rows.withColumns({"role": role()}).withColumns({"prior_mean": prior(0), "prior_std": prior(1)})
    by_prior = F.col("prior_mean") * F.col("bytes")
    spread = F.col("prior_std") * F.col("bytes")
    asym = F.when((F.col("proto") == "TCP") & (F.col("role") == "client") & (F.col("bytes") > 0), (1 - F.least(F.lit(1.0), ratio("ack", "packets"))) * F.col("prior_mean") / F.greatest(F.lit(1e-6), F.col("prior_std"))).otherwise(0.0)
    acked = (F.col("proto") == "TCP") & (F.col("ack_samples") >= 2) & (F.col("ack_total") > 0)
    unc = F.greatest(F.lit(0.02), 1 / F.sqrt(F.col("ack_samples").cast("double")))
    return rows.withColumns(
        {
            "asym_z": asym, "by_acks": F.coalesce(acked, F.lit(False)), "uncertainty": F.when(acked, unc),
            "reverse_bytes": F.when(acked, F.col("ack_total").cast("double")).otherwise(by_prior),
            "reverse_low": F.when(acked, F.col("ack_total") * (1 - unc)).otherwise(F.col("bytes") * F.greatest(F.lit(0.0), F.col("prior_mean") - F.col("prior_std"))),
            "reverse_high": F.when(acked, F.col("ack_total") * (1 + unc)).otherwise(by_prior + spread),
        }
    )


def estimate(packets: DataFrame) -> DataFrame:
    """Flows with every estimate: one aggregation of the packets and one projection."""
    rows = folded_acks(flows_with_samples(packets).drop("ack_samples")).withColumn("clock", clock("tsvals"))
    rows = rows.withColumns({"hz": F.col("clock.hz"), "r2": F.coalesce("clock.r2", F.lit(0.0)), "ack_total": F.coalesce("ack_total", F.lit(0))}).drop("acks", "tsvals", "clock")
    return return_estimate(rows).withColumns({"half_open": half_open_ratio(), "liveness": liveness()})


def feature_map(rows: DataFrame) -> DataFrame:
    """The estimates as one struct of rounded numbers."""
    names = {"half_open": 4, "liveness": 4, "r2": 4, "hz": 3, "reverse_bytes": 1, "reverse_low": 1, "reverse_high": 1, "asym_z": 4, "byte_rate": 3}
    return rows.withColumn("features", F.struct(*(F.round(n, d).alias(n) for n, d in names.items())))
