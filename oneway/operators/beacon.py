"""Periodic channels.

Guards run before the periodogram, which is the one step that built-ins serve badly (events times 4000 periods): it is an Arrow kernel
over the events of many channels.  Most periods are ruled out by a series, or by single precision, with a known bound of the error; those
that may be the strongest are evaluated in full.  A channel with more than ``SLICE`` events would make its own task long, so the
periodogram of such a channel is summed over slices of its events: sums of cosines and sines add up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from oneway.operators.shared import written

MIN_EVENTS, N_PERIODS = 8, 4000
P_MIN, P_MAX = 0.5, 3600.0
SCORE, MAX_FAP, MIN_CYCLES = 0.62, 0.01, 4.0
BENIGN_PORTS = (53, 123, 323)
#: Events of a channel that one task handles at a time.
SLICE = 50_000


def channels(flows: DataFrame, min_events: int = MIN_EVENTS) -> DataFrame:
    """Channels (src, dst) with enough flows that do not mostly go to services which are periodic by design."""
    rows = flows.groupBy("src_ip", "dst_ip").agg(F.count("*").alias("n"), F.count_if(F.col("dst_port").isin(*BENIGN_PORTS)).alias("benign"), F.min("flow_seq").alias("flow_seq"))
    return rows.where((F.col("n") >= min_events) & (F.col("benign") / F.col("n") <= 0.5))


def channel_events(flows: DataFrame) -> DataFrame:
    """(src_ip, dst_ip, t, size) of the channels that pass the guards."""
    return flows.join(channels(flows).select("src_ip", "dst_ip"), ["src_ip", "dst_ip"], "left_semi").select("src_ip", "dst_ip", F.col("start_ts").alias("t"), F.col("bytes").alias("size"))


CHANNEL = ("src_ip", "dst_ip")


def robust_cv(events: DataFrame, key: Sequence[str] = CHANNEL) -> DataFrame:
    """1.4826 MAD / median of the positive gaps of each channel; 1 where there is none or the median is not positive."""
    gaps = events.withColumn("gap", F.col("t") - F.lag("t").over(W.partitionBy(*key).orderBy("t"))).where("gap > 0")
    mid = gaps.groupBy(*key).agg(F.median("gap").alias("median_gap"))
    mad = gaps.join(mid, list(key)).groupBy(*key).agg(F.first("median_gap").alias("median_gap"), F.median(F.abs(F.col("gap") - F.col("median_gap"))).alias("mad"))
    return mad.select(*key, "median_gap", F.coalesce(F.try_divide(1.4826 * F.col("mad"), "median_gap"), F.lit(1.0)).alias("robust_cv"))


def period_range(span: float, n: int, p_min: float = P_MIN, p_max: float = P_MAX) -> tuple[float, float]:
    return max(p_min, span / n / 4), min(p_max, span / 2)


def resultant(t: np.ndarray, lo: float, hi: float, which: np.ndarray | None = None, n_periods: int = N_PERIODS) -> tuple[np.ndarray, np.ndarray]:
    """Sums of cosines and sines of the events' phases for log-spaced periods, or for ``which`` of them."""
    periods = lo * (hi / lo) ** ((np.arange(n_periods) if which is None else which) / (n_periods - 1))
    c, s = np.empty(len(periods)), np.empty(len(periods))
    for at in range(0, len(periods), 500):
        angle = (2 * np.pi / periods[at : at + 500])[:, None] * t[None, :]
        c[at : at + 500], s[at : at + 500] = np.cos(angle).sum(axis=1), np.sin(angle).sum(axis=1)
    return c, s


#: Radians from a node within which phases are expanded, and terms of the expansion.
REACH, TERMS = 1.0, 8
FACTORS = np.array([1j**k / math.factorial(k) for k in range(TERMS)])


#: What single precision adds to the error of a resultant, at most, for each event (turns are reduced in double precision before), and the
#: largest phase of which that holds.
SINGLE_ERROR, MOST_RADIANS = 1e-5, 1e8
#: Phases that are held at a time.
BLOCK = 1 << 16


def near_strongest_single(t: np.ndarray, lo: float, hi: float, n_periods: int = N_PERIODS) -> np.ndarray:
    """As ``near_strongest``, for any number of events: all but the periods that sums in single precision rule out."""
    if not 2 * np.pi / lo * np.abs(t).max() <= MOST_RADIANS:
        return np.arange(n_periods)
    frequencies = 1 / (lo * (hi / lo) ** (np.arange(n_periods) / (n_periods - 1)))
    r, step = np.empty(n_periods), max(1, BLOCK // len(t))
    for at in range(0, n_periods, step):
        turns = frequencies[at : at + step, None] * t[None, :]
        turns -= np.rint(turns)
        angle = turns.astype(np.float32) * np.float32(2 * np.pi)
        r[at : at + step] = np.hypot(np.cos(angle).sum(axis=1), np.sin(angle).sum(axis=1))
    return np.flatnonzero(r >= r.max() - 2 * len(t) * SINGLE_ERROR)


def near_strongest(t: np.ndarray, lo: float, hi: float, n_periods: int = N_PERIODS) -> np.ndarray:
    """Numbers of the periods that may have the largest resultant: all but those that a Taylor series of the events' phases rules out, and all where
    it would need too many terms.

    Phases are expanded about evenly spaced frequencies (nodes); what the series leaves off is at most REACH^TERMS / TERMS! for each event.  A node's
    periods are looked at only if the sum of its terms' sizes comes up to the strongest period of the node that promises most."""
    half, top, low = (t.max() - t.min()) / 2, 2 * np.pi / lo, 2 * np.pi / hi
    if not 0 < half < np.inf or (top - low) * half > REACH * n_periods / 2:
        return np.arange(n_periods)
    x, width = t - (t.max() + t.min()) / 2, 2 * REACH / half
    nodes = np.arange(np.rint(low / width), np.rint(top / width) + 1)
    turns = np.empty((len(nodes), len(x)), complex)
    turns[0], turns[1:] = np.exp(1j * nodes[0] * width * x), np.exp(1j * width * x)
    powers = np.ones((TERMS, len(x)))
    powers[1:] = REACH * x / half
    series = (np.cumprod(powers, axis=0) * FACTORS[:, None]) @ np.cumprod(turns, axis=0).T
    sizes = np.abs(series)
    # frequencies fall with the number of the period: those of node j are begin[j + 1] to begin[j] - 1
    edges = np.maximum((np.append(nodes, nodes[-1] + 1) - 0.5) * width, low / 2)
    begin = np.clip(np.ceil((n_periods - 1) * np.log(top / edges) / np.log(hi / lo)), 0, n_periods).astype(np.int64)
    begin[0], begin[-1] = n_periods, 0
    many = begin[:-1] - begin[1:]

    def strength(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The periods of some nodes, and their resultants by the series."""
        node, size = np.repeat(at, many[at]), many[at]
        which = np.arange(len(node)) + np.repeat(begin[at + 1] - (np.cumsum(size) - size), size)
        away = (2 * np.pi / (lo * (hi / lo) ** (which / (n_periods - 1))) - nodes[node] * width) * half / REACH
        terms = series[:, node]
        z = terms[-1]
        for term in terms[-2::-1]:
            z = z * away + term
        return which, np.abs(z)

    slack = 2 * len(t) * (REACH**TERMS / math.factorial(TERMS) + 1e-9)
    first = np.argmax(np.where(many > 0, sizes[0], -1.0))
    least = strength(np.array([first]))[1].max() - slack
    which, r = strength(np.flatnonzero(sizes.sum(axis=0) >= least))
    return np.sort(which[r >= r.max() - slack])


def candidates(t: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """Numbers of the periods that are to be evaluated in full."""
    which = near_strongest(t, lo, hi)
    return which if len(which) < N_PERIODS else near_strongest_single(t, lo, hi)


def _median(values: np.ndarray) -> float:
    own = np.sort(values)
    return float((own[(len(own) - 1) // 2] + own[len(own) // 2]) / 2)


def channel_name(key: Sequence[str]) -> Column:
    """One text for a key; no two keys give one."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]
    return F.concat(*(x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p)))


def rayleigh(events: DataFrame, key: Sequence[str] = CHANNEL) -> DataFrame:
    """best_r, period, fap and cycles of each channel with a usable range of periods."""
    key = list(key)
    stats = events.groupBy(*key).agg(F.min("t").alias("t0"), (F.max("t") - F.min("t")).alias("span"), F.count("*").alias("n"))
    lo, hi = F.greatest(F.lit(P_MIN), F.col("span") / F.col("n") / 4), F.least(F.lit(P_MAX), F.col("span") / 2)
    stats = stats.withColumns({"lo": lo, "hi": hi}).where("span > 0 and hi > lo")
    slices = F.greatest(F.lit(1), F.ceil(F.col("n") / SLICE)).cast("int")
    stats = stats.withColumn("slices", slices)
    # few rows and much work per channel: spread over all partitions rather than gathered by size
    tasks = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = ["best_r", "period", "fap", "cycles"]
    usual = events.join(stats.where("slices = 1"), key).select(channel_name(key).alias("__channel"), *key, "t", "n", "t0", "span")
    named, typed = ", ".join(f"{k} {events.schema[k].dataType.simpleString()}" for k in key), ", ".join(f"{k} double" for k in found)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return measures(batches, key, found, "__channel")

    done = usual.repartition(tasks, "__channel").sortWithinPartitions("__channel", "t").mapInArrow(whole, f"{named}, {typed}")
    sliced = events.join(stats.where("slices > 1"), key).withColumn("slice", F.pmod(F.xxhash64("t", "size"), "slices"))
    ends = ("n", "lo", "hi", "span")

    def part(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame.iloc[0]
        c, s = resultant(frame["t"].to_numpy() - first["t0"], first["lo"], first["hi"])
        return pd.DataFrame({**{k: [first[k]] for k in (*key, *ends)}, "c": [c], "s": [s]})

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame.iloc[0]
        told = _spectrum(np.sum(list(frame["c"]), axis=0), np.sum(list(frame["s"]), axis=0), first["n"], first["lo"], first["hi"], first["span"])
        return pd.DataFrame({k: [first[k]] for k in key} | {k: [v] for k, v in zip(found, told)})

    parts = sliced.repartition(tasks, *key, "slice").groupBy(*key, "slice").applyInPandas(part, f"{named}, n long, lo double, hi double, span double, c array<double>, s array<double>")
    return done.unionByName(parts.groupBy(*key).applyInPandas(total, f"{named}, {typed}"))


def sizes(events: DataFrame) -> DataFrame:
    """1 - min(1, deviation / mean) of the flow sizes; 0.5 where the mean is 0."""
    rows = events.groupBy("src_ip", "dst_ip").agg(F.count("*").alias("n"), F.stddev_pop("size").alias("sd"), F.avg("size").alias("mean"))
    return rows.select("src_ip", "dst_ip", "n", F.when(F.col("mean") > 0, 1 - F.least(F.lit(1.0), F.col("sd") / F.col("mean"))).otherwise(0.5).alias("size_regularity"))


def channel_table(flows: DataFrame, min_events: int = MIN_EVENTS, by: Sequence[str] = ()) -> DataFrame:
    """One row per guarded channel with all that is a plain aggregate of its flows: n, first flow, times and size regularity."""
    rows = flows if "flow_key" in flows.columns else flows.withColumn("flow_key", F.lit(None).cast("string"))
    rows = rows.groupBy(*by, "src_ip", "dst_ip").agg(
        F.count("*").alias("n"), F.count_if(F.col("dst_port").isin(*BENIGN_PORTS)).alias("benign"), F.min("flow_seq").alias("flow_seq"), F.min_by("flow_key", "flow_seq").alias("flow_key"),
        F.min("start_ts").alias("t0"), (F.max("start_ts") - F.min("start_ts")).alias("span"), F.stddev_pop("bytes").alias("sd"), F.avg("bytes").alias("mean"),
    )
    rows = rows.where((F.col("n") >= min_events) & (F.col("benign") / F.col("n") <= 0.5))
    return rows.withColumn("size_regularity", F.when(F.col("mean") > 0, 1 - F.least(F.lit(1.0), F.col("sd") / F.col("mean"))).otherwise(0.5)).drop("benign", "sd", "mean")


def _spectrum(c: np.ndarray, s: np.ndarray, n: int, lo: float, hi: float, span: float, which: np.ndarray | None = None) -> tuple[float, float, float, float]:
    """best_r, period, fap and cycles, from the resultants of all periods or of ``which``."""
    r = np.hypot(c, s) / n
    at = int(np.argmax(r))
    period = lo * (hi / lo) ** ((at if which is None else int(which[at])) / (N_PERIODS - 1))
    trials = max(1.0, (1 / lo - 1 / hi) * span)
    return float(r[at]), period, float(min(1.0, trials * np.exp(-n * r[at] ** 2))), span / period


_MEASURES = "channel string, robust_cv double, best_r double, period double, fap double, cycles double"


def measures(batches: Iterator[pa.RecordBatch], key: Sequence[str] = ("channel",), found: Sequence[str] = ("robust_cv", "best_r", "period", "fap", "cycles"), channel: str = "channel") -> Iterator[pa.RecordBatch]:
    """``found`` of gaps and spectrum of whole channels, whose events come sorted by ``channel`` and time: many channels in one Arrow call.  Rows carry the
    columns of ``key``."""
    rest = None

    def told(table: pa.Table) -> Iterator[pa.RecordBatch]:
        code = table.column(channel).combine_chunks().dictionary_encode().indices.to_numpy()
        at = np.flatnonzero(np.diff(code, prepend=code[0] - 1))
        t = table.column("t").to_numpy()
        ends = {c: table.column(c).to_numpy()[at] for c in ("n", "t0", "span")}
        out: dict[str, list] = {c: [] for c in found}
        for i, (lo_at, hi_at) in enumerate(zip(at, np.append(at[1:], len(t)))):
            own, n, t0, span = t[lo_at:hi_at], int(ends["n"][i]), float(ends["t0"][i]), float(ends["span"][i])
            row: dict[str, float | None] = {"best_r": 0.0, "period": None, "fap": 1.0, "cycles": 0.0}
            if "robust_cv" in found:
                gaps = np.diff(own)
                gaps = gaps[gaps > 0]
                middle = _median(gaps) if len(gaps) else 0.0
                row["robust_cv"] = 1.4826 * _median(np.abs(gaps - middle)) / middle if middle > 0 else 1.0
            if span > 0:
                lo, hi = period_range(span, n)
                if hi > lo:
                    which = candidates(own - t0, lo, hi)
                    row |= zip(("best_r", "period", "fap", "cycles"), _spectrum(*resultant(own - t0, lo, hi, which), n, lo, hi, span, which))
            for c in found:
                out[c].append(row[c])
        columns = [table.column(c).combine_chunks().take(pa.array(at)) for c in key]
        yield pa.record_batch([*columns, *(pa.array(out[c], pa.float64()) for c in found)], names=[*key, *found])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        own = table.column(channel).combine_chunks().dictionary_encode().indices.to_numpy()
        last = int(np.flatnonzero(own == own[-1])[0])  # sorted, so a channel's rows are together
        rest = table.slice(last)
        if last:
            yield from told(table.slice(0, last))
    if rest is not None and rest.num_rows:
        yield from told(rest)


def score_beacons(flows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per guarded channel (of each value of ``by``): score, gate and confidence.

    One aggregate of the flows gives all plain numbers; one exchange brings ordinary channels' events to the kernel for gaps and spectrum.
    Channels of more than ``SLICE`` events take the way in slices, with medians by windows.
    """
    key = [*by, *CHANNEL]
    channel = channel_name(key)
    table = written(channel_table(flows, by=by).withColumn("channel", channel), "channels")  # three joins read it with different columns
    tasks = int(flows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    events = flows.select(*key, channel.alias("channel"), F.col("start_ts").alias("t"), F.col("bytes").alias("size"))
    # few rows and much work per channel: spread over more partitions than the join's, in whose place none could be gathered by size
    usual = events.select("channel", "t").join(table.where(F.col("n") <= SLICE).select("channel", "n", "t0", "span"), "channel")
    usual = usual.repartition(2 * tasks, "channel").sortWithinPartitions("channel", "t").mapInArrow(measures, _MEASURES)
    # one in SLICE flows at most has such a channel, so the channels are sent to the flows
    long = events.join(F.broadcast(table.where(F.col("n") > SLICE).select("channel")), "channel", "left_semi").drop(*key)
    long = robust_cv(long, ["channel"]).join(rayleigh(long, ["channel"]), "channel", "full").select("channel", "robust_cv", "best_r", "period", "fap", "cycles")
    rows = table.join(usual.unionByName(long), "channel", "left").drop("channel")
    rows = rows.withColumns({"robust_cv": F.coalesce("robust_cv", F.lit(1.0)), "best_r": F.coalesce("best_r", F.lit(0.0)), "fap": F.coalesce("fap", F.lit(1.0)), "cycles": F.coalesce("cycles", F.lit(0.0))})
    regular = 1 - F.least(F.lit(1.0), F.col("robust_cv"))
    score = 0.42 * F.col("best_r") + 0.28 * (1 - F.col("fap")) + 0.18 * regular + 0.12 * F.col("size_regularity")
    rows = rows.withColumn("score", score)
    is_beacon = (F.col("fap") < MAX_FAP) & (F.col("cycles") >= MIN_CYCLES) & (F.col("score") >= SCORE)
    return rows.withColumns({"is_beacon": is_beacon, "confidence": F.when(is_beacon, F.col("score") * F.least(F.lit(1.0), F.col("cycles") / 8)).otherwise(F.col("score") * 0.4), "jitter_pct": F.round(100 * F.col("robust_cv"), 1)})
