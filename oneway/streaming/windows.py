"""The detectors on streams.

Aligned mode (the default at scale): tumbling event-time windows with a watermark; flow state is partial aggregates and is dropped when a
window closes.  Exact mode has the unaligned windows, where a window opens at the packet that overflowed the last one; that rule
is sequential per sensor, so it is a fold per sensor on tables, and a state of two numbers with a timer per sensor on streams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from oneway.operators.beacon import score_beacons
from oneway.operators.flows import counters, derived
from oneway.schema import FLOW_KEY, PACKET

#: Latest flow starts that a channel keeps.
CHANNEL_EVENTS = 256


def windowed_flows(packets: DataFrame, window_s: int = 60, late_s: int = 60) -> DataFrame:
    """Flows per aligned window; packets later than ``late_s`` are dropped."""
    rows = packets.withColumn("event_time", F.timestamp_micros((F.col("ts") * 1_000_000).cast("long"))).withWatermark("event_time", f"{late_s} seconds")
    flows = rows.groupBy(F.window("event_time", f"{window_s} seconds").alias("window"), *FLOW_KEY).agg(*counters())
    return derived(flows)


def unaligned_windows(packets: DataFrame, window_s: float, by: str = "sensor_id") -> DataFrame:
    """Adds window_no and window_start: a packet at or past the end of the running window opens the next at its own time.

    A fold over each sensor's packets in arrival order, carrying two numbers; packets come sorted from the shuffle.  Within a batch
    the fold goes from window to window, by searches in the running maximum of the times.
    """
    columns = packets.schema.names

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, no, start = None, -1, None  # the running window
        for batch in batches:
            sensors = batch.column(by).dictionary_encode()
            codes = sensors.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            ts = batch.column("ts").to_numpy(zero_copy_only=False)
            out_no, out_start = np.empty(len(ts), np.int64), np.empty(len(ts))
            cut = np.flatnonzero(np.diff(codes, prepend=codes[0] - 1)) if len(codes) else codes
            for lo, hi in zip(cut, np.append(cut[1:], len(ts))):
                sensor = sensors.dictionary[int(codes[lo])].as_py() if codes[lo] >= 0 else None
                if no < 0 or sensor != own:
                    own, no, start = sensor, 0, float(ts[lo])
                top, at = np.maximum.accumulate(ts[lo:hi]), 0
                while at < hi - lo:
                    end = int(np.searchsorted(top, start + window_s))  # the first packet that the window does not hold
                    while end < hi - lo and ts[lo + end] - start < window_s:
                        end += 1
                    end = max(end, at)
                    out_no[lo + at : lo + end], out_start[lo + at : lo + end] = no, start
                    if end < hi - lo:
                        no, start = no + 1, float(ts[lo + end])
                    at = end
            yield pa.record_batch([*batch.columns, pa.array(out_no), pa.array(out_start)], names=[*batch.schema.names, "window_no", "window_start"])

    schema = StructType([*packets.schema.fields, StructField("window_no", LongType()), StructField("window_start", DoubleType())])
    return packets.select(columns).repartition(by).sortWithinPartitions(by, "frame_no").mapInArrow(assign, schema)


def first_alerts(alerts: DataFrame, horizon: str = "1 hour", order: str = "seq") -> DataFrame:
    """One alert per threat and flow key.  On a stream (needs event_time): the first to arrive within the watermark's horizon.  On a table:
    the first in order."""
    key = ["threat", "flow_key"]
    if alerts.isStreaming:
        return alerts.withWatermark("event_time", horizon).dropDuplicatesWithinWatermark(key)
    return alerts.groupBy(*key).agg(F.min_by(F.struct(*alerts.columns), order).alias("a")).select("a.*")


CHANNEL = "src_ip string, dst_ip string, n long, last_ts double"
_EVENT = "t double, size long, dst_port int"


class Channels(StatefulProcessor):
    """The latest CHANNEL_EVENTS flow starts of a channel, with sizes and ports."""

    def __init__(self, ttl_s: int):
        self.ttl_s = ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", _EVENT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.events.get()) if self.events.exists() else []
        for frame in rows:
            held += list(zip(frame["start_ts"].tolist(), frame["bytes"].tolist(), frame["dst_port"].tolist()))
        held = sorted(held)[-CHANNEL_EVENTS:]
        self.events.put(held)
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        self.handle.registerTimer(int((held[-1][0] + self.ttl_s) * 1000))
        yield pd.DataFrame({"src_ip": [key[0]], "dst_ip": [key[1]], "n": [len(held)], "last_ts": [held[-1][0]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.events.clear()
        yield pd.DataFrame({"src_ip": [key[0]], "dst_ip": [key[1]], "n": [0], "last_ts": [None]}).astype({"last_ts": "float64"})

    def close(self) -> None:
        pass


def channel_series(flows: DataFrame, ttl_s: int = 7200, late_s: int = 3600) -> DataFrame:
    """Stateful: the latest starts of each channel that is not DNS, kept per channel until the watermark is ``ttl_s`` past the last, so a new channel
    never stops the others; each batch tells how many each of its channels has.  ``closing_beacons`` reads the state itself."""
    rows = flows.where("dst_port <> 53").select("src_ip", "dst_ip", "start_ts", "bytes", "dst_port")
    rows = rows.withColumn("event_time", F.timestamp_micros((F.col("start_ts") * 1_000_000).cast("long"))).withWatermark("event_time", f"{late_s} seconds")
    return rows.groupBy("src_ip", "dst_ip").transformWithStateInPandas(Channels(ttl_s), CHANNEL, "update", "EventTime")


def channel_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The channels' starts as flows, read from the state that a query over ``channel_series`` left at its checkpoint."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "events").load()
    event = F.col("list_element.value") if "value" in state.select("list_element.*").columns else F.col("list_element")
    rows = state.select(F.col("key.src_ip").alias("src_ip"), F.col("key.dst_ip").alias("dst_ip"), event.alias("e"))
    rows = rows.select("src_ip", "dst_ip", F.col("e.t").alias("start_ts"), F.col("e.size").alias("bytes"), F.col("e.dst_port").alias("dst_port"))
    return rows.withColumn("flow_seq", F.floor(F.col("start_ts") * 1_000_000))


def closing_beacons(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The closing pass over the state of all channels, with the same guards as a single run."""
    return score_beacons(channel_state(spark, checkpoint)).where("is_beacon")


class Windows(StatefulProcessor):
    """The running window of a sensor: its number, when it began, and its latest packet."""

    def __init__(self, window_s: float, columns: list[str]):
        self.window_s, self.columns = window_s, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("window", "no long, start double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True).sort_values("frame_no", ignore_index=True)
        ts = frame["ts"].to_numpy()
        no, start = self.state.get() if self.state.exists() else (0, float(ts[0]))
        shut, numbers, starts = [], np.empty(len(ts), np.int64), np.empty(len(ts))
        for i, t in enumerate(ts.tolist()):
            if t - start >= self.window_s:
                shut.append((no, start))
                no, start = no + 1, t
            numbers[i], starts[i] = no, start
        self.state.update((no, start))
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        self.handle.registerTimer(int((start + self.window_s) * 1000))
        yield self._rows(frame[self.columns].assign(window_no=numbers, window_start=starts, closed=False))
        if shut:
            yield self._closed(key, shut)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The watermark has passed the window's end: nothing can fall in it any more."""
        if self.state.exists():
            yield self._closed(key, [self.state.get()])

    def _closed(self, key, windows: list[tuple]) -> pd.DataFrame:
        rows = pd.DataFrame({c: [None] * len(windows) for c in self.columns})
        rows["sensor_id"] = key[0]
        return self._rows(rows.assign(window_no=[w[0] for w in windows], window_start=[w[1] for w in windows], closed=True))

    def _rows(self, rows: pd.DataFrame) -> pd.DataFrame:
        whole = [f.name for f in PACKET.fields if isinstance(f.dataType, (LongType, IntegerType)) and f.name in self.columns]
        return rows.astype({c: "Int64" for c in whole})

    def close(self) -> None:
        pass


def window_stream(packets: DataFrame, window_s: float, late_s: int = 60) -> DataFrame:
    """The packets of a stream (with sensor_id and frame_no) with window_no and window_start as ``unaligned_windows`` gives them, and a row with
    ``closed`` for each window that is over: the next has begun, or the watermark has passed its end.  A sensor's packets are to arrive in the order
    of frame_no across batches; inside a batch any order will do."""
    columns = [c for c in packets.columns if c != "event_time"]
    schema = StructType([*(StructField(c, packets.schema[c].dataType) for c in columns), StructField("window_no", LongType()), StructField("window_start", DoubleType()), StructField("closed", BooleanType())])
    timed = packets.withColumn("event_time", F.timestamp_micros((F.col("ts") * 1_000_000).cast("long"))).withWatermark("event_time", f"{late_s} seconds")
    return timed.groupBy("sensor_id").transformWithStateInPandas(Windows(window_s, columns), schema, "append", "EventTime")


def detect_windows(packets: DataFrame, window_s: float, path: str, checkpoint: str, detect: Callable[[DataFrame], DataFrame], late_s: int = 60) -> StreamingQuery:
    """Run a batch detector on the windows that each micro-batch closes.  Packets wait in ``path``/packets by window; what is found lies in
    ``path``/alerts by batch, so a batch that is retried writes over itself."""
    spark = packets.sparkSession
    schema = StructType([*(StructField(c, packets.schema[c].dataType) for c in packets.columns), StructField("window_start", DoubleType()), StructField("batch", LongType()), StructField("window_no", LongType())])

    def each(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        rows.where("not closed").drop("closed").write.partitionBy("window_no").mode("overwrite").parquet(f"{path}/packets/batch={number}")
        over = rows.where("closed").select("sensor_id", "window_no").distinct()
        numbers = [r["window_no"] for r in over.select("window_no").distinct().collect()]  # prunes the folders that are read
        if numbers:
            waiting = spark.read.schema(schema).parquet(f"{path}/packets").where(F.col("window_no").isin(numbers) & (F.col("batch") <= number)).drop("batch")
            detect(waiting.join(F.broadcast(over), ["sensor_id", "window_no"], "left_semi")).write.mode("overwrite").parquet(f"{path}/alerts/batch={number}")
        rows.unpersist()

    return window_stream(packets, window_s, late_s).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_windows(flows_stream: DataFrame, detect: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Run a batch detector on each closed window's flows; alerts are written per batch id, so a retried batch overwrites itself."""

    def each(batch: DataFrame, batch_id: int) -> None:
        detect(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return flows_stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def global_beacons(flows: DataFrame) -> DataFrame:
    """The closing pass over all windows' flows, with the same guards as a single run."""
    return score_beacons(flows).where("is_beacon")
