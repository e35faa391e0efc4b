"""Paced replay as a streaming query with a small state machine, a landing folder, and progress for listeners."""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from oneway.schema import PACKET
from oneway.sources.pcap import PcapDataSource, arrow_batches, decode

#: Extensions of capture files.
EXTENSIONS = ("pcap", "pcapng", "cap")
#: Events that a late subscriber still sees.
KEPT_EVENTS = 256


def landing_stream(spark: SparkSession, folder: str, most_bytes: int = 1 << 30) -> DataFrame:
    """Packets of the captures that arrive in a folder.  Frame numbers follow the files' times of arrival (in seconds, files of one second
    by a hash of their names) and then the packets in a file, for which there is room however small they are.  What no upload may be (another extension, empty, over
    ``most_bytes``) is left out; ``rejected`` lists it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, first in zip(batch.column("content"), batch.column("first").to_pylist()):
                yield from arrow_batches(decode(content.as_buffer().to_pybytes(), first))

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    # seconds since 2020 in the upper bits; a record has 16 bytes of header and a packet 28 at least, so a file of most_bytes has less than most_bytes / 44
    room = (most_bytes // 44).bit_length()
    names = 62 - 30 - room
    if names < 0:
        raise ValueError(f"uploads of {most_bytes} bytes may have more packets than there are numbers")
    at = F.shiftleft(F.unix_seconds("modificationTime") - 1_577_836_800, names) + F.pmod(F.xxhash64("path"), F.lit(1 << names))
    accepted = files.where(upload_fault("path", "length", most_bytes).isNull())
    return accepted.select("content", F.shiftleft(at, room).alias("first")).mapInArrow(run, PACKET)


def upload_fault(path: str, length: str, most_bytes: int = 1 << 30) -> Column:
    """Why a file is no upload, as status and reason, or null: 415 for another extension, 400 if empty, 413 if too large."""
    known = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)).isin(*EXTENSIONS)
    fault = lambda code, why: F.struct(F.lit(code).alias("status"), F.lit(why).alias("reason"))
    return F.when(~known, fault(415, "not a capture file")).when(F.col(length) == 0, fault(400, "empty file")).when(F.col(length) > most_bytes, fault(413, "file too large"))


def rejected(spark: SparkSession, folder: str, most_bytes: int = 1 << 30) -> DataFrame:
    """path, length, status and reason of the files in a folder that are no uploads."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    return files.withColumn("fault", upload_fault("path", "length", most_bytes)).where("fault is not null").select("path", "length", "fault.*")


class Replay:
    """ready -> replaying <-> paused -> stopped or finished.  A pause stops the query; resuming goes on from its checkpoint."""

    def __init__(self, spark: SparkSession, path: str, checkpoint: str, sink: Callable[[DataFrame, int], None], speed: float = 1.0):
        if speed <= 0:
            raise ValueError("speed must be positive")
        spark.dataSource.register(PcapDataSource)
        self.spark, self.path, self.checkpoint, self.sink, self.speed = spark, path, checkpoint, sink, speed
        self.state, self.query = "ready", None

    def start(self) -> None:
        if self.state not in ("ready", "paused"):
            raise RuntimeError(f"cannot start from {self.state}")
        packets = self.spark.readStream.format("pcap").option("speed", str(self.speed)).load(self.path)
        self.query = packets.writeStream.foreachBatch(self.sink).option("checkpointLocation", self.checkpoint).start()
        self.state = "replaying"

    resume = start

    def pause(self) -> None:
        if self.state != "replaying":
            raise RuntimeError(f"cannot pause from {self.state}")
        self.query.stop()
        self.state = "paused"

    def stop(self) -> None:
        if self.query is not None and self.state == "replaying":
            self.query.stop()
        self.state = "stopped"


class AlertSink:
    """Alerts of a stream, kept by epoch and told to subscribers once.

    An epoch's alerts are written, then told, then marked; one that is retried is written over and, if its mark stands, not told again.  A subscriber gets
    the epoch's number with the rows, so one that hears an epoch twice after a crash between telling and marking can tell.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.subscribers: list[Callable[[int, DataFrame], None]] = []

    def subscribe(self, f: Callable[[int, DataFrame], None]) -> Callable[[], None]:
        self.subscribers.append(f)
        return lambda: self.subscribers.remove(f)

    def _mark(self, epoch: int):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/told/{epoch}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def deliver(self, alerts: DataFrame, epoch: int) -> bool:
        """Take in an epoch; false if it was told before."""
        fs, mark = self._mark(epoch)
        if fs.exists(mark):
            return False
        alerts.write.mode("overwrite").parquet(f"{self.path}/alerts/epoch={epoch}")
        rows = self.spark.read.schema(alerts.schema).parquet(f"{self.path}/alerts/epoch={epoch}")
        for f in list(self.subscribers):
            f(epoch, rows)
        fs.mkdirs(mark.getParent())
        fs.create(mark, False).close()
        return True

    def write(self, alerts: DataFrame, checkpoint: str) -> StreamingQuery:
        return alerts.writeStream.foreachBatch(lambda rows, epoch: self.deliver(rows, epoch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def stored(self) -> DataFrame:
        """All alerts so far, with their epoch."""
        return self.spark.read.parquet(f"{self.path}/alerts")


class Progress(StreamingQueryListener):
    """Keeps the latest events and hands each to subscribers."""

    def __init__(self):
        self.events: deque = deque(maxlen=KEPT_EVENTS)
        self.subscribers: list[Callable[[dict], None]] = []
        self.lock = threading.Lock()

    def _emit(self, event: dict) -> None:
        with self.lock:
            self.events.append(event)
            told = list(self.subscribers)
        for f in told:
            f(event)

    def subscribe(self, f: Callable[[dict], None]) -> Callable[[], None]:
        with self.lock:
            self.subscribers.append(f)
        return lambda: self.subscribers.remove(f)

    def onQueryStarted(self, event) -> None:
        self._emit({"kind": "started", "id": str(event.id)})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._emit({"kind": "progress", "id": str(p.id), "batch": p.batchId, "rows": p.numInputRows, "rows_per_s": p.processedRowsPerSecond})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._emit({"kind": "ended", "id": str(event.id), "error": event.exception})
