import random
import struct

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from oneway.functions import fixtures as X
from oneway.operators.alerts import alerts
from oneway.operators.beacon import score_beacons
from oneway.operators.flows import flows
from oneway.sources import pcap as S
from oneway.sources import tables as T
from oneway.streaming import windows as WN


def test_round_trip(spark, tmp_path):
    packets = [
        X.packet(1.5, "10.0.0.1", "10.0.0.2", tcp_flags=24, tcp_ack=4000000000, tcp_seq=1, tcp_tsval=4294967295, tcp_tsecr=3, length=5),
        X.packet(2.0, "10.0.0.1", "10.0.0.2", dst_port=53, proto="UDP", dns_qname="a.example.net", dns_qtype="TXT"),
        X.packet(3.0, "10.0.0.1", "10.0.0.2", dst_port=80, http_partial=True, length=60),
    ]
    spark.dataSource.register(S.PcapDataSource)
    path = str(tmp_path / "cap")
    S.write_pcap(X.frame(spark, packets), path)
    for got in (S.read_pcap(spark, path).orderBy("frame_no").collect(), spark.read.format("pcap").load(path).orderBy("frame_no").collect()):
        assert [r.ts for r in got] == [1.5, 2.0, 3.0]
        assert (got[0].tcp_ack, got[0].tcp_tsval, got[0].tcp_tsecr, got[0].length) == (4000000000, 4294967295, 3, 5)
        assert (got[1].dns_qname, got[1].dns_qtype) == ("a.example.net", "TXT") and got[2].http_partial and got[2].length == 60


def test_formats():
    with pytest.raises(ValueError):
        list(S.records(b"not a capture at all, no"))
    p = X.packet(1.25, "1.2.3.4", "5.6.7.8", proto="UDP", dst_port=9, length=3)
    frame = S.frame_of(p)
    for magic, order, unit in ((0xA1B2C3D4, "<", 1_000_000), (0xA1B2C3D4, ">", 1_000_000), (0xA1B23C4D, "<", 1_000_000_000)):
        for link, body in ((1, frame), (101, frame[14:]), (113, bytes(14) + b"\x08\x00" + frame[14:]), (1, frame[:12] + b"\x81\x00\x00\x05\x81\x00\x00\x06" + frame[12:])):
            data = struct.pack(f"{order}IHHiIII", magic, 2, 4, 0, 0, 65535, link) + struct.pack(f"{order}IIII", 1, unit // 4, len(body), len(body)) + body
            (row,) = S.decode(data + b"\0" * 7)  # a truncated tail ends the capture
            assert row[1] == 1.25 and row[2:6] == ("1.2.3.4", "5.6.7.8", 40000, 9)
    assert list(S.decode(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + struct.pack("<IIII", 1, 0, 20, 20) + bytes(20))) == []
    assert S.question(bytes(5)) == (None, None) and S.question(bytes(4) + b"\0\1" + bytes(6) + b"\xc0\x0c") == (None, None)
    assert S.question(bytes(4) + b"\0\1" + bytes(6) + b"\1a\0") == ("a", "A") and S.question(bytes(4) + b"\0\1" + bytes(6) + b"\1a\0\0\x63\0\1") == ("a", "99")


def ng(order, resolution, blocks):
    """A pcapng section with one Ethernet interface and packet blocks of (ticks, frame)."""
    block = lambda kind, body: (lambda b: struct.pack(f"{order}II", kind, 12 + len(b)) + b + struct.pack(f"{order}I", 12 + len(b)))(body + bytes(-len(body) % 4))
    out = block(0x0A0D0D0A, struct.pack(f"{order}IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(99, b"whatever")
    out += block(1, struct.pack(f"{order}HHI", 1, 0, 65535) + (struct.pack(f"{order}HHB3xHH", 9, 1, resolution, 0, 0) if resolution is not None else b""))
    return out + b"".join(block(6, struct.pack(f"{order}5I", 0, t >> 32, t & 0xFFFFFFFF, len(f), len(f)) + f) for t, f in blocks)


def test_pcapng(spark, tmp_path):
    frame = S.frame_of(X.packet(0, "1.2.3.4", "5.6.7.8", src_port=1111, tcp_tsval=7, tcp_tsecr=9, tcp_flags=24, length=3))
    for order, resolution, ticks in (("<", None, 1_250_000), (">", 9, 1_250_000_000), ("<", 0x81, 2)):
        data = ng(order, resolution, [(ticks, frame)])
        (row,) = S.decode(data + data[:20])  # a second section that is cut off
        assert row[1] == (1.25 if resolution != 0x81 else 1.0) and row[2:6] == ("1.2.3.4", "5.6.7.8", 1111, 443) and row[9:11] == (7, 9)
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "a.pcapng").write_bytes(ng("<", None, [(1_000_000, frame), (2_000_000, frame[:30]), (3_000_000, bytes(60))]))
    (folder / "b.pcap").write_bytes(b"".join(S.capture(iter([X.packet(1.0, "1.1.1.1", "2.2.2.2")]))))
    assert S.read_pcap(spark, str(folder)).count() == 2
    with pytest.raises(Exception, match="not a capture"):
        S.read_pcap(spark, str(folder), "classic").count()
    (folder / "c.pcap").write_bytes(b"junk, no capture at all")
    assert S.read_pcap(spark, str(folder), "permissive").count() == 2
    got = {r.path.rsplit("/", 1)[1]: (r.frames, r.packets, r.malformed, r.unsupported) for r in S.capture_quality(spark, str(folder)).collect()}
    assert got == {"a.pcapng": (3, 1, 1, 1), "b.pcap": (1, 1, 0, 0), "c.pcap": (1, 0, 1, 0)}


def test_built_frames_are_sound():
    frame = S.frame_of(X.packet(0, "10.0.0.1", "10.0.0.2", tcp_tsval=1, length=5))
    total = sum(struct.unpack("!10H", frame[14:34]))
    assert (total & 0xFFFF) + (total >> 16) == 0xFFFF  # the header's checksum holds
    assert list(S.tcp_options(b"\x01\x02\x04\x05\xb4\x08\x0a" + bytes(8) + b"\0\x09")) == [(1, b""), (2, b"\x05\xb4"), (8, bytes(8))]
    assert list(S.tcp_options(b"\x08\x0b" + bytes(8))) == [] and S.timestamps(b"\x08\x01") == (None, None)


def test_paced_replay(tmp_path):
    path = tmp_path / "x.pcap"
    path.write_bytes(b"".join(S.capture(iter([X.packet(t, "1.1.1.1", "2.2.2.2", proto="UDP", dst_port=9) for t in (10.0, 11.0, 10.5, 12.5)]))))
    reader = S.PacedReader({"path": str(path), "speed": "10"})
    assert [round(d, 3) for d, _ in reader.timed()] == [0.0, 0.1, 0.1, 0.3]
    reader.started = __import__("time").monotonic() - 0.2
    rows, end = reader.read(reader.initialOffset())
    assert end == {"at": 3} and len(list(rows)) == 3 and reader.read({"at": 3})[1] == {"at": 3} and len(list(reader.readBetweenOffsets({"at": 1}, {"at": 3}))) == 2
    with pytest.raises(ValueError):
        S.PacedReader({"path": str(path), "speed": "0"})


def test_tables(spark, tmp_path):
    csv = tmp_path / "d.csv"
    csv.write_text("dga,f1,abc.com\nshort,row\nlegit,f2,def.com\n")
    assert [r.domain for r in T.read_domains(spark, str(csv)).collect()] == ["abc.com", "def.com"]
    path = str(tmp_path / "records")
    T.replace_records(spark.createDataFrame([("alert", "1", 5), ("flow", "2", 6)], "kind string, record_id string, x int"), path)
    T.replace_records(spark.createDataFrame([("alert", "3", 7)], "kind string, record_id string, x int"), path)
    assert [r.record_id for r in T.load_records(spark, path, "alert").collect()] == ["3"] and T.load_records(spark, path, "flow").count() == 1
    first = T.upsert_jobs(None, spark.createDataFrame([("a", 1, "queued")], "job_id string, version int, status string"), str(tmp_path / "jobs"))
    second = T.upsert_jobs(spark.read.parquet(first), spark.createDataFrame([("a", 2, "done"), ("b", 1, "queued")], "job_id string, version int, status string"), str(tmp_path / "jobs"))
    assert {(r.job_id, r.status) for r in spark.read.parquet(second).collect()} == {("a", "done"), ("b", "queued")}


def test_one_capture_is_decoded_by_many_tasks(spark, tmp_path):
    """Ranges of a file give the packets and frame numbers of the whole, whatever is dropped in between; filters reach the decoder."""
    rows = [X.packet(float(i) / 7, f"10.0.{i % 9}.{i % 200}", "10.0.0.2", proto="UDP" if i % 3 else "TCP", length=i % 900) for i in range(900)]
    data = list(S.capture(iter(rows)))
    arp = struct.pack("<IIII", 1, 0, 30, 30) + bytes(12) + b"\x08\x06" + bytes(16)
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.pcap").write_bytes(b"".join(x + arp * (i % 4 == 1) for i, x in enumerate(data)) + b"\0\0\0")
    (folder / "b.pcap").write_bytes(b"".join(data[:1]))
    (folder / "c.pcap").write_bytes(b"".join(data[:5]))
    want = sorted(map(str, S.read_pcap(spark, str(folder)).collect()))
    index = S.index_captures(spark, str(folder), 20_000)
    assert index.where("file_no = 0").count() > 10 and len(want) == 904
    for size in (1, 20_000, 1 << 30):
        assert sorted(map(str, S.read_captures(spark, str(folder), size).collect())) == want
    index.write.parquet(str(tmp_path / "index"))
    spark.dataSource.register(S.PcapDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        frame = spark.read.format("pcap").option("index", str(tmp_path / "index")).load(str(folder))
        assert frame.rdd.getNumPartitions() == index.count() and sorted(map(str, frame.collect())) == want
        some = spark.read.format("pcap").option("index", str(tmp_path / "index")).option("pushdown", "true").load(str(folder)).where("proto = 'TCP' and ts >= 20 and ts < 90 and length > 5")
        assert sorted(map(str, some.collect())) == sorted(map(str, S.read_pcap(spark, str(folder)).where("proto = 'TCP' and ts >= 20 and ts < 90 and length > 5").collect()))
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_captures_that_follow_one_another(spark, tmp_path):
    """Packets are written by many tasks; read through, their numbers have no gaps, whatever the ranges."""
    rows = [X.packet(float(i) / 8, f"10.0.{i % 9}.{i % 200}", "10.0.0.2", proto="UDP" if i % 3 else "TCP", length=i) for i in range(500)]
    path = str(tmp_path / "out")
    spark.dataSource.register(S.PcapDataSource)
    S.write_pcap(X.frame(spark, rows), path, 60)
    assert len(list((tmp_path / "out").glob("*.pcap"))) == 9
    for size in (1000, 1 << 30):
        got = S.read_captures(spark, path, size, through=True).orderBy("frame_no").collect()
        assert [(r.frame_no, r.length, r.ts) for r in got] == [(i, i, i / 8) for i in range(500)]
    plain = S.read_captures(spark, path).orderBy("frame_no").collect()
    assert [r.length for r in plain] == list(range(500)) and plain[-1].frame_no >> 40 == 8


def test_unaligned_windows(spark):
    times = [0, 10, 59, 61, 100, 121.5, 300]
    packets = X.frame(spark, [X.packet(t, "a", "b") for t in times], sort=False).withColumn("sensor_id", F.lit("s"))
    got = [(r.window_no, r.window_start) for r in WN.unaligned_windows(packets, 60).orderBy("frame_no").collect()]
    assert got == [(0, 0), (0, 0), (0, 0), (1, 61), (1, 61), (2, 121.5), (3, 300)]


def test_windowed_flows_stream(spark, tmp_path):
    batch = X.frame(spark, X.syn_flood(1, 200, 100.0) + [X.packet(10_000, "a", "b")])
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = WN.windowed_flows(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), 60, 10)
    found = []
    q = stream.writeStream.outputMode("append").foreachBatch(lambda b, _: found.extend(b.select("packets", "syn").collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(r.packets for r in found) == 200 == sum(r.syn for r in found)


def test_channel_state_closes_like_a_batch(spark, tmp_path):
    """After several batches and a restart the state's beacons are those of a batch over each channel's last starts."""
    rng = random.Random(3)
    rows = [("a", "b", 443, 60.0 * i + rng.random(), 100) for i in range(300)] + [("a", "c", 53, 60.0 * i, 5) for i in range(20)] + [("a", "n", 123, 64.0 * i, 48) for i in range(20)] + [("q", "r", 443, 7.0 * i, 10) for i in range(40)] + [("x", "y", 80, rng.random() * 5000, 10 + i) for i in range(50)]
    columns = "src_ip string, dst_ip string, dst_port int, start_ts double, bytes long"
    rows = [(*r[:3], r[3] + 1000, r[4]) for r in rows]  # a clock at 0 is at the first watermark
    rng.shuffle(rows)
    for n, part in enumerate((rows[:150], rows[150:151], rows[151:])):
        spark.createDataFrame(part, columns).write.mode("append").parquet(str(tmp_path / "in"))
        out = WN.channel_series(spark.readStream.schema(columns).parquet(str(tmp_path / "in")), 10**6, 10**6)
        out.writeStream.outputMode("update").format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    frame = spark.createDataFrame(rows, columns).where("dst_port <> 53")  # none is late, none expires
    last = frame.withColumn("__r", F.row_number().over(W.partitionBy("src_ip", "dst_ip").orderBy(F.desc("start_ts")))).where(f"__r <= {WN.CHANNEL_EVENTS}")
    state = WN.channel_state(spark, str(tmp_path / "cp"))
    key = ["src_ip", "dst_ip", "start_ts", "bytes", "dst_port"]
    assert sorted(map(tuple, state.select(key).collect())) == sorted(map(tuple, last.select(key).collect()))
    told = lambda df: sorted((r.src_ip, r.dst_ip, r.n, round(r.score, 6)) for r in df.collect())
    want = told(score_beacons(last.withColumn("flow_seq", F.floor(F.col("start_ts") * 1_000_000))).where("is_beacon"))
    assert told(WN.closing_beacons(spark, str(tmp_path / "cp"))) == want and [w[:2] for w in want] == [("a", "b"), ("q", "r")]


def test_exact_windows_on_a_stream(spark, tmp_path):
    """Random batches and a restart give the windows of the batch form; what a closed window holds is judged once."""
    rng = random.Random(8)
    rows = [X.packet(t, f"10.0.0.{rng.randrange(3)}", "b") for t in sorted(rng.random() * 900 for _ in range(260))] + X.syn_flood(1, 300, 100.0)
    packets = X.frame(spark, rows).withColumns({"sensor_id": F.when(F.col("frame_no") % 3 == 0, "s2").otherwise("s1"), "ts": F.col("ts") + 1000})  # a clock at 0 is at the first watermark
    end = X.frame(spark, [X.packet(5000.0, "z", "z")]).withColumns({"sensor_id": F.lit("s1"), "frame_no": F.lit(10_000).cast("long")})
    detect = lambda df: flows(df, ["sensor_id", "window_no"])
    cuts = [0, *sorted(rng.sample(range(1, packets.count()), 2)), 9_999]
    for n, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        packets.where(F.col("frame_no").between(lo, hi - 1)).orderBy(F.rand(n)).write.mode("append").parquet(str(tmp_path / "in"))
        if n == 2:
            end.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(packets.schema).parquet(str(tmp_path / "in"))
        WN.detect_windows(stream, 60.0, str(tmp_path / "out"), str(tmp_path / "cp"), detect, 5).awaitTermination(120)
    everything = packets.unionByName(end)
    want = {(r.sensor_id, r.frame_no): (r.window_no, r.window_start) for r in WN.unaligned_windows(everything, 60.0).collect()}
    got = spark.read.parquet(str(tmp_path / "out" / "packets"))
    assert {(r.sensor_id, r.frame_no): (r.window_no, r.window_start) for r in got.collect()} == want and got.count() == len(want)
    told = lambda df: sorted((r.sensor_id, r.window_no, r.flow_key, r.packets, r.start_ts) for r in df.collect())
    batch = told(detect(WN.unaligned_windows(everything, 60.0)).where("not (sensor_id = 's1' and start_ts = 5000)"))
    assert told(spark.read.parquet(str(tmp_path / "out" / "alerts")).where("start_ts < 5000")) == batch and batch


def test_alerts_agree_however_packets_are_spread(spark):
    packets = X.frame(spark, X.syn_flood(1) + X.tunnel(2) + X.beacon(3))
    key = lambda df: sorted((r.threat, r.flow_key, r.confidence) for r in df.collect())
    assert key(alerts(packets)) == key(alerts(packets.repartition(7)))
