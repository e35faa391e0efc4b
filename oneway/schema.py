"""Row shapes of the traffic engine."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()

FIN, SYN, RST, PSH, ACK = 1, 2, 4, 8, 16
FLOW_KEY = ["src_ip", "dst_ip", "src_port", "dst_port", "proto"]

#: One observed packet.  frame_no is the arrival order, on which first/last semantics depend; 32-bit counters need longs.
PACKET = T.StructType(
    [
        T.StructField("frame_no", _L, False), T.StructField("ts", _D, False), T.StructField("src_ip", _S), T.StructField("dst_ip", _S),
        T.StructField("src_port", _I), T.StructField("dst_port", _I), T.StructField("proto", _S), T.StructField("length", _I),
        T.StructField("tcp_flags", _I), T.StructField("tcp_tsval", _L), T.StructField("tcp_tsecr", _L), T.StructField("tcp_seq", _L),
        T.StructField("tcp_ack", _L), T.StructField("dns_qname", _S), T.StructField("dns_qtype", _S), T.StructField("sni", _S),
        T.StructField("http_partial", _B),
    ]
)

#: One detector finding before it becomes an alert.
FINDING = ["branch", "detector", "threat", "score", "confidence", "flow_key", "subject", "ts"]
