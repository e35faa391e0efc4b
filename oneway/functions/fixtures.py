"""Seeded traffic scenarios with ground truth, for tests and evaluation: packet dictionaries made on the driver.

Each generator yields packets of one behaviour; ``frame`` turns any mix into a packet DataFrame in arrival order.
"""

from __future__ import annotations

import random
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from oneway.schema import ACK, PACKET, PSH, SYN

NAMES = "google wikipedia github python debian kernel mozilla ubuntu apache fastmail openstreetmap archive".split()
_DEFAULT = {"src_port": 40000, "dst_port": 443, "proto": "TCP", "length": 0, "tcp_flags": 0, "http_partial": False}


def packet(ts: float, src: str, dst: str, **fields) -> dict:
    return dict.fromkeys(PACKET.names) | _DEFAULT | {"ts": float(ts), "src_ip": src, "dst_ip": dst} | fields


def frame(spark: SparkSession, packets: Iterable[dict], sort: bool = True) -> DataFrame:
    rows = sorted(packets, key=lambda p: p["ts"]) if sort else list(packets)
    return spark.createDataFrame([tuple((p | {"frame_no": i})[c] for c in PACKET.names) for i, p in enumerate(rows)], PACKET)


# Sizes of the scenarios, as FIXTURES.md lists them.
HOSTS, LOOKUPS, SESSION_PACKETS, ACK_STEP = 16, (1, 3), (8, 16), (1000, 2800)
CROWD_CLIENTS, CROWD_PACKETS = 120, (4, 8)


def background(seed: int, hosts: int = HOSTS, start: float = 0.0) -> list[dict]:
    """Hosts that look up a few known names and hold one session with a running clock and growing ACKs."""
    rng, out = random.Random(seed), []
    for h in range(hosts):
        src, t = f"10.20.{seed % 200}.{h + 1}", start + rng.uniform(0, 10)
        for _ in range(rng.randint(*LOOKUPS)):
            out.append(packet(t, src, "192.0.2.53", src_port=rng.randint(1025, 65000), dst_port=53, proto="UDP", length=40, dns_qname=f"www.{rng.choice(NAMES)}.org", dns_qtype="A"))
        ack, port = rng.randint(1, 1 << 31), rng.randint(1025, 65000)
        for k in range(rng.randint(*SESSION_PACKETS)):
            t += rng.uniform(0.05, 0.4)
            ack += rng.randint(*ACK_STEP)
            out.append(packet(t, src, "198.51.100.80", src_port=port, length=rng.randint(100, 900), tcp_flags=SYN if k == 0 else ACK | PSH, tcp_tsval=int(t * 1000), tcp_tsecr=7, tcp_ack=None if k == 0 else ack))
    return out


def cdn(seed: int, n: int = 45) -> list[dict]:
    rng = random.Random(seed)
    return [packet(i * 0.4, "10.30.0.5", "192.0.2.53", dst_port=53, proto="UDP", length=50, dns_qname=f"img{rng.randint(1, 8)}.static-assets.net", dns_qtype="A") for i in range(n)]


def periodic_time(seed: int, n: int = 14) -> list[dict]:
    rng = random.Random(seed)
    return [packet(64 * i + rng.uniform(-1, 1), "10.31.0.5", "192.0.2.123", src_port=1025 + i, dst_port=123, proto="UDP", length=48) for i in range(n)]


def crowd(seed: int, clients: int = CROWD_CLIENTS) -> list[dict]:
    rng, out = random.Random(seed), []
    for c in range(clients):
        t, src, port = rng.uniform(0, 10), f"10.40.{c // 250}.{c % 250 + 1}", rng.randint(1025, 65000)
        for k in range(rng.randint(*CROWD_PACKETS)):
            t += rng.uniform(0.02, 0.2)
            out.append(packet(t, src, "198.51.100.81", src_port=port, length=0 if k == 0 else 400, tcp_flags=SYN if k == 0 else ACK | PSH, tcp_tsval=int(t * 1000) + c * 7919))
    return out


def syn_flood(seed: int, n: int = 600, seconds: float = 8.0, target: str = "198.51.100.90") -> list[dict]:
    rng = random.Random(seed)
    return [packet(i * seconds / n, ".".join(str(rng.randint(1, 250)) for _ in range(4)), target, src_port=rng.randint(1025, 65000), tcp_flags=SYN) for i in range(n)]


def udp_flood(seed: int, sources: int = 250, each: int = 26, seconds: float = 8.0, target: str = "198.51.100.91") -> list[dict]:
    rng = random.Random(seed)
    return [packet(rng.uniform(0, seconds), f"10.50.{s // 250}.{s % 250}", target, src_port=2000 + s, dst_port=9999, proto="UDP", length=rng.randint(28, 64)) for s in range(sources) for _ in range(each)]


def reflection(seed: int, reflectors: int = 40, each: int = 30, target: str = "198.51.100.92") -> list[dict]:
    rng = random.Random(seed)
    return [packet(rng.uniform(0, 4), f"10.60.0.{s + 1}", target, src_port=(53, 123, 11211, 1900)[s % 4], dst_port=7000, proto="UDP", length=rng.randint(1400, 4000)) for s in range(reflectors) for _ in range(each)]


def synack_reflection(seed: int, sources: int = 80, each: int = 30, target: str = "198.51.100.93") -> list[dict]:
    rng = random.Random(seed)
    return [packet(rng.uniform(0, 5), f"10.61.0.{s + 1}", target, src_port=443, dst_port=rng.randint(1025, 65000), tcp_flags=SYN | ACK) for s in range(sources) for _ in range(each)]


def slow_http(seed: int, connections: int = 30, target: str = "198.51.100.94") -> list[dict]:
    return [packet(k * 6 + c * 0.01, "10.70.0.9", target, src_port=30000 + c, dst_port=80, length=24, tcp_flags=ACK | PSH, http_partial=True) for c in range(connections) for k in range(8)]


def tunnel(seed: int, n: int = 40, domain: str = "t-exfil.net") -> list[dict]:
    rng = random.Random(seed)
    label = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz234567") for _ in range(30))
    return [packet(0.7 * i, "10.80.0.3", "192.0.2.53", src_port=20000 + i, dst_port=53, proto="UDP", length=80, dns_qname=f"{label()}.{domain}", dns_qtype="TXT") for i in range(n)]


def generated_names(seed: int, n: int = 16) -> list[dict]:
    rng = random.Random(seed)
    name = lambda: "".join(rng.choice("bcdfghjklmnpqrstvwxz0123456789") for _ in range(16))
    return [packet(2.0 * i, "10.81.0.3", "192.0.2.53", src_port=21000 + i, dst_port=53, proto="UDP", length=60, dns_qname=f"{name()}.info", dns_qtype="A") for i in range(n)]


def beacon(seed: int, n: int = 15, period: float = 60.0, jitter: float = 0.13, dst_port: int = 443, proto: str = "TCP", size: int = 512, src: str = "10.90.0.4", dst: str = "203.0.113.66") -> list[dict]:
    rng = random.Random(seed)
    return [packet(period * i + rng.uniform(-jitter, jitter) * period / 2 + 0.01 * k, src, dst, src_port=22000 + i, dst_port=dst_port, proto=proto, length=size, tcp_flags=ACK | PSH if proto == "TCP" else 0, tcp_ack=1 + 100 * k if proto == "TCP" else None) for i in range(n) for k in range(3)]


def doh_beacon(seed: int, n: int = 15) -> list[dict]:
    """Check-ins with a resolver over HTTPS: acknowledged data and no name in sight."""
    return beacon(seed, n, dst_port=443, dst="192.0.2.8")


def quic_beacon(seed: int, n: int = 15) -> list[dict]:
    """Check-ins over UDP: nothing acknowledged in the clear."""
    return beacon(seed, n, proto="UDP", size=640)


def reconstruction(seed: int, acks: int = 40, total: int = 100_000, first: int = 1) -> tuple[list[dict], int]:
    """One flow whose ACKs acknowledge ``total`` bytes of the other side, across a wrap if it comes to that."""
    rng = random.Random(seed)
    cuts = sorted(rng.sample(range(1, total), acks - 2))
    marks = [0, *cuts, total]
    return [packet(0.1 * i, "10.95.0.1", "198.51.100.95", tcp_flags=ACK, length=10, tcp_ack=(first + m) % (1 << 32)) for i, m in enumerate(marks)], total


def arithmetic_names(seed: int, n: int) -> list[str]:
    """Names from a linear recurrence over letters."""
    out, x = [], seed
    for _ in range(n):
        name = ""
        for _ in range(14):
            x = (x * 1103515245 + 12345) & 0x7FFFFFFF
            name += chr(97 + (x >> 16) % 25)
        out.append(f"{name}.com")
    return out


def dictionary_names(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    words = "time work life world play news shop mail cloud data secure".split()
    return ["".join(rng.choice(words) for _ in range(3)) + ".net" for _ in range(n)]


#: Scenario, generator and the threat it is to raise (None: silence).
SCENARIOS = [
    ("background", background, None), ("cdn", cdn, None), ("periodic time", periodic_time, None), ("crowd", crowd, None),
    ("syn flood", syn_flood, "syn_flood"), ("udp flood", udp_flood, "udp_flood"), ("reflection", reflection, "reflection_amplification"),
    ("synack reflection", synack_reflection, "reflection_amplification"), ("slow http", slow_http, "slowloris"), ("tunnel", tunnel, "dns_tunnelling"),
    ("generated names", generated_names, "dga_domain"), ("beacon", beacon, "c2_beaconing"),
    ("resolver beacon", doh_beacon, "c2_beaconing"), ("udp beacon", quic_beacon, "c2_beaconing"),
]

#: Captures to test tools with: name, what they hold, and the threats in them.
CAPTURES = [
    ("mixed", (background, syn_flood, slow_http, tunnel, generated_names), ("syn_flood", "slowloris", "dns_tunnelling", "dga_domain")), ("benign", (background, cdn), ()),
    ("syn_flood", (background, syn_flood), ("syn_flood",)), ("slowloris", (background, slow_http), ("slowloris",)), ("dns_tunnel", (background, tunnel), ("dns_tunnelling",)),
    ("dga_beacon", (generated_names, beacon), ("dga_domain", "c2_beaconing")),
]
