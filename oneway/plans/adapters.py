"""Packet-shaped and alert-shaped views of general tables, as SQL that Spark and DuckDB read alike.

Each template names the engine's spelling of integer division, hashing and timestamps; everything else is common.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SPARK = {
    "div": lambda a, b: f"(({a}) div ({b}))", "sha": lambda x: f"sha2({x}, 256)", "dbl": "DOUBLE", "txt": "STRING", "big": "BIGINT",
    "micros": lambda x: f"unix_micros(CAST({x} AS TIMESTAMP))", "nulls": "CAST(NULL AS {0})",
    "host": lambda x: f"regexp_extract({x}, '://([^/?#]*)', 1)",
}
_DUCK = {
    "div": lambda a, b: f"(({a}) // ({b}))", "sha": lambda x: f"sha256({x})", "dbl": "DOUBLE", "txt": "VARCHAR", "big": "BIGINT",
    "micros": lambda x: f"epoch_us({x})", "nulls": "CAST(NULL AS {0})",
    "host": lambda x: f"regexp_extract({x}, '://([^/?#]*)', 1)",
}


def _packet(cols: dict[str, str], d: dict, source: str) -> str:
    """A SELECT of the packet schema with defaults for what ``cols`` leaves out."""
    kinds = {
        "frame_no": d["big"], "ts": d["dbl"], "src_ip": d["txt"], "dst_ip": d["txt"], "src_port": "INT", "dst_port": "INT", "proto": d["txt"],
        "length": "INT", "tcp_flags": "INT", "tcp_tsval": d["big"], "tcp_tsecr": d["big"], "tcp_seq": d["big"], "tcp_ack": d["big"],
        "dns_qname": d["txt"], "dns_qtype": d["txt"], "sni": d["txt"], "http_partial": "BOOLEAN",
    }
    base = {"src_port": "40000", "dst_port": "443", "proto": "'TCP'", "length": "0", "tcp_flags": "0", "http_partial": "false"}
    return "SELECT " + ", ".join(f"CAST({cols.get(c, base.get(c, 'NULL'))} AS {k}) AS {c}" for c, k in kinds.items()) + f" FROM {source}"


def _pkt_flood(d: dict) -> str:
    """Every flood rule's positives and negatives: the event id's remainder picks role and destination."""
    r, k = "event_id % 16", d["div"]("event_id", "16")
    ip = lambda a, x: f"concat('{a}.', CAST({x} AS {d['txt']}))"
    cols = {
        "frame_no": "event_id",
        "ts": f"CASE WHEN {r} < 5 THEN 0.01 * {k} WHEN {r} < 7 THEN 0.005 * {k} WHEN {r} < 9 THEN 0.001 * {k} WHEN {r} < 11 THEN 0.5 * {k} ELSE 10.0 * {k} END",
        "src_ip": f"CASE WHEN {r} < 3 THEN {ip('10.1.0', f'{k} % 251')} WHEN {r} < 5 THEN {ip('10.2.0', f'{k} % 83')} WHEN {r} < 7 THEN {ip('10.3.0', f'{k} % 41')}"
        f" WHEN {r} < 9 THEN {ip('10.4.0', f'{k} % 199')} WHEN {r} < 11 THEN {ip('10.5.0', f'{k} % 5')} ELSE {ip('10.6.0', f'{k} % 17')} END",
        "dst_ip": f"concat('192.0.2.', CAST({r} AS {d['txt']}))",
        "src_port": f"CASE WHEN {r} < 3 THEN 1024 + ({k} * 7) % 60000 WHEN {r} < 5 THEN 443 WHEN {r} < 7 THEN 53 WHEN {r} < 9 THEN 2000 + {k} % 97 WHEN {r} < 11 THEN 30000 + {k} % 25 ELSE 50000 + {k} % 3 END",
        "dst_port": f"CASE WHEN {r} < 3 THEN 443 WHEN {r} < 5 THEN 1024 + ({k} * 11) % 60000 WHEN {r} < 7 THEN 7000 WHEN {r} < 9 THEN 9000 WHEN {r} < 11 THEN 80 ELSE 443 END",
        "proto": f"CASE WHEN {r} BETWEEN 5 AND 8 THEN 'UDP' ELSE 'TCP' END",
        "length": f"CASE WHEN {r} < 5 THEN 0 WHEN {r} < 7 THEN 1200 WHEN {r} < 9 THEN 60 WHEN {r} < 11 THEN 24 ELSE 500 END",
        "tcp_flags": f"CASE WHEN {r} < 3 THEN 2 WHEN {r} < 5 THEN 18 WHEN {r} < 9 THEN 0 ELSE 24 END",
        "http_partial": f"{r} IN (9, 10)",
    }
    return _packet(cols, d, "events")


def _pkt_beacon(d: dict) -> str:
    """Check-ins of graded jitter: 25 a channel, 60 s apart."""
    c, k = d["div"]("event_id", "25"), "event_id % 25"
    j = f"CASE ({d['div'](c, '10')}) % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 0.2 WHEN 2 THEN 0.4 WHEN 3 THEN 0.6 ELSE 2.0 END"
    cols = {
        "frame_no": "event_id", "ts": f"60.0 * ({k}) + 60.0 * ({j}) * (CAST(CAST(floor(100 * value) AS {d['big']}) % 1000 AS DOUBLE) / 1000.0 - 0.5)",
        "src_ip": f"concat('10.7.', CAST({c} AS {d['txt']}))", "dst_ip": "'198.51.100.9'", "src_port": f"20000 + ({k})", "length": "512", "tcp_flags": "24",
    }
    return _packet(cols, d, "events")


def _pkt_events(d: dict) -> str:
    """The event stream as packets, its clock 1000 times faster."""
    t = d["txt"]
    cols = {
        "frame_no": "event_id", "ts": f"{d['micros']('ts')} / 1000000000.0", "src_ip": f"concat('10.0.', CAST(user_id AS {t}))", "dst_ip": "concat('203.0.113.', event_type)",
        "src_port": "40000 + CAST(user_id % 20000 AS INT)", "dst_port": "CASE WHEN event_id % 11 = 0 THEN 53 WHEN user_id % 2 = 0 THEN 443 ELSE 80 END",
        "proto": "CASE WHEN event_id % 11 = 0 OR user_id % 5 = 0 THEN 'UDP' ELSE 'TCP' END", "length": "CAST(floor(value) AS INT) + 40",
        "tcp_flags": "CASE WHEN event_id % 11 = 0 OR user_id % 5 = 0 THEN 0 WHEN event_id % 7 = 0 THEN 2 WHEN event_id % 13 = 0 THEN 17 WHEN event_id % 5 = 0 THEN 24 WHEN event_id % 17 = 0 THEN 4 ELSE 16 END",
        "dns_qname": f"CASE WHEN event_id % 11 = 0 THEN concat(event_type, CAST(user_id % 7 AS {t}), '.example.net') END",
        "dns_qtype": "CASE WHEN event_id % 11 = 0 AND event_id % 2 = 0 THEN 'AAAA' END", "http_partial": "event_id % 11 <> 0 AND user_id % 2 = 1 AND event_id % 19 = 0",
    }
    return _packet(cols, d, "events")


def _pkt_lineitem(d: dict) -> str:
    """ACK trains that cross 2**32: one flow an order, one ACK a line.  TSval follows a 100 Hz clock with a wrap."""
    order = "PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice"
    cents = f"CAST(floor(l_extendedprice * 100 + 0.5) AS {d['big']})"
    inner = f"(SELECT *, row_number() OVER ({order}) AS k, sum({cents}) OVER ({order} ROWS UNBOUNDED PRECEDING) AS run FROM lineitem) x"
    cols = {
        "frame_no": "l_orderkey * 64 + k", "ts": "CAST(l_orderkey % 1000 AS DOUBLE) + 0.25 * k", "src_ip": f"concat('10.8.', CAST(l_orderkey % 250 AS {d['txt']}))",
        "dst_ip": "'192.0.2.200'", "src_port": "CAST(1025 + l_orderkey % 60000 AS INT)", "dst_port": f"CAST(1 + {d['div']('l_orderkey', '60000')} AS INT)", "length": "CAST(l_quantity AS INT) * 10",
        "tcp_flags": "CASE WHEN k = 1 THEN 18 WHEN l_linenumber = 7 THEN 17 ELSE 16 END", "tcp_ack": f"CAST((4280000000 + run) % 4294967296 AS {d['big']})",
        "tcp_tsval": f"CAST((4294967200 + 25 * k + l_orderkey % 3) % 4294967296 AS {d['big']})", "tcp_tsecr": f"CAST(l_linenumber AS {d['big']})",
    }
    return _packet(cols, d, inner)


def _dns(d: dict) -> str:
    """Queries: page hosts (look like a CDN) and hashed names (look like a tunnel)."""
    pages = f"SELECT page_id AS frame_no, CAST(page_id AS DOUBLE) * 0.5 AS ts, {d['host']('url')} AS qname, CAST('A' AS {d['txt']}) AS qtype FROM pages"
    docs = f"SELECT 100000000 + doc_id AS frame_no, CAST(doc_id AS DOUBLE) * 0.7 AS ts, concat(substr({d['sha'](f'CAST(doc_id AS {d['txt']})')}, 1, 30), '.', lang, '-sync.net') AS qname, CAST('TXT' AS {d['txt']}) AS qtype FROM documents"
    return f"SELECT frame_no, ts, '10.9.0.1' AS src_ip, '192.0.2.53' AS dst_ip, qname, qtype FROM ({pages} UNION ALL {docs}) q WHERE qname <> ''"


def _labels_mix(d: dict) -> str:
    """Names to judge: hash slices, and names from the relational tables."""
    t = d["txt"]
    hashed = f"SELECT event_id AS frame_no, concat(substr({d['sha'](f'CAST(event_id AS {t})')}, 1, CAST(6 + event_id % 15 AS INT)), CASE WHEN event_id % 2 = 0 THEN '.info' ELSE '.com' END) AS qname FROM events"
    nations = "SELECT 200000000 + CAST(n_nationkey AS BIGINT) AS frame_no, concat('www.', lower(n_name), '.org') AS qname FROM nation"
    parts = "SELECT 300000000 + p_partkey AS frame_no, concat(lower(replace(replace(p_name, ' ', ''), '#', '')), '.shop') AS qname FROM part"
    custs = "SELECT 400000000 + c_custkey AS frame_no, concat('login.', lower(replace(replace(c_name, '#', ''), '0', 'o')), lower(c_mktsegment), '.net') AS qname FROM customer"
    return f"SELECT frame_no, qname FROM ({hashed} UNION ALL {nations} UNION ALL {parts} UNION ALL {custs}) n"


def _scores(d: dict) -> str:
    """Scored samples per class: score from text length and label, uncertainty from the label."""
    return (
        "SELECT l.doc_id AS id, d.lang AS class, CAST((d.n_chars * 37 + l.doc_id * 101) % 1000 AS DOUBLE) / 1000.0 * 0.6 + 0.4 * l.quality AS score,"
        " 0.1 + 0.3 * l.toxic AS uncertainty, l.quality AS label, CASE WHEN l.doc_id % 2 = 0 THEN 'fit' ELSE 'test' END AS part"
        " FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL AND d.n_chars IS NOT NULL AND d.lang IS NOT NULL"
    )


def _alerts(d: dict) -> str:
    """Alert-shaped rows from events."""
    t = d["txt"]
    return (
        f"SELECT event_id AS seq, {d['micros']('ts')} / 1000000.0 AS ts, event_type AS detector, concat(event_type, '_threat') AS threat,"
        f" CAST(CAST(floor(value * 7) AS {d['big']}) % 1000 AS DOUBLE) / 1000.0 AS confidence,"
        f" CASE WHEN event_id % 23 = 0 THEN '*:0->x/TCP' ELSE concat('10.0.0.', CAST(user_id AS {t}), ':', CAST(40000 + event_id % 50 AS {t}), '->203.0.113.7:443/TCP') END AS flow_key FROM events"
    )


_BUILDERS = {
    "pkt_flood": _pkt_flood, "pkt_beacon": _pkt_beacon, "pkt_events": _pkt_events, "pkt_lineitem": _pkt_lineitem, "dns": _dns,
    "labels_mix": _labels_mix, "scores": _scores, "alerts": _alerts,
}
_TABLES = {
    "pkt_flood": ["events"], "pkt_beacon": ["events"], "pkt_events": ["events"], "pkt_lineitem": ["lineitem"], "dns": ["pages", "documents"],
    "labels_mix": ["events", "nation", "part", "customer"], "scores": ["labels", "documents"], "alerts": ["events"],
}


def duck(name: str) -> str:
    return _BUILDERS[name](_DUCK)


def adapter(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The adapter over the tables of a folder, bound by parameters rather than by temporary views."""
    sql = _BUILDERS[name](_SPARK)
    for table in _TABLES[name]:
        sql = sql.replace(f" {table} ", f" {{{table}}} ").replace(f"FROM {table})", f"FROM {{{table}}})")
        sql = sql[: -len(table)] + f"{{{table}}}" if sql.endswith(f"FROM {table}") else sql
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES[name]})
