"""The registered queries' meaning in SQL for DuckDB, written from the definitions and not from the DataFrame plans."""

from __future__ import annotations

from oneway.functions.lexical import COMMON_BIGRAMS, LONG_WORDS
from oneway.operators.floods import AMPLIFIERS
from oneway.plans.adapters import duck

KEY = "src_ip, dst_ip, src_port, dst_port, proto"
PORTS = ", ".join(map(str, AMPLIFIERS))


def _tcp(mask: int) -> str:
    return f"proto = 'TCP' AND coalesce(tcp_flags, 0) & {mask} = {mask}"


def flows(source: str) -> str:
    return f"""SELECT *, greatest(last_ts - start_ts, 0) AS duration, CASE WHEN last_ts > start_ts THEN bytes / (last_ts - start_ts) ELSE 0 END AS byte_rate,
      bytes / packets AS mean_size, concat(src_ip, ':', src_port, '->', dst_ip, ':', dst_port, '/', proto) AS flow_key FROM (
      SELECT {KEY}, min(frame_no) AS flow_seq, arg_min(ts, frame_no) AS start_ts, arg_max(ts, frame_no) AS last_ts, count(*) AS packets, sum(length)::BIGINT AS bytes,
        count(*) FILTER ({_tcp(2)} AND NOT ({_tcp(18)})) AS syn, count(*) FILTER ({_tcp(18)}) AS synack, count(*) FILTER ({_tcp(1)}) AS fin, count(*) FILTER ({_tcp(4)}) AS rst,
        count(*) FILTER ({_tcp(16)}) AS ack, count(*) FILTER ({_tcp(8)}) AS psh, count(*) FILTER (http_partial) AS http_partial_count, count(tcp_tsval) AS tsval_samples,
        count(*) FILTER ({_tcp(16)} AND tcp_ack IS NOT NULL) AS ack_samples
      FROM ({source}) p GROUP BY ALL)"""


HALF_OPEN = "CASE WHEN syn + synack = 0 THEN 0.0 ELSE greatest(0.0, 1 - (least(syn + synack, fin + rst) + CASE WHEN psh > 0 OR bytes > 100 * (syn + synack) THEN 1 ELSE 0 END) / (syn + synack)) END"
ROLE = """CASE WHEN synack > 0 AND syn = 0 THEN 'server' WHEN dst_port <= 1024 AND src_port > 1024 THEN 'client' WHEN src_port <= 1024 AND dst_port > 1024 THEN 'server'
  WHEN syn > synack THEN 'client' ELSE 'unknown' END"""
LIVE_NO_CLOCK = "CASE WHEN proto <> 'TCP' THEN 0.6 WHEN tsval_samples > 0 THEN 0.0 WHEN syn + synack > 0 THEN 0.25 ELSE 0.6 END"

ACKS = f"""SELECT {KEY}, arg_min(tcp_ack, frame_no) AS ack_first, arg_max(tcp_ack, frame_no) AS ack_last, coalesce(sum(step), 0)::BIGINT AS ack_total, count(*) AS ack_samples,
  count(*) FILTER (before > tcp_ack) AS ack_wraps FROM (
  SELECT *, lag(tcp_ack) OVER w AS before, (tcp_ack - lag(tcp_ack) OVER w + 4294967296) % 4294967296 AS step FROM ({{0}}) p WHERE {_tcp(16)} AND tcp_ack IS NOT NULL
  WINDOW w AS (PARTITION BY {KEY} ORDER BY frame_no)) GROUP BY ALL"""

CLOCK = f"""SELECT {KEY}, CASE WHEN n >= 4 AND slope > 0 THEN slope END AS hz, CASE WHEN n < 4 OR vy = 0 THEN 0.0 ELSE r2 END AS r2 FROM (
  SELECT {KEY}, count(*) AS n, regr_slope(y, ts) AS slope, regr_r2(y, ts) AS r2, var_pop(y) AS vy FROM (
    SELECT *, sum(coalesce(step, 0)) OVER (PARTITION BY {KEY} ORDER BY ts, tcp_tsval)::DOUBLE AS y FROM (
      SELECT *, (tcp_tsval - lag(tcp_tsval) OVER (PARTITION BY {KEY} ORDER BY ts, tcp_tsval) + 4294967296) % 4294967296 AS step FROM ({{0}}) p WHERE proto = 'TCP' AND tcp_tsval IS NOT NULL))
  GROUP BY ALL)"""

PRIORS = "(VALUES ('TCP','client',6.0,5.0),('TCP','server',0.18,0.15),('TCP','unknown',1.0,2.0),('UDP','client',2.5,3.0),('UDP','server',0.5,0.6),('UDP','unknown',1.0,2.0)) r(p, s, m, d)"

DEST = f"""SELECT dst_ip, greatest(0.5, max(last_ts) - min(start_ts)) AS w, count(DISTINCT src_ip) AS sources, arg_min(flow_key, flow_seq) AS flow_key, min(flow_seq) AS flow_seq,
    count(*) FILTER (proto = 'TCP' AND syn + synack > 0) AS syn_flows, coalesce(sum(syn) FILTER (proto = 'TCP'), 0) AS syn, coalesce(sum(synack) FILTER (proto = 'TCP'), 0) AS synack,
    coalesce(avg({HALF_OPEN}) FILTER (proto = 'TCP' AND syn + synack > 0), 0) AS ho, coalesce(avg({LIVE_NO_CLOCK}) FILTER (proto = 'TCP' AND syn + synack > 0), 0) AS live,
    count(*) FILTER (proto = 'UDP') AS udp_flows, coalesce(sum(packets) FILTER (proto = 'UDP'), 0) AS udp_packets, coalesce(sum(bytes) FILTER (proto = 'UDP'), 0) AS udp_bytes,
    coalesce(sum(packets) FILTER (proto = 'UDP' AND src_port IN ({PORTS})), 0) AS amp_packets, coalesce(sum(bytes) FILTER (proto = 'UDP' AND src_port IN ({PORTS})), 0) AS amp_bytes,
    count(DISTINCT src_ip) FILTER (proto = 'UDP' AND src_port IN ({PORTS})) AS reflectors,
    count(*) FILTER (slow) AS slow, avg(duration) FILTER (slow) AS slow_s
  FROM (SELECT *, proto = 'TCP' AND dst_port IN (80, 443, 8080, 8443) AND duration > 8 AND byte_rate < 40 AND (http_partial_count > 0 OR (packets > 3 AND mean_size < 80)) AS slow FROM ({{0}}) f) GROUP BY dst_ip"""
ENTROPY = "SELECT dst_ip, CASE WHEN count(*) > 1 THEN -sum(p * log2(p)) / log2(count(*)) ELSE 0.0 END AS entropy FROM (SELECT dst_ip, src_ip, count(*) / sum(count(*)) OVER (PARTITION BY dst_ip) AS p FROM ({0}) f GROUP BY dst_ip, src_ip) GROUP BY dst_ip"


def destinations(source: str) -> str:
    f = flows(source)
    return f"SELECT d.*, e.entropy FROM ({DEST.format(f)}) d JOIN ({ENTROPY.format(f)}) e USING (dst_ip)"


_AMP = "udp_flows > 0 AND amp_packets / greatest(1, udp_packets) > 0.5 AND amp_bytes / greatest(1, amp_packets) > 180 AND udp_bytes / w >= 100000 AND reflectors >= 10"
FLOOD_RULES = {
    "D3_syn_flood": (0, "syn_flood", "syn > 0 AND syn / w >= 40 AND ho > 0.6", "0.4 * least(1.0, syn / w / 40) + 0.25 * ho + 0.2 * entropy + 0.15 * (1 - live)", "least(1.0, drive)", "least(1.0, drive) * (0.7 + 0.3 * (1 - live))"),
    "D4_synack_reflection": (1, "reflection_amplification", "synack > 0 AND synack / w >= 40 AND sources >= 20 AND synack > syn", "0.5 * least(1.0, synack / w / 160) + 0.5 * entropy", "least(1.0, greatest(0.6, drive))", "least(1.0, greatest(0.55, 0.9 * drive))"),
    "D5_udp_amplification": (2, "reflection_amplification", _AMP, "least(1.0, udp_bytes / w / 150000)", "greatest(0.6, drive)", "greatest(0.55, 0.9 * drive)"),
    "D6_udp_flood": (3, "udp_flood", f"udp_flows > 0 AND NOT ({_AMP}) AND udp_packets / w >= 500", "0.6 * least(1.0, udp_packets / w / 1000) + 0.4 * entropy", "least(1.0, drive)", "0.85 * least(1.0, drive)"),
    "D7_slowloris": (4, "slowloris", "slow >= 20", "0.6 * least(1.0, slow / 40.0) + 0.4 * least(1.0, slow_s / 60)", "least(1.0, drive)", "0.9 * least(1.0, drive)"),
}


def flood_rule(name: str, source: str) -> str:
    ordinal, threat, fires, drive, score, confidence = FLOOD_RULES[name]
    return f"SELECT dst_ip, flow_key, flow_seq, {ordinal} AS ordinal, '{threat}' AS threat, round({score}, 4) AS score, round({confidence}, 4) AS confidence FROM (SELECT *, {drive} AS drive FROM ({destinations(source)}) d WHERE {fires})"


def floods(source: str) -> str:
    return " UNION ALL ".join(f"SELECT * FROM ({flood_rule(n, source)})" for n in FLOOD_RULES)


def channels(source: str) -> str:
    return f"""SELECT f.src_ip, f.dst_ip, f.start_ts AS t, f.bytes AS size, f.flow_seq FROM ({flows(source)}) f JOIN (
      SELECT src_ip, dst_ip FROM ({flows(source)}) g GROUP BY ALL HAVING count(*) >= 8 AND avg(CASE WHEN dst_port IN (53, 123, 323) THEN 1.0 ELSE 0.0 END) <= 0.5) c USING (src_ip, dst_ip)"""


def beacons(source: str) -> str:
    return f"""WITH ev AS ({channels(source)}),
    st AS (SELECT src_ip, dst_ip, min(t) AS t0, max(t) - min(t) AS span, count(*) AS n, min(flow_seq) AS flow_seq, CASE WHEN avg(size) > 0 THEN 1 - least(1.0, stddev_pop(size) / avg(size)) ELSE 0.5 END AS size_regularity FROM ev GROUP BY ALL),
    rg AS (SELECT *, greatest(0.5, span / n / 4) AS lo, least(3600.0, span / 2) AS hi FROM st WHERE span > 0),
    pr AS (SELECT src_ip, dst_ip, lo * pow(hi / lo, i / 3999.0) AS period FROM rg, range(4000) x(i) WHERE hi > lo),
    rr AS (SELECT src_ip, dst_ip, period, sqrt(pow(sum(cos(2 * pi() * (t - t0) / period)), 2) + pow(sum(sin(2 * pi() * (t - t0) / period)), 2)) / any_value(n) AS r FROM pr JOIN ev USING (src_ip, dst_ip) JOIN st USING (src_ip, dst_ip) GROUP BY ALL),
    bp AS (SELECT src_ip, dst_ip, max(r) AS best_r, arg_max(period, r) AS period FROM rr GROUP BY ALL),
    gp AS (SELECT * FROM (SELECT src_ip, dst_ip, t - lag(t) OVER (PARTITION BY src_ip, dst_ip ORDER BY t) AS gap FROM ev) WHERE gap > 0),
    md AS (SELECT src_ip, dst_ip, median(gap) AS m FROM gp GROUP BY ALL),
    cv AS (SELECT src_ip, dst_ip, CASE WHEN any_value(m) > 0 THEN 1.4826 * median(abs(gap - m)) / any_value(m) ELSE 1.0 END AS robust_cv FROM gp JOIN md USING (src_ip, dst_ip) GROUP BY ALL),
    al AS (SELECT st.src_ip, st.dst_ip, st.n, st.flow_seq, st.size_regularity, coalesce(robust_cv, 1.0) AS robust_cv, coalesce(best_r, 0.0) AS best_r,
             CASE WHEN best_r IS NULL THEN 1.0 ELSE least(1.0, greatest(1.0, (1 / lo - 1 / hi) * st.span) * exp(-st.n * best_r * best_r)) END AS fap, coalesce(st.span / period, 0.0) AS cycles
           FROM st LEFT JOIN rg USING (src_ip, dst_ip) LEFT JOIN bp USING (src_ip, dst_ip) LEFT JOIN cv USING (src_ip, dst_ip)),
    sc AS (SELECT *, 0.42 * best_r + 0.28 * (1 - fap) + 0.18 * (1 - least(1.0, robust_cv)) + 0.12 * size_regularity AS score FROM al)
    SELECT *, fap < 0.01 AND cycles >= 4 AND score >= 0.62 AS is_beacon, CASE WHEN fap < 0.01 AND cycles >= 4 AND score >= 0.62 THEN score * least(1.0, cycles / 8) ELSE 0.4 * score END AS confidence FROM sc"""


def entropy(text: str) -> str:
    return f"CASE WHEN length({text}) > 0 THEN list_sum(list_transform(list_distinct(string_split({text}, '')), lambda c: -(length({text}) - length(replace({text}, c, ''))) / length({text}) * log2((length({text}) - length(replace({text}, c, ''))) / length({text})))) ELSE 0.0 END"


_TRIM = "lower(trim(qname, '.'))"
SLD = f"CASE WHEN len(string_split({_TRIM}, '.')) >= 2 THEN concat(string_split({_TRIM}, '.')[-2], '.', string_split({_TRIM}, '.')[-1]) ELSE qname END"
LABEL = f"CASE WHEN len(string_split({_TRIM}, '.')) >= 2 THEN string_split({_TRIM}, '.')[-2] ELSE {_TRIM} END"
SUB = f"CASE WHEN suffix({_TRIM}, domain) THEN trim(substr({_TRIM}, 1, length({_TRIM}) - length(domain)), '.') ELSE array_to_string(string_split({_TRIM}, '.')[1:-3], '.') END"


def tunnels(questions: str) -> str:
    return f"""SELECT *, raw >= 0.6 AND mean_len > 15 AS is_tunnel, round(raw, 4) AS score, round(CASE WHEN raw >= 0.6 AND mean_len > 15 THEN raw ELSE 0.6 * raw END, 4) AS confidence FROM (
      SELECT *, 0.2 * least(1.0, mean_len / 40) + 0.12 * least(1.0, greatest(0.0, (mean_entropy - 2.8) / 1.5)) + 0.24 * least(1.0, unique_ratio / 0.6) + 0.18 * exotic_ratio + 0.1 * least(1.0, queries / 30.0 / 20) + 0.16 * least(1.0, queries / 300.0) AS raw FROM (
      SELECT domain, count(*) AS queries, min(frame_no) AS first, coalesce(avg(length(sub)) FILTER (sub <> ''), 0) AS mean_len, coalesce(avg({entropy('sub')}) FILTER (sub <> ''), 0) AS mean_entropy,
        coalesce(count(DISTINCT sub) FILTER (sub <> '') / nullif(count(*) FILTER (sub <> ''), 0), 0) AS unique_ratio, avg(CASE WHEN upper(qtype) IN ('TXT', 'NULL', 'CNAME', 'MX', 'AAAA?') THEN 1.0 ELSE 0.0 END) AS exotic_ratio,
        floor(coalesce(sum(length(sub)) FILTER (sub <> ''), 0) * 0.6)::BIGINT AS uplink_bytes
      FROM (SELECT *, {SUB} AS sub FROM (SELECT *, {SLD} AS domain FROM ({questions}) q)) GROUP BY domain HAVING count(*) >= 15))"""


_BG = "[" + ", ".join(f"'{b}'" for b in COMMON_BIGRAMS) + "]"
_LW = "[" + ", ".join(f"'{w}'" for w in LONG_WORDS) + "]"


def features(names: str) -> str:
    pairs = "list_filter(list_transform(range(1, length(label)), lambda i: substr(label, i, 2)), lambda b: regexp_full_match(b, '[a-z]{2}'))"
    return f"""SELECT *, round({entropy('label')}, 3) AS entropy, length(label) AS label_length,
        round(CASE WHEN length(label) > 0 THEN len(regexp_extract_all(label, '[0-9]')) / length(label) ELSE 0 END, 3) AS digit_ratio,
        round(CASE WHEN len(regexp_extract_all(label, '[a-z]')) > 0 THEN len(regexp_extract_all(label, '[aeiou]')) / len(regexp_extract_all(label, '[a-z]')) ELSE 0 END, 3) AS vowel_ratio,
        coalesce(list_max(list_transform(regexp_extract_all(label, '[b-df-hj-np-tv-z]+'), lambda r: length(r))), 0) AS max_cons_run,
        round(CASE WHEN len({pairs}) > 0 THEN len(list_filter({pairs}, lambda b: list_contains({_BG}, b))) / len({pairs}) ELSE 0 END, 3) AS englishness,
        len(list_filter({_LW}, lambda w: contains(label, w))) AS dict_word_hits
      FROM (SELECT *, {LABEL} AS label FROM ({names}) n)"""


_GATE = "greatest(0.0, least(1.0, (label_length - 8) / 4))"
#: What drives the score, by name.
PARTS = {
    "entropy": "1.4 * greatest(0.0, entropy - 3.1)", "non_englishness": f"3.8 * (1 - englishness) * {_GATE}", "digit_ratio": "3 * digit_ratio", "cons_run": f"0.4 * greatest(0, max_cons_run - 5) * {_GATE}",
    "length": "0.2 * greatest(0, label_length - 11)", "low_vowel": f"greatest(0.0, 0.30 - vowel_ratio) * {_GATE}", "dict_words": "CASE WHEN dict_word_hits >= 3 THEN 1.4 ELSE 0.0 END",
}


def dga(names: str) -> str:
    return f"""SELECT *, round(raw, 4) AS prob, raw >= 0.5 AS is_dga, CASE WHEN label_length >= 5 AND dict_word_hits >= 3 AND englishness > 0.4 THEN 'dictionary' WHEN raw >= 0.5 THEN 'arithmetic/hash' ELSE 'benign' END AS family
      FROM (SELECT *, CASE WHEN label_length < 5 THEN 0.0 ELSE 1 / (1 + exp(-(-2.6 + {' + '.join(PARTS.values())}))) END AS raw FROM ({features(names)}) f)"""


def contributions(names: str) -> str:
    parts = ", ".join(f"{{'k': '{k}', 'c': ({v})::DOUBLE}}" for k, v in PARTS.items())
    return f"SELECT frame_no, qname, p.k AS feature, round(p.c / total, 3) AS share FROM (SELECT frame_no, qname, unnest(ps) AS p, list_sum(list_transform(ps, lambda x: x.c)) AS total FROM (SELECT frame_no, qname, list_filter([{parts}], lambda x: x.c > 0) AS ps FROM ({features(names)}) f WHERE label_length >= 5))"


def unaligned(source: str, window_s: int) -> str:
    """Windows per destination, each opened by the packet that overflowed the last."""
    return f"""WITH RECURSIVE p AS ({source}),
    s AS (SELECT dst_ip, 0::BIGINT AS no, min(frame_no) AS f, arg_min(ts, frame_no) AS t FROM p GROUP BY dst_ip
      UNION ALL SELECT p.dst_ip, any_value(s.no) + 1, min(p.frame_no), arg_min(p.ts, p.frame_no) FROM s JOIN p ON p.dst_ip = s.dst_ip AND p.frame_no > s.f AND p.ts - s.t >= {window_s} GROUP BY p.dst_ip),
    w AS (SELECT *, lead(f) OVER (PARTITION BY dst_ip ORDER BY no) AS g FROM s)
    SELECT w.dst_ip AS sensor_id, w.no AS window_no, any_value(w.t) AS window_start, count(*) AS packets, sum(p.length)::BIGINT AS bytes FROM w JOIN p ON p.dst_ip = w.dst_ip AND p.frame_no >= w.f AND (w.g IS NULL OR p.frame_no < w.g) GROUP BY w.dst_ip, w.no"""


def policy(requests: str, log: str) -> str:
    """Requests (source, t, seq, level) and a log (source, t, seq, op, expires) replayed one by one for each source; rule is what decided, null for the
    log's own rows, and k and e the source's rule and its end afterwards."""
    now = "CASE WHEN st.k = 'temporary' AND st.e <= ev.t THEN 'none' ELSE st.k END"
    return f"""WITH RECURSIVE al AS (SELECT source, t, 0 AS kind, seq, op, expires, NULL::DOUBLE AS level FROM ({log}) l UNION ALL SELECT source, t, 1, seq, NULL, NULL, level FROM ({requests}) r),
    ev AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY t, kind, seq) AS i FROM al),
    st AS (SELECT DISTINCT source, 0::BIGINT AS i, 0::BIGINT AS seq, 0.0::DOUBLE AS t, NULL::VARCHAR AS rule, 'none' AS k, 0.0::DOUBLE AS e, false AS auto FROM ev
      UNION ALL SELECT source, i, seq, t, rule, CASE WHEN rule = 'high' THEN 'temporary' WHEN kind = 1 THEN k WHEN op IN ('allow', 'block', 'temporary') THEN op
          WHEN (op = 'disallow' AND k = 'allow') OR (op = 'unblock' AND k = 'block') OR (op = 'remove' AND k = 'temporary') THEN 'none' ELSE k END,
        CASE WHEN rule = 'high' THEN t + 300 WHEN op = 'temporary' THEN expires ELSE e END, rule = 'high' OR (auto AND kind = 1)
      FROM (SELECT *, CASE WHEN kind = 1 THEN CASE WHEN k = 'allow' THEN 'allowlist' WHEN k = 'block' THEN 'blocklist' WHEN k = 'temporary' THEN 'temporary' WHEN level >= 0.9 THEN 'critical' WHEN level >= 0.6 THEN 'high' WHEN level >= 0.3 THEN 'monitor' ELSE 'default' END END AS rule
        FROM (SELECT ev.*, {now} AS k, st.e, st.auto FROM st JOIN ev ON ev.source = st.source AND ev.i = st.i + 1)))
    SELECT source, seq, t, rule, k, e FROM st WHERE i > 0"""


def questions() -> str:
    """DNS questions of both kinds: the dns adapter and single names."""
    return f"SELECT frame_no, ts, src_ip, dst_ip, qname, qtype FROM ({duck('dns')}) d UNION ALL SELECT frame_no, 0.0, '10.9.0.2', '192.0.2.53', qname, 'A' FROM ({duck('labels_mix')}) l"


def excluded() -> str:
    q = questions()
    return f"SELECT domain FROM ({tunnels(q)}) t WHERE is_tunnel UNION SELECT domain FROM (SELECT {SLD} AS domain, qname FROM ({q}) q) GROUP BY domain HAVING count(DISTINCT qname) >= 12"


def candidates() -> str:
    return f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {LABEL} ORDER BY frame_no, qname) AS rn FROM (SELECT *, {SLD} AS domain FROM ({questions()}) q)
      WHERE domain NOT IN ({excluded()})) WHERE rn = 1"""


SEVERITY = "CASE WHEN confidence >= 0.85 THEN 'critical' WHEN confidence >= 0.7 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' WHEN confidence >= 0.3 THEN 'low' ELSE 'info' END"


def alerts() -> str:
    mixed = f"{duck('pkt_flood')} UNION ALL {duck('pkt_beacon')}"
    return f"""SELECT *, {SEVERITY} AS severity FROM (
      SELECT 1 AS branch, 'floods' AS detector, threat, confidence, concat('*->', dst_ip) AS flow_key, dst_ip AS subject, flow_seq * 8 + ordinal AS seq FROM ({floods(mixed)})
      UNION ALL SELECT 2, 'beaconing', 'c2_beaconing', round(confidence, 4), concat(src_ip, '->', dst_ip), src_ip, flow_seq FROM ({beacons(mixed)}) WHERE is_beacon
      UNION ALL SELECT 3, 'dns_tunnel', 'dns_tunnelling', confidence, concat('*->', domain), domain, first FROM ({tunnels(questions())}) WHERE is_tunnel
      UNION ALL SELECT 4, 'dga', 'dga_domain', prob, concat(src_ip, '->', dst_ip), qname, frame_no FROM ({dga(candidates())}) WHERE is_dga)"""


NONCONF = "(1 - score) * (1 + 0.5 * uncertainty)"
FIT = f"""SELECT class, n, q, greatest(0.0, 1 - q) AS threshold FROM (SELECT class, any_value(n) AS n, min(x) FILTER (k = least(n, greatest(1, ceil((n + 1) * 0.9)))) AS q FROM (
  SELECT class, {NONCONF} AS x, row_number() OVER (PARTITION BY class ORDER BY {NONCONF}) AS k, count(*) OVER (PARTITION BY class) AS n FROM ({duck('scores')}) s WHERE part = 'fit') GROUP BY class)"""

HOST = "CASE WHEN split_part(coalesce(flow_key, ''), ':', 1) = '' OR split_part(flow_key, ':', 1) LIKE '*%' THEN 'unknown' ELSE split_part(flow_key, ':', 1) END"


def groups() -> str:
    return f"""SELECT *, CASE WHEN threat_score >= 85 THEN 'critical' WHEN threat_score >= 70 THEN 'high' WHEN threat_score >= 50 THEN 'medium' WHEN threat_score >= 30 THEN 'low' ELSE 'info' END AS severity FROM (
      SELECT host, bucket, count(*) AS alerts, count(DISTINCT detector) AS detectors, min(ts) AS first_ts, max(ts) AS last_ts, round(max(confidence), 4) AS confidence,
        least(100, round_even(70 * max(confidence) + least(30, 15 * (count(DISTINCT detector) - 1)), 0))::INTEGER AS threat_score
      FROM (SELECT *, {HOST} AS host, floor(ts / 300)::BIGINT AS bucket FROM ({duck('alerts')}) a) GROUP BY host, bucket)"""


def merkle(leaves: str) -> str:
    """Root of up to 8 leaves in a list column, unrolled."""
    pair = lambda x: f"CASE WHEN len({x}) > 1 THEN list_transform(range(1, (len({x}) + 1) // 2 + 1), lambda i: sha256(unhex({x}[2 * i - 1]) || unhex(coalesce({x}[2 * i], {x}[2 * i - 1])))) ELSE {x} END"
    return f"(SELECT l3[1] FROM (SELECT {pair('l2')} AS l3 FROM (SELECT {pair('l1')} AS l2 FROM (SELECT {pair('l0')} AS l1 FROM (SELECT {leaves} AS l0)))))"


def json_text(x: str) -> str:
    """A text in canonical JSON, character by character; a null stays null."""
    unit = lambda n: f"chr(92) || 'u' || lpad(lower(to_hex({n})), 4, '0')"
    short = " ".join(f"WHEN {n} THEN '{t}'" for n, t in {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r", 34: '\\"', 92: "\\\\"}.items())
    one = f"CASE unicode(c) {short} ELSE CASE WHEN unicode(c) BETWEEN 32 AND 126 THEN c WHEN unicode(c) < 65536 THEN {unit('unicode(c)')} ELSE {unit('(unicode(c) - 65536) // 1024 + 55296')} || {unit('(unicode(c) - 65536) % 1024 + 56320')} END END"
    return f"""CASE WHEN {x} IS NOT NULL THEN '"' || CASE WHEN {x} = '' THEN '' ELSE array_to_string(list_transform(string_split({x}, ''), lambda c: {one}), '') END || '"' END"""


def json_double(x: str) -> str:
    s = f"({x})::DOUBLE::VARCHAR"
    whole, part, power = f"regexp_extract({s}, '^-?([0-9]+)', 1)", f"regexp_extract({s}, '\\.([0-9]+)', 1)", f"regexp_extract({s}, '[eE]([+-]?[0-9]+)$', 1)"
    digits = f"ltrim({whole} || {part}, '0')"
    short = f"rtrim({digits}, '0')"
    return f"CASE WHEN {s} LIKE '-%' THEN '-' ELSE '' END || CASE WHEN {short} = '' THEN '0e0' ELSE {short} || 'e' || (coalesce(try_cast({power} AS INTEGER), 0) - length({part}) + length({digits}) - length({short})) END"


def json_object(**fields: str) -> str:
    """Fields are SQL that gives JSON or null."""
    return "concat('{', " + ", ',', ".join(f"'\"{k}\":', coalesce({v}, 'null')" for k, v in sorted(fields.items())) + ", '}')"


#: What the alerts adapter's rows say besides: nulls, nothing, separators, quotes, and characters beyond ASCII.
NOTE = "CASE seq % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'x|flow=y' WHEN 3 THEN concat('say \"', detector, chr(92), '\"') WHEN 4 THEN concat('é', chr(10), chr(127), '😀') ELSE 'null' END"


def bundle() -> str:
    alert = json_object(confidence=json_double("confidence"), detector=json_text("detector"), flow_key=json_text("flow_key"), note=json_text(NOTE), seq="seq::VARCHAR", threat=json_text("threat"))
    return json_object(alert=alert, flow=json_object(key=json_text("flow_key")), features=json_object(ts=json_double("ts")), model="'\"rules@1\"'", pkt_root="'\"' || sha256('-') || '\"'")


def blocks() -> str:
    return f"""SELECT detector AS sensor_id, n // 8 + 1 AS "index", max(ts) AS ts, list(digest ORDER BY n) AS digests FROM (
      SELECT *, sha256({bundle()}) AS digest, row_number() OVER (PARTITION BY detector ORDER BY seq) - 1 AS n FROM ({duck('alerts')}) a) GROUP BY detector, n // 8 + 1"""


def proofs() -> str:
    """One row per bundle: the steps from its digest to its block's root, where they lead, and where they lead from the wrong digest."""
    pair = lambda x: f"CASE WHEN len({x}) > 1 THEN list_transform(range(1, (len({x}) + 1) // 2 + 1), lambda i: sha256(unhex({x}[2 * i - 1]) || unhex(coalesce({x}[2 * i], {x}[2 * i - 1])))) ELSE {x} END"
    place = lambda i: f"(index // {1 << i})"
    beside = lambda i: f"(CASE WHEN {place(i)} % 2 = 0 THEN {place(i)} + 1 ELSE {place(i)} - 1 END)"
    steps = ", ".join(f"CASE WHEN len(l{i}) > 1 THEN {{'side': CASE WHEN {beside(i)} > {place(i)} THEN 'R' ELSE 'L' END, 'sibling': coalesce(l{i}[{beside(i)} + 1], l{i}[{place(i)} + 1])}} END" for i in range(3))
    end = "list_reduce(list_prepend({0}, list_transform(steps, lambda s: s.side || s.sibling)), lambda h, s: CASE WHEN s[1] = 'R' THEN sha256(unhex(h) || unhex(s[2:])) ELSE sha256(unhex(s[2:]) || unhex(h)) END)"
    return f"""SELECT *, {end.format('leaf')} = root AS verified, {end.format("sha256('another')")} = root AS wrong FROM (
      SELECT sensor_id, block, index, l0[index + 1] AS leaf, l3[1] AS root, list_filter([{steps}], lambda s: s IS NOT NULL) AS steps FROM (
      SELECT *, {pair('l2')} AS l3, unnest(range(len(l0))) AS index FROM (SELECT *, {pair('l1')} AS l2 FROM (SELECT *, {pair('l0')} AS l1 FROM (SELECT sensor_id, "index" AS block, digests AS l0 FROM ({blocks()}) b)))))"""


def header(index: str, ts: str, prev: str, root: str, sensor: str) -> str:
    quoted = lambda x: f"concat('\"', {x}, '\"')"
    return f"sha256({json_object(index=f'({index})::VARCHAR', merkle_root=quoted(root), prev_hash=quoted(prev), sensor_id=json_text(sensor), ts=f'CAST({ts} AS DECIMAL(20, 6))::VARCHAR')})"


def chain() -> str:
    zero, genesis = "repeat('0', 64)", "sha256('genesis')"
    return f"""WITH RECURSIVE bl AS (SELECT sensor_id, "index", ts, {merkle('digests')} AS root FROM ({blocks()}) b),
    ch AS (SELECT DISTINCT sensor_id, 0::BIGINT AS "index", 0.0::DOUBLE AS ts, {genesis} AS merkle_root, {zero} AS prev_hash, {header('0', '0.0', zero, genesis, 'sensor_id')} AS header_hash FROM bl
      UNION ALL SELECT bl.sensor_id, bl."index", bl.ts, bl.root, ch.header_hash, {header('bl."index"', 'bl.ts', 'ch.header_hash', 'bl.root', 'bl.sensor_id')} FROM ch JOIN bl ON bl.sensor_id = ch.sensor_id AND bl."index" = ch."index" + 1)
    SELECT * FROM ch"""


def hmac(key: bytes, message: str) -> str:
    pads = ["".join(f"\\x{b ^ p:02X}" for b in key.ljust(64, b"\0")) for p in (0x36, 0x5C)]
    return f"sha256('{pads[1]}'::BLOB || unhex(sha256('{pads[0]}'::BLOB || encode({message}))))"
