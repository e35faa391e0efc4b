import hashlib
import hmac
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oneway.functions import fixtures as X
from oneway.functions.lexical import COMMON_BIGRAMS, LONG_WORDS, entropy, fnv1a, heuristic_label, label_features, model_label, second_level, subdomain
from oneway.operators import beacon as BE
from oneway.operators import conformal as CO
from oneway.operators import estimators as ES
from oneway.operators import flows as FW
from oneway.operators import ledger as LE
from oneway.operators import metrics as ME
from oneway.operators import policy as PO
from oneway.operators import profile as PR
from oneway.operators import tunnel as TU
from oneway.operators.alerts import dga_candidates, excluded_domains, packet_hashes
from oneway.operators.dga import NgramNet, model_inputs, score_names, score_with_net, train_net
from oneway.operators.floods import flood_findings
from oneway.operators.shared import written
from oneway.operators.tunnel import score_tunnels
from oneway.plans.adapters import adapter
from oneway.schema import ACK


def one(df):
    return df.collect()[0]


def test_adapters_read_all_events(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    names = adapter(spark, sf_dir, "labels_mix").where("frame_no < 200000000")
    assert adapter(spark, sf_dir, "pkt_beacon").count() == names.count() == events
    assert names.where("qname like '%.com'").count() > 0


def test_flow_counts(spark):
    packets = [X.packet(i, "10.0.0.1", "10.0.0.2", length=100, tcp_flags=ACK, tcp_ack=1 + 500 * i) for i in range(5)]
    f = one(FW.flows(X.frame(spark, packets)))
    assert (f.packets, f.bytes, f.ack_samples, f.duration, f.flow_key) == (5, 500, 5, 4.0, "10.0.0.1:40000->10.0.0.2:443/TCP")


def test_first_and_last_follow_arrival(spark):
    packets = [X.packet(t, "a", "b") for t in (5.0, 1.0, 3.0)]
    f = one(FW.flows(X.frame(spark, packets, sort=False)))
    assert (f.start_ts, f.last_ts, f.duration) == (5.0, 3.0, 0.0)


@pytest.mark.parametrize("first, wraps", [(1, 0), (2**32 - 50_000, 1)])
def test_reverse_bytes(spark, first, wraps):
    packets, total = X.reconstruction(3, 40, 100_000, first)
    r = one(FW.ack_progress(X.frame(spark, packets)))
    assert (r.ack_total, r.ack_wraps, r.ack_samples) == (total, wraps, 40)
    assert one(FW.ack_progress_monotone(X.frame(spark, packets))).ack_total == total
    e = one(ES.estimate(X.frame(spark, packets)))
    assert e.by_acks and e.reverse_bytes == total and math.isclose(e.uncertainty, 1 / math.sqrt(40))


def test_stale_acks_are_skipped(spark):
    acks = [100, 50, 200, 150, 200, 2**31 + 150, 300]
    r = one(FW.ack_progress(X.frame(spark, [X.packet(i, "a", "b", tcp_flags=ACK, tcp_ack=a) for i, a in enumerate(acks)])))
    last, total = acks[0], 0
    for a in acks[1:]:
        d = (a - last) % 2**32
        if 0 < d < 2**31:
            last, total = a, total + d
    assert (r.ack_total, r.ack_last, r.ack_samples) == (total, last, 7)


def test_clock(spark):
    packets = [X.packet(i * 0.1, "a", "b", tcp_tsval=(2**32 - 3000 + 100 * i) % 2**32) for i in range(80)] + [X.packet(8.05, "a", "b", tcp_tsval=5)]
    rows = FW.tsval_lists(X.frame(spark, packets)).withColumn("c", ES.clock("tsvals"))
    c = one(rows).c
    assert math.isclose(c.hz, 1000, rel_tol=0.02) and c.r2 > 0.99
    flat = FW.tsval_lists(X.frame(spark, [X.packet(i, "a", "b", tcp_tsval=7) for i in range(9)])).withColumn("c", ES.clock("tsvals"))
    assert one(flat).c.r2 == 0 and one(flat).c.hz is None
    few = FW.tsval_lists(X.frame(spark, [X.packet(i, "a", "b", tcp_tsval=i) for i in range(3)])).withColumn("c", ES.clock("tsvals"))
    assert one(few).c.hz is None


def test_liveness(spark):
    syn = ES.estimate(X.frame(spark, [X.packet(0, "a", "b", tcp_flags=2)]))
    live = ES.estimate(X.frame(spark, [X.packet(i * 0.1, "a", "b", tcp_flags=16, tcp_tsval=int(i * 100)) for i in range(12)]))
    assert one(syn).liveness < 0.5 and one(live).liveness > 0.8


def test_rtt(spark):
    rows = FW.arrival_lists(X.frame(spark, [X.packet(t, "a", "b") for t in (0, 0.05, 0.15, 10)]))
    assert one(rows.select(ES.passive_rtt("arrivals", F.lit(1)).alias("r"))).r == 50.0
    assert one(rows.select(ES.passive_rtt("arrivals", F.lit(0)).alias("r"))).r is None


def test_beacons(spark):
    def events(times):
        return spark.createDataFrame([("s", "d", float(t), 512, 443, i) for i, t in enumerate(times)], "src_ip string, dst_ip string, start_ts double, bytes long, dst_port int, flow_seq long")

    r = one(BE.score_beacons(events(range(0, 900, 60))))
    assert r.is_beacon and abs(r.period - 60) < 1
    rng, alarms = random.Random(1), 0
    rows = []
    for trial in range(50):
        t = 0.0
        for i in range(15):
            t += rng.expovariate(1 / 60)
            rows.append((f"s{trial}", "d", t, 512, 443, i))
    frame = spark.createDataFrame(rows, "src_ip string, dst_ip string, start_ts double, bytes long, dst_port int, flow_seq long")
    assert BE.score_beacons(frame).where("is_beacon").count() <= 2
    assert BE.score_beacons(events([0, 60, 120])).count() == 0


def test_pairs_of_letters_overlap(spark):
    """Pairs and words of a label are counted as one by one in Python, without an array per label."""
    labels = ["", "a", "the", "thethere", "ananan", "x9th-er", "ßthé", "th\nhe", "securecloudmoney", "zzqqxj", "moneymoney", "a1b2c3", None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, label string")
    frame = rows.withColumns(label_features(F.col("label")))
    for r in frame.collect():
        pairs = [r.label[i : i + 2] for i in range(len(r.label) - 1)] if r.label else []
        pairs = [x for x in pairs if all("a" <= c <= "z" for c in x)]
        assert r.englishness == (round(sum(x in COMMON_BIGRAMS for x in pairs) / len(pairs), 3) if pairs else 0.0)
        assert r.dict_word_hits == sum(w in (r.label or "") for w in LONG_WORDS)
    plan = frame.select("englishness", "dict_word_hits")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan  # functions over arrays are not compiled


def test_few_periods_are_evaluated_and_none_is_lost():
    """What the series rules out never has the strongest resultant; the others are evaluated to the bit as in the whole spectrum."""
    rng, kept = np.random.default_rng(5), []
    for n in (8, 25, 25, 25, 90, 300, 3000):
        for jitter in (0.0, 0.3, 3.0):
            t = np.sort(60.0 * np.arange(n) + 60 * jitter * (rng.random(n) - 0.5))
            t = t - t[0]
            lo, hi = BE.period_range(t[-1], n)
            which = BE.near_strongest(t, lo, hi)
            c, s = BE.resultant(t, lo, hi)
            few = BE.resultant(t, lo, hi, which)
            assert np.argmax(np.hypot(c, s)) in which and np.array_equal(few[0], c[which]) and np.array_equal(few[1], s[which])
            assert BE._spectrum(*few, n, lo, hi, t[-1], which) == BE._spectrum(c, s, n, lo, hi, t[-1])
            kept.append(len(which))
    assert max(kept[:12]) < 100 and kept[-1] == BE.N_PERIODS
    assert len(BE.near_strongest(np.array([0.0, 0.0]), 0.5, 9.0)) == BE.N_PERIODS


def test_single_precision_rules_periods_out_and_none_is_lost():
    """Channels of many events, which the series leaves as they are: few periods are evaluated in full, with the same outcome to the bit."""
    rng = np.random.default_rng(6)
    for n in (300, 1500, 3000):
        for jitter in (0.0, 0.3, 3.0, 300.0):
            t = np.sort(60.0 * np.arange(n) + 60 * jitter * (rng.random(n) - 0.5))
            t = t - t[0]
            lo, hi = BE.period_range(t[-1], n)
            which = BE.candidates(t, lo, hi)
            assert len(which) < 400
            assert BE._spectrum(*BE.resultant(t, lo, hi, which), n, lo, hi, t[-1], which) == BE._spectrum(*BE.resultant(t, lo, hi), n, lo, hi, t[-1])
    assert len(BE.candidates(np.array([0.0, 1.0, 1e12]), 0.5, 3600.0)) == BE.N_PERIODS  # turns of such phases have no digits left


def test_channels_are_spread_over_more_tasks_than_their_join(spark):
    rows = [(f"s{i % 40}", "d", 7.0 * i, 100, 443, i) for i in range(800)]
    frame = spark.createDataFrame(rows, "src_ip string, dst_ip string, start_ts double, bytes long, dst_port int, flow_seq long")
    plan = BE.score_beacons(frame)._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan.split("== Physical Plan ==")[1]


def test_a_condition_on_the_score_repeats_no_feature(spark):
    names = spark.createDataFrame([(i, f"xk{i}mz9qp2vw7bnrt.info") for i in range(3)], "frame_no long, qname string")
    plan = score_names(names).where("is_dga").select("frame_no", "prob", "family")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct") == 1


def test_questions_without_flow_keys_are_not_sorted_and_stay_in_place(spark):
    q = spark.createDataFrame([(i, f"{'abcdefgh'[i % 8]}{i}.{'Many' if i % 2 else 'few' + str(i)}.org.", "A", 0.0, "c", "d") for i in range(60)], "frame_no long, qname string, qtype string, ts double, src_ip string, dst_ip string")
    table = TU.domains(q)
    assert "SortAggregate" not in table._jdf.queryExecution().toString()
    rows = {r.domain: r for r in table.collect()}
    assert len(rows) == 31 and rows["many.org"].distinct_names == 30 and rows["many.org"].first == 1 and rows["few2.org"].flow_key is None
    keyed = {r.domain: r for r in TU.domains(q.withColumn("flow_key", F.concat(F.lit("k"), "frame_no"))).collect()}
    assert keyed["many.org"].flow_key == "k1"
    tunnels = TU.scored(table)
    excluded = written(excluded_domains(q, tunnels, (), table), "excluded")
    assert [r.domain for r in excluded.collect()] == [r.domain for r in excluded_domains(q, tunnels).collect()] == ["many.org"]
    rows = dga_candidates(q, tunnels, (), excluded)
    assert "BroadcastHashJoin" in rows._jdf.queryExecution().toString()
    assert sorted(map(str, rows.collect())) == sorted(map(str, dga_candidates(q, tunnels).collect())) and rows.count() == 30


@pytest.mark.parametrize("name", ["", ".", "..", "A", "com.", ".com", "a..B", "x.y.Z.", "..a.b", "A.b..", "a. .c"])
def test_labels_are_cut_as_by_splitting(spark, name):
    q = F.lit(name)
    parts = name.strip(".").lower().split(".")
    told = spark.range(1).select(second_level(q).alias("s"), heuristic_label(q).alias("h"), model_label(q).alias("m")).first()
    assert tuple(told) == (".".join(parts[-2:]) if len(parts) > 1 else name, parts[-2] if len(parts) > 1 else parts[0], parts[0])


def test_rayleigh_in_slices(spark, monkeypatch):
    rows = [("s", "d", 7.0 * i + (i % 3) * 0.1, 100, 443, i) for i in range(60)]
    frame = spark.createDataFrame(rows, "src_ip string, dst_ip string, start_ts double, bytes long, dst_port int, flow_seq long")
    whole = one(BE.rayleigh(BE.channel_events(frame)))
    monkeypatch.setattr(BE, "SLICE", 10)
    cut = one(BE.rayleigh(BE.channel_events(frame)))
    assert math.isclose(whole.best_r, cut.best_r) and math.isclose(whole.period, cut.period)


def test_names(spark):
    rows = spark.createDataFrame([("xk4mz9qp2vw7bnrt.info",), ("google.com",), ("WWW.Example.co.",), ("bare",)], "qname string")
    got = {r.qname: r for r in score_names(rows).collect()}
    assert got["xk4mz9qp2vw7bnrt.info"].is_dga and not got["google.com"].is_dga
    assert math.isclose(sum(got["xk4mz9qp2vw7bnrt.info"].contributions.values()), 1, abs_tol=0.01)
    q = F.col("qname")
    labels = {r.qname: r[1:] for r in rows.select("qname", second_level(q), heuristic_label(q), model_label(q)).collect()}
    assert labels["WWW.Example.co."] == ("example.co", "example", "www") and labels["bare"] == ("bare", "bare", "bare")
    sub = spark.createDataFrame([("a.b.example.co", "example.co"), ("xexample.co", "example.co"), ("a.b.c.d", "zz")], "q string, d string").select(subdomain(F.col("q"), F.col("d")).alias("s"))
    assert [r.s for r in sub.collect()] == ["a.b", "x", "a.b"]
    bits = spark.createDataFrame([("aabb",), ("",), (None,), ("éé",)], "t string").select(entropy(F.col("t")).alias("e"))
    assert [r.e for r in bits.collect()] == [1.0, 0.0, 0.0, 0.0]
    assert one(spark.createDataFrame([("abc",)], "t string").select(fnv1a(F.col("t")).alias("h"))).h == 0x1A47E90B


def test_trained_net(spark, tmp_path):
    names = [(n, 1) for n in X.arithmetic_names(5, 150)] + [(f"{w}{v}.org", 0) for w in X.NAMES for v in X.NAMES]
    frame = spark.createDataFrame(names, "qname string, y int")
    data = model_inputs(frame).toPandas()
    net = train_net(data.iloc[::2], epochs=20)
    net.save(str(tmp_path / "net.npz"))
    again = NgramNet.load(str(tmp_path / "net.npz"))
    assert NgramNet.load(str(tmp_path / "none.npz")) is None
    held = spark.createDataFrame(names[1::2], "qname string, y int")
    got = {r.qname: r.is_dga for r in score_with_net(held, again).collect()}
    assert np.mean([got[n] == bool(y) for n, y in names[1::2]]) > 0.9


def test_tunnel_needs_queries(spark):
    q = FW.dns_questions(X.frame(spark, X.tunnel(1, 5)))
    assert score_tunnels(q).count() == 0
    assert one(score_tunnels(FW.dns_questions(X.frame(spark, X.tunnel(1))))).is_tunnel


def test_flood_evidence(spark):
    r = one(flood_findings(FW.flows(X.frame(spark, X.syn_flood(2)))))
    assert r.threat == "syn_flood" and r.evidence["syn_rate_hz"] > 40 and r.evidence["half_open_ratio"] > 0.6


def test_conformal(spark):
    rng = random.Random(5)
    rows = [(i, "c", rng.random(), 0.0) for i in range(400)]
    frame = spark.createDataFrame(rows, "id long, class string, score double, uncertainty double")
    fitted = CO.fit(frame.where("id < 200"))
    x = sorted(1 - r[2] for r in rows[:200])
    assert math.isclose(one(fitted).q, x[math.ceil(201 * 0.9) - 1])
    assert 0.8 <= one(CO.coverage(frame.where("id >= 200"), fitted)).coverage <= 1
    p = {r.id: r.p for r in CO.p_values(frame.where("id >= 200"), frame.where("id < 200")).collect()}
    assert all(math.isclose(p[i], (sum(v >= 1 - s for v in x) + 1) / 201) for i, _, s, _ in rows[200:])
    other = spark.createDataFrame([(1, "new", 0.7, 0.0)], "id long, class string, score double, uncertainty double")
    assert math.isclose(one(CO.p_values(other, frame)).p, 0.3) and one(CO.covered(other, fitted)).covered is False


def py_root(leaves):
    level = leaves or [hashlib.sha256(b"empty").hexdigest()]
    while len(level) > 1:
        level = [hashlib.sha256(bytes.fromhex(level[i]) + bytes.fromhex(level[min(i + 1, len(level) - 1)])).hexdigest() for i in range(0, len(level), 2)]
    return level[0]


def test_merkle(spark):
    sets = [[hashlib.sha256(f"{n}{i}".encode()).hexdigest() for i in range(n)] for n in (0, 1, 2, 3, 9, 64)]
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "k int, leaves array<string>")
    assert [r.merkle_root for r in LE.merkle_root(frame, "leaves").orderBy("k").collect()] == [py_root(s) for s in sets]
    got = LE.proofs(frame.where("k > 0"), "leaves", ["k"]).withColumn("ok", LE.verify_proof(F.col("leaf"), F.col("proof"), F.col("root")))
    rows = got.collect()
    assert len(rows) == 79 and all(r.ok for r in rows)
    wrong = got.where("k = 4 and index = 3").withColumn("bad", LE.verify_proof(F.lit(sets[4][4]), F.col("proof"), F.col("root")))
    assert one(wrong).bad is False
    side = got.where("k = 4 and index = 3").withColumn("bad", LE.verify_proof(F.col("leaf"), F.array(F.struct(F.lit("00").alias("sibling"), F.lit("X").alias("side"))), F.col("root")))
    assert one(side).bad is False


def test_hmac(spark):
    for key in (b"k", b"x" * 100):
        got = one(spark.createDataFrame([("message",)], "m string").select(LE.hmac_sha256(key, F.col("m")).alias("h"))).h
        assert got == hmac.new(key, b"message", "sha256").hexdigest()


def test_chain_shows_tampering(spark):
    rows = [("s1", i, float(i), hashlib.sha256(str(i).encode()).hexdigest()) for i in range(20)] + [("s2", 1, 1.0, "ab" * 32)]
    chain = LE.seal(LE.batches(spark.createDataFrame(rows, "sensor_id string, seq long, ts double, digest string")), b"k").cache()
    ok = {r.sensor_id: r for r in LE.verify_chain(chain, b"k").collect()}
    assert ok["s1"].intact and ok["s1"].blocks == 4 and ok["s2"].blocks == 2
    for change, at in ((("merkle_root", F.lit("00" * 32)), 2), (("signature", F.lit("x")), 2), (("digests", F.array(F.lit("cd" * 32))), 2)):
        bad = chain.withColumn(change[0], F.when((F.col("sensor_id") == "s1") & (F.col("index") == 2), change[1]).otherwise(F.col(change[0])))
        found = {r.sensor_id: r for r in LE.verify_chain(bad, b"k").collect()}
        assert found["s1"].broken_at == at and found["s2"].intact
    assert not one(LE.verify_chain(chain.where("sensor_id = 's2'"), b"other")).intact
    assert LE.bundle_proofs(chain).where("not verified").count() == 0


def test_packet_hashes(spark):
    r = one(packet_hashes(spark.createDataFrame([("k", 70), ], "flow_key string, packets long")))
    assert len(r.packet_hashes) == 64 and r.packet_hashes[1] == hashlib.sha256(b"k:1").hexdigest()


def test_profile_buckets(spark):
    packets = X.frame(spark, [X.packet(t, "a", "b", length=n) for t, n in ((10.0, 20), (10.2, 20), (11.1, 10))])
    assert [r.packets for r in PR.rate_buckets(packets).orderBy("bucket").collect()] == [2, 1]
    p = one(PR.profile(packets, malformed=1))
    assert (p.packets, p.bytes, p.quality_pct) == (3, 50, 75.0)
    gap = X.frame(spark, [X.packet(0, "a", "b"), X.packet(5, "a", "b")])
    assert [r.packets for r in PR.rate_buckets(gap, 2.0).orderBy("bucket").collect()] == [1, 0, 1]
    with pytest.raises(ValueError):
        PR.rate_buckets(packets, 0)


def test_policy(spark):
    requests = spark.createDataFrame([(1, " a ", 10.0, 0.95), (2, "b", 10.0, 0.0), (3, "c", 10.0, 0.2), (4, "c", 100.0, 0.2), (5, "d", 10.0, 0.95), (6, "d", 11.0, 0.7), (7, "d", 12.0, 0.4), (8, "d", 13.0, None)], "seq long, source string, at double, threat_level double")
    allow, block = (spark.createDataFrame(x, "source string") for x in ([("a",)], [("b",), ("a",)]))
    temp = spark.createDataFrame([("c", 0.0, 100.0, "why")], "source string, starts double, expires double, reason string")
    got = {r.seq: (r.action, r.rule) for r in PO.evaluate(requests, allow, block, temp).collect()}
    assert got == {1: ("ALLOW", "allowlist"), 2: ("BLOCK", "blocklist"), 3: ("BLOCK", "temporary"), 4: ("ALLOW", "default"), 5: ("BLOCK", "critical"), 6: ("BLOCK", "high"), 7: ("BLOCK", "temporary"), 8: ("BLOCK", "temporary")}
    high = spark.createDataFrame([("s", t, 0.7) for t in (0.0, 100.0, 299.0, 300.0, 900.0)] + [("b", 0.0, 0.7)], "source string, at double, threat_level double")
    assert sorted(r.starts for r in PO.automatic_rules(high, PO.lists_as_log(allow, block, temp)).collect()) == [0.0, 300.0, 900.0]
    with pytest.raises(Exception, match="outside"):
        spark.createDataFrame([(1.5,)], "x double").select(PO.classify(F.col("x"))).collect()


def test_metrics_edges(spark):
    rows = spark.createDataFrame([(1, 0.1, 0), (2, 0.9, 0)], "id long, score double, label int")
    assert one(ME.auc(rows)).auc == 0.5
    both = spark.createDataFrame([(i, i / 10, int(i >= 5)) for i in range(10)], "id long, score double, label int")
    assert one(ME.auc(both)).auc == 1.0 and one(ME.average_precision(ME.pr_curve(both))).average_precision > 0.99
    assert ME.gate(0.95, 0.01, 0.97) == [] and ME.gate(0.5, 0.2, 0.5) == ["macro F1", "false-alarm rate", "AUC"]
