import base64
import gzip
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from oneway.llm import arc_warc as A
from oneway.llm import sharding as SH
from oneway.llm import topk as TK
from oneway.llm import toxicity as TX
from oneway.llm import url_filter as U
from oneway.llm.mixing import apportion, mix_sources, targets
from oneway.llm.queries import URL_RULES
from oneway.llm.textkit import Words
from tests.llm.cases import cluttered, docs, empty, words


def brute_shards(keys, sizes, limit):
    bits = [format(int(hashlib.md5(str("" if k is None else k).encode()).hexdigest()[:15], 16), "060b") for k in keys]
    out = []
    for b in bits:
        depth = next(d for d in range(61) if sum(s for x, s in zip(bits, sizes) if x[:d] == b[:d]) <= limit or len({x for x in bits if x[:d] == b[:d]}) == 1)
        out.append(b[:depth])
    return out


def test_shards(spark):
    rows = [(i, words(1 + i % 50, i), "en", "a", 0) for i in range(300)] + [(999, words(900, 7), "en", "a", 0)]
    for limit in (2000, 10**9):
        got = {r.doc_id: r for r in SH.extendible_shards(cluttered(docs(spark, rows), "shard", "depth", "page"), limit).collect()}
        want = brute_shards([r[0] for r in rows], [len(r[1]) for r in rows], limit)
        assert [got[r[0]].shard.split("+")[0] for r in rows] == want
        by = Counter()
        for r in got.values():
            by[r.shard] += r.bytes
        assert all(n <= limit or sum(r.shard == s for r in got.values()) == 1 for s, n in by.items())
    assert SH.extendible_shards(empty(spark), 1000).count() == 0


def test_shards_overflow(spark):
    """One key with a third of all rows fills pages; nulls and repeated rows too."""
    rows = [(5, "x" * 40, "en", "a", 0)] * 50 + [(None, "y" * 30, "en", "a", 0)] * 20 + [(i, "z" * 10, "en", "a", 0) for i in range(100, 180)] + [(7, None, "en", "a", 0)]
    got = SH.extendible_shards(docs(spark, rows).repartition(5), 200).collect()
    by = Counter()
    for r in got:
        by[r.shard] += r.bytes
    assert len(got) == len(rows) and max(by.values()) <= 200


def test_shards_overflow_before_the_last_round(spark):
    """Pages of a key that settles in the first round stay pages if other cells go on splitting."""
    bits = lambda k: format(int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16), "060b")
    key = {bits(k)[:12]: k for k in range(2000)}
    one, two = next((k, key[bits(k)[:12]]) for k in range(2000) if key[bits(k)[:12]] != k and bits(k)[:12] != bits(5)[:12])
    rows = [(5, "x" * 40, "en", "a", 0)] * 50 + [(one, "y" * 150, "en", "a", 0), (two, "z" * 150, "en", "a", 0)]
    got = SH.extendible_shards(docs(spark, rows), 200).collect()
    by = Counter()
    for r in got:
        by[r.shard] += r.bytes
    assert len(got) == len(rows) and max(by.values()) <= 200 and max(r.depth for r in got) > 12


def test_write_shards(spark, tmp_path):
    sharded = SH.extendible_shards(docs(spark), 3000)
    SH.write_shards(sharded, str(tmp_path / "s"))
    back = SH.read_shards(spark, str(tmp_path / "s"), sharded.schema)
    key = lambda rows: sorted(map(str, rows))
    assert back.columns == sharded.columns and key(back.collect()) == key(sharded.collect())
    assert {f.name for f in (tmp_path / "s").glob("folder=*")} == {f"folder=s{r.shard}" for r in sharded.select("shard").distinct().collect()}


def test_arc_versions_and_warc_bytes():
    for version in (1, 2):
        block = A.http_block(3, b"<p>hi\nthere</p>")
        data = A.arc_filedesc(version, "f.arc", "20240102030405") + b"\n" + A.arc_header(version, "http://a b/".replace(" ", "%20"), "1.2.3.4", "20240102", "text/html", len(block)) + block + b"\n" + b"not a header\n"
        data += A.arc_header(version, "dns:a", "1.2.3.4", "2024", "text/dns", 50) + b"cut off"
        rows = list(A.read_arc(data))
        assert [r[1] for r in rows] == [version] * 3 and rows[0][2].startswith("filedesc://") and rows[1][7] == block
        assert rows[2][6] is True and rows[2][7] == b"cut off"
        assert [A.kind_of(r[2], r[7]) for r in rows] == ["warcinfo", "response", "resource"]
    assert A.iso("20240102030405") == "2024-01-02T03:04:05Z" and A.iso("2024") == "2024-01-01T00:00:00Z" and A.iso("") == "1111-01-01T00:00:00Z"
    record = A.warc_record("response", "<urn:uuid:1>", "2024-01-01T00:00:00Z", "http://a/", "1.2.3.4", "text/html", block) + b"\r\n\r\n"
    (headers, back, whole), = A.read_warc(record)
    assert back == block and not whole and headers["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"<p>hi\nthere</p>").digest()).decode()
    assert int(headers["content-length"]) == len(block)
    # cut inside a block: marked; inside a header, or with a length that is none: left out
    assert [(b, t) for _, b, t in A.read_warc(record + record[:-10])] == [(block, False), (block[:-6], True)]
    assert len(list(A.read_warc(record + record[:60]))) == 1 and len(list(A.read_warc(record.replace(b"Content-Length: " + str(len(block)).encode(), b"Content-Length: x", 1)))) == 0


def pages(spark):
    big, bigger = "<p>" + words(300, 1) + "\r\n\r\nWARC/1.1 é</p>", "y" * 1000
    rows = [(1, "http://a.org/", big), (2, "http://b.org/x y", big), (3, None, "small"), (4, "http://c", "small"), (5, "http://d/", None), (6, "http://e/", big), (7, "http://f", bigger), (8, "http://g", bigger), (9, "", "")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archives(spark):
    frame = cluttered(pages(spark), "record", "file", "offset")
    got = {r.page_id: r for r in A.archive_pages(frame).collect()}
    for p in pages(spark).collect():
        raw = (p.html or "").encode()
        r = got[p.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert {k: r.refers_to for k, r in got.items() if r.record_type == "revisit"} == {1: 6, 2: 6, 7: 8} and len(got) == 9
    assert got[2].uri == "http://b.org/x%20y"
    assert A.archive_pages(pages(spark).limit(0)).count() == 0


def test_archives_repeated_and_null_ids(spark):
    text = "q" * 2000
    frame = spark.createDataFrame([(1, "http://a", text), (1, "http://a", text), (None, "http://a", text)], "page_id long, url string, html string")
    got = sorted((r.page_id or -1, r.record_type, r.refers_to) for r in A.archive_pages(frame).collect())
    assert got == [(-1, "revisit", 1), (1, "response", None), (1, "revisit", 1)]


def test_written_archives_are_files(spark, tmp_path):
    A.write_arc(pages(spark).coalesce(1), str(tmp_path / "arc"))
    A.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    files = [f.read_bytes() for f in (tmp_path / "warc").glob("part*") if f.stat().st_size]
    found = [h["warc-type"] for f in files for h, _, _ in A.read_warc(gzip.decompress(f))]
    assert Counter(found)["response"] == 6 and Counter(found)["revisit"] == 3 and "warcinfo" in found
    # a member for each record, then the empty one; and a file that is cut off keeps the records before the cut
    data = files[0]
    members = []
    while data:
        member = zlib.decompressobj(31)
        members.append(member.decompress(data))
        data = member.unused_data
    assert len(members) == len(found) + 1 and all(len(list(A.read_warc(m))) == 1 for m in members[:-1]) and members[-1] == b""
    assert A.plain(files[0][:-60]).startswith(b"WARC/1.1") and A.plain(b"plain") == b"plain"


def test_archives_are_cut_by_bytes(spark, tmp_path):
    """Pages of a megabyte that compress well: a file holds as many as its limit before compression says."""
    rows = [(i, f"http://a.org/{i}", f"{i} " * 250_000) for i in range(40)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    A.write_arc(frame, str(tmp_path / "arc"))
    sizes = [len(A.plain(f.read_bytes())) for f in (tmp_path / "arc").glob("part*")]
    assert len(sizes) >= 2 and max(sizes) < A.FILE_BYTES + (2 << 20)
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in A.archive_pages(frame).collect()}
    assert got == {i: (len(h), hashlib.sha1(h.encode()).hexdigest()) for i, _, h in rows}


def labelled(spark, n=400):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        w = words(60, i, 2000).split()
        for b in rng.choice(["idiot", "Scum!", "moron", "trash"], 3 if toxic else 0):
            w.insert(int(rng.integers(0, 60)), str(b))
        rows.append((i, " ".join(w), "en", "a", 0))
        labels.append((i, int(i % 8 != 0), int(toxic)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = labelled(spark)
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = TX.train(docs(spark, rows), TX.grades_of_labels(frame.where("doc_id % 5 <> 0")))
    extra = [(1000, None, "en", "a", 0), (1001, "", "en", "a", 0), (1002, "you IDIOT, moron; scum", "en", "a", 0), (1002, "you IDIOT, moron; scum", "en", "a", 0)]
    got = defaultdict(list)
    for r in TX.score_toxicity(cluttered(docs(spark, rows + extra), "grade", "toxic"), model).collect():
        got[r.doc_id].append(r)
        assert 0 <= (r.p_severe or 0) <= r.p_toxic <= 1 and math.isclose(r.expected_severity, r.p_toxic + (r.p_severe or 0))
    held = [i for i in range(0, 400, 5)]
    assert sum(got[i][0].toxic == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert not got[1000][0].toxic and not got[1001][0].toxic and [r.toxic for r in got[1002]] == [True, True]
    assert TX.score_toxicity(empty(spark), model).count() == 0


def test_toxicity_scores_by_definition(spark):
    """Every whole text scored word by word in plain Python, thresholds and weights as fitted."""
    rows, labels = labelled(spark, 120)
    rows += [(700, "word " * 30_000 + "IDIOT-scum", "en", "a", 0), (701, "é\u00a0idiot x_y", "en", "a", 0), (702, None, "en", "a", 0)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = TX.train(docs(spark, rows), TX.grades_of_labels(frame))
    weight = dict(zip(model.keys.tolist(), model.weights.tolist()))

    def word_hash(w):
        return int(Words(np.frombuffer(w, np.uint8), np.array([0, len(w)])).hashes()[0])

    for r in TX.score_toxicity(docs(spark, rows), model).collect():
        found = set(re.findall(rb"[0-9A-Za-z\x80-\xff]+", (r.text or "").encode()))
        x = sum(weight.get(h, 0.0) for h in {word_hash(w.lower()) for w in found})
        p = [1 / (1 + math.exp(t - x)) for t in model.theta]
        assert math.isclose(r.p_toxic, p[0], rel_tol=1e-9) and math.isclose(r.p_severe, p[1], rel_tol=1e-9)
        assert math.isclose(r.expected_severity, sum(p), rel_tol=1e-9) and r.grade == math.floor(sum(p) + 0.5) and r.toxic == (p[0] >= 0.5)


def test_toxicity_sample_is_bounded_and_settled(spark, monkeypatch):
    """Of texts that share an id always the same one is taken, and the sample ends where it has words enough."""
    rows = [(i, words(30, i * 10 + j), "en", "a", 0) for i in range(50) for j in range(3)]
    grades = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, grade int")
    one, two = (TX._sample(docs(spark, rows).repartition(n), grades) for n in (1, 5))
    assert [a.tolist() for a in one[0]] == [b.tolist() for b in two[0]] and len(one[0]) == 50
    monkeypatch.setattr(TX, "SAMPLE_WORDS", 200)
    assert 2 <= len(TX._sample(docs(spark, rows), grades)[0]) <= 10


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    nulls = spark.createDataFrame([(0, None, None), (7, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, nulls):
        model = TX.train(docs(spark), TX.grades_of_labels(labels))
        assert not any(r.toxic for r in TX.score_toxicity(docs(spark), model).collect())


def test_ordinal_thresholds_share_weights():
    rng = np.random.default_rng(0)
    keys = np.arange(1, 4, dtype=np.uint64)
    x = rng.integers(0, 2, (600, 3))
    z = x @ np.array([4.0, 2.0, -3.0])
    grade = (z > 1).astype(int) + (z > 4)
    model = TX.fit([keys[r == 1] for r in x], grade)
    assert (np.diff(model.theta) > 0).all() and len(model.theta) == 2
    p = model.at_least(np.linspace(-5, 10, 50))
    assert (np.diff(p, axis=0) >= 0).all() and (p[:, 1] <= p[:, 0]).all()


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0] + [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), h + p, a) for a, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else None


URLS = ["http://A.Example.ORG/es/1", "https://example.org/en/17?x=/es/", "http://x.com/fr/#a", "http://x.com/de/", "http://x.com/xx", "no scheme", None, "http://", "a://b://c/d", "http://notorg/", "http://org", "http://org/", "http://u.com?q", "http://É.org/é"]


def test_url_rules(spark):
    frame = cluttered(spark.createDataFrame([(i, u, None) for i, u in enumerate(URLS)], "page_id long, url string, html string"), "host", "rule")
    got = {r.page_id: r for r in U.judge_urls(frame, URL_RULES).collect()}
    for i, u in enumerate(URLS):
        host, path, rule = brute_url(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule and rule[0]), u
        assert rule is None or got[i].verdict == rule[1]
    assert got[6].verdict == "allow"
    assert U.judge_urls(frame.limit(0), URL_RULES).count() == 0


def brute_ranks(edges, seeds, steps=12, damping=0.85):
    out = {}
    for kind in ("trust", "distrust"):
        flow = [(a, b, w) if kind == "trust" else (b, a, w) for a, b, w in edges]
        flow += [(b, b, 1.0) for b in sorted({b for _, b, _ in flow} - {a for a, _, _ in flow})]  # rank stays where no edge leads on
        total = Counter()
        for a, _, w in flow:
            total[a] += w
        mass = sum(seeds[kind].values())
        start = {h: m / mass for h, m in seeds[kind].items() if m}
        rank = dict(start)
        for _ in range(steps):
            new = Counter({h: (1 - damping) * m for h, m in start.items()})
            for a, b, w in flow:
                new[b] += damping * rank.get(a, 0) * w / total[a]
            rank = new
        out[kind] = rank
    return out


def test_link_graph(spark):
    link = lambda *h: "".join(f'<a href="http://{x}/p">x</a>' for x in h)
    rows = [(1, "http://good.org/", link("friend.net", "friend.net")), (2, "http://bad.com/de/", link("x.net")), (3, "http://fan.net/", link("bad.com")), (4, "http://friend.net/", link("far.net")), (5, "http://far.net/", None), (6, "http://lone.net/", "<a href='/local'>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.host: r for r in U.judge_urls(frame, URL_RULES).collect()}
    edges = [("good.org", "friend.net", 2.0), ("bad.com", "x.net", 1.0), ("fan.net", "bad.com", 1.0), ("friend.net", "far.net", 1.0)]
    want = brute_ranks(edges, {"trust": {"good.org": 1}, "distrust": {"bad.com": 1}})
    for h in ("friend.net", "far.net", "fan.net", "lone.net"):
        assert math.isclose(got[h].trust, want["trust"].get(h, 0), abs_tol=1e-8) and math.isclose(got[h].distrust, want["distrust"].get(h, 0), abs_tol=1e-8)
    assert got["fan.net"].verdict == "block" and {got[h].verdict for h in ("friend.net", "far.net", "lone.net")} == {"allow"}


def test_verdict_does_not_depend_on_other_hosts(spark):
    """A host that links to a blocked one is blocked, however many other hosts are blocked too."""
    rows = [(1, "http://bad.com/de/", None), (2, "http://fan.net/", '<a href="http://bad.com/p">x</a>'), (3, "http://lone.net/", None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    others = spark.range(10, 200_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), "id", F.lit(".com/de/")).alias("url"), F.lit(None).cast("string").alias("html"))
    got = {r.host: r.verdict for r in U.judge_urls(frame.unionByName(others), URL_RULES).where("page_id < 10").collect()}
    assert got == {"bad.com": "block", "fan.net": "block", "lone.net": "allow"}


def test_verdict_does_not_depend_on_allowed_pages_elsewhere(spark):
    """A host between an allowed and a blocked one keeps its verdict when other pages are allowed, blocked or repeated."""
    link = lambda h: f'<a href="http://{h}/p">x</a>'
    rows = [(1, "http://good.org/", link("mid.net")), (2, "http://mid.net/", link("bad.com")), (3, "http://bad.com/de/", None), (4, "http://fan.net/", link("bad.com"))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {r.page_id: r.verdict for r in U.judge_urls(frame, URL_RULES).collect()}
    assert want == {1: "allow", 2: "allow", 3: "block", 4: "block"}
    other = lambda n, url: spark.range(10, 10 + n).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), "id", F.lit(url)).alias("url"), F.lit(None).cast("string").alias("html"))
    for more in (other(990, ".org/"), other(990, ".com/de/"), other(300, ".org/").unionByName(other(20, ".com/de/"))):
        got = {r.page_id: r.verdict for r in U.judge_urls(frame.unionByName(more), URL_RULES).where("page_id < 10").collect()}
        assert got == want
    twice = U.judge_urls(frame.unionByName(frame.where("page_id = 4")), URL_RULES).collect()
    assert {r.page_id: r.verdict for r in twice} == want and len(twice) == 5


def test_top_k(spark):
    rng = np.random.default_rng(6)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.3, 16)]) for i in range(300)] + [(300, None), (301, [1.0, None]), (302, [float("nan")] * 16), (303, [0.5] * 3), (303, [0.5] * 3), (304, [float("inf")]), (305, [])]
    vectors += [(400 + i, vectors[3][1]) for i in range(5)]  # ties
    frame = cluttered(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"), "v", "block")
    got = sorted(map(tuple, TK.top_k(frame, F.col("vec_id") % 20 == 0, 7).collect()))
    q = {}
    for i, v in vectors:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            q.setdefault(i, []).append(np.array([math.floor(float(np.float32(x)) * 64) for x in v] + [0] * (16 - len(v)), dtype=np.int64))
    want = []
    for i in q:
        if i % 20 == 0:
            scores = sorted((-int(q[i][0] @ v), j) for j in q if j != i for v in q[j])[:7]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    assert got == sorted(want)
    assert TK.top_k(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_of_any_size_in_slices(spark, monkeypatch):
    """Components beyond every integer type are scored exactly; scores beyond a long tie at its ends; many slices agree."""
    monkeypatch.setattr(TK, "SLICE", 1)
    rng = np.random.default_rng(9)
    vectors = [(i, [float(x) for x in rng.normal(0, 1, 6) * (1, 1e3, 1e6, 1e9, 1.0, 1e12)[i % 6]]) for i in range(200)]
    vectors += [(500, [1e300, -1e300, 1e9, 0.0, 0.0, 0.0]), (520, [1.7e308, 1.0]), (541, [-1e-300, 2.0**53, 2.0**53 + 2, 1.0])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, TK.top_k(frame, F.col("vec_id") % 20 == 0, 9).collect()))
    whole = {i: [math.floor(x * 64) if abs(x) < 2.6e306 else int(math.copysign(1.7e308, x)) for x in v] for i, v in vectors}
    want = []
    for i, q in whole.items():
        if i % 20 == 0:
            scores = sorted((-min(max(sum(a * b for a, b in zip(q, v)), -(1 << 63)), (1 << 63) - 1), j) for j, v in whole.items() if j != i)[:9]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    assert got == sorted(want) and len({r[3] for r in got}) > 50


def test_bounds_prune_without_loss():
    rng = np.random.default_rng(8)
    q, c = rng.integers(-60, 60, (32, 5)), rng.integers(-60, 60, (32, 400))
    scores = q.T @ c
    bound = np.sort(scores, axis=1)[:, -10].astype(float)
    row, ids, s = TK.search_block(np.arange(1000, 1005), q, bound, np.arange(400), c, 10)
    for i in range(5):
        want = sorted((-x, j) for j, x in enumerate(scores[i]))[:10]
        assert [(-a, b) for a, b in zip(s[row == i], ids[row == i])] == want


def naive_sainte_lague(votes, seats):
    n = [0] * len(votes)
    for _ in range(seats):
        i = max(range(len(votes)), key=lambda j: (votes[j] / (2 * n[j] + 1), -j))
        n[i] += 1
    return n


def test_apportion():
    rng = np.random.default_rng(5)
    for seats in (0, 1, 7, 100, 1001):
        votes = rng.integers(1, 1000, 13).tolist()
        assert apportion(votes, seats) == naive_sainte_lague(votes, seats)
    assert apportion([5, 5], 10, [2, 20]) == [2, 8] and apportion([], 3) == [] and apportion([0, 0], 3) == [0, 0]


def test_targets():
    t = targets([100, 10, 1000], [5, 2, 1], 300)
    assert t[1] == 20 and math.isclose(sum(t), 300) and all(a <= 2 * b + 1e-9 for a, b in zip(t, [100, 10, 1000]))


def test_mix(spark):
    rows = [(i, words(i % 90, i), "en", ["a", "b", None, "ü"][i % 4], 0) for i in range(1200)] + [(5000, None, "en", "zz", 0), (5001, "", "en", "zz", 0)]
    rows += [rows[7], rows[7]]
    frame = cluttered(docs(spark, rows), "size", "taken", "target")
    got = mix_sources(frame).collect()
    again = mix_sources(frame.repartition(7)).collect()
    key = lambda rs: sorted((r.doc_id, r.source or "", r.size, r.target, r.taken) for r in rs)
    assert key(got) == key(again) and len(got) == len(rows)
    by = defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.copies in (0, 1, 2)
        by[r.source][0] += r.size
        by[r.source][1] += r.taken
        by[r.source][2] = r.target
    for size, taken, target in by.values():
        assert abs(taken - target) <= max(256, 0.01 * size)
    names = sorted(by, key=lambda x: (x is None, (x or "").encode()))
    assert [by[n][2] for n in names] == targets([by[n][0] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(x[0] for x in by.values()))
    assert mix_sources(empty(spark)).count() == 0


def test_mix_small_sources_and_shared_ids(spark, monkeypatch):
    """A source of a few words comes near its target, too; rows without an id are spread over shards; many shards agree with bounds."""
    monkeypatch.setattr("oneway.llm.mixing.SHARD_WORDS", 500)
    rows = [(None if i % 3 == 0 else i, words(20 + i % 40, i), "en", "big", 0) for i in range(400)] + [(9000 + i, "one two three", "en", "tiny", 0) for i in range(7)]
    got = mix_sources(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for source in ("big", "tiny"):
        own = [r for r in got if r.source == source]
        taken, target = sum(r.taken for r in own), own[0].target
        assert abs(taken - target) <= max(3, 0.02 * target) and all(0 <= r.taken <= 2 * r.size for r in own)


def naive_mix(rows, hashes, weights=(5, 2, 1), share=1.5, most=2, block=64, seed=17, shard_words=250_000, cells=1 << 16):
    """(taken, copies) of each row by the definition: one block at a time to the highest quotient, streams word by word.  ``hashes``:
    (order, cell) of each row."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    names = sorted({r[3] for r in rows}, key=lambda x: (x is None, (x or "").encode()))
    words_of = [sum(n for n, r in zip(size, rows) if r[3] == s) for s in names]
    goal = targets(words_of, [weights[i % len(weights)] for i in range(len(names))], share * sum(words_of), most)
    block = max(1, min(block, int(min((t for t in goal if t), default=block) // 16)))
    streams = {}
    for i, (r, (order, cell)) in enumerate(zip(rows, hashes)):
        shards = min(cells, max(1, -(-words_of[names.index(r[3])] // shard_words)))
        streams.setdefault((names.index(r[3]), cell % cells % shards), []).append((order, r[0] is not None, r[0] or 0, size[i], i))
    keys = sorted(streams)
    n_words = {k: sum(x[3] for x in streams[k]) for k in keys}
    blocks = {k: -(-n_words[k] // block) for k in keys}

    def seats(votes, caps, n):
        got = [0] * len(votes)
        for _ in range(min(n, sum(caps))):
            open_ = [j for j in range(len(votes)) if got[j] < caps[j] and votes[j] > 0]
            if not open_:
                break
            got[max(open_, key=lambda j: (votes[j] / (2 * got[j] + 1), -j))] += 1
        return got

    quota = seats(goal, [most * sum(blocks[k] for k in keys if k[0] == i) for i in range(len(names))], round(sum(goal) / block))
    out = {}
    for i in range(len(names)):
        own = [k for k in keys if k[0] == i]
        for k, q in zip(own, seats([n_words[k] for k in own], [most * blocks[k] for k in own], quota[i])):
            b = blocks[k]
            first = (k[1] * 2654435761 + seed * 40503) % b if b else 0
            last = {(first + j) % b for j in range(q % b)} if b else set()
            at = 0
            for _, _, _, n, row in sorted(streams[k]):
                extra = sum((at + j) // block in last for j in range(n))
                out[row] = ((q // b if b else 0) * n + extra, (q // b if b else 0) + (at // block in last))
                at += n
    return size, out


def test_mix_matches_naive(spark, monkeypatch):
    """Every row's words and copies, with many shards, null and shared ids, empty texts and a source of a few words."""
    monkeypatch.setattr("oneway.llm.mixing.SHARD_WORDS", 700)
    rows = [(None if i % 5 == 0 else i, words(1 + i * 7 % 90, i), "en", ["a", "b", None, "ü", "a", "a"][i % 6], 0) for i in range(260)] + [(9001, "one two three", "en", "tiny", 0), (9002, "", "en", "b", 0), (9003, None, "en", None, 0)]
    frame = docs(spark, rows)
    own = (F.col("doc_id"), F.xxhash64("text"))
    hashed = frame.select("doc_id", "text", F.xxhash64(F.lit(17), *own).alias("o"), F.pmod(F.xxhash64(F.lit(18), *own), F.lit(1 << 16)).alias("c")).collect()
    by = {(r.doc_id, r.text): (r.o, r.c) for r in hashed}
    size, want = naive_mix(rows, [by[r[0], r[1]] for r in rows], shard_words=700)
    got = {(r.doc_id, r.text): (r.size, r.taken, r.copies) for r in mix_sources(frame).collect()}
    assert got == {(r[0], r[1]): (size[i], *want[i]) for i, r in enumerate(rows)}
