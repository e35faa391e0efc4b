import hashlib
import math
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from oneway.llm import decontaminate as D
from oneway.llm import simhash as S
from oneway.llm import suffix_tree_lm as LM
from oneway.llm.components import connected_components
from oneway.llm.substring_dedup import substring_dedup
from oneway.llm.textkit import HashIndex, Words, grams, pack, sliding_min, unpack
from tests.llm.cases import cluttered, corpus, docs, empty, words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\né.", max_size=30), min_size=1, max_size=5))
def test_words_match_split(texts):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    w = Words(np.frombuffer(b"".join(raw), np.uint8), offsets)
    buf = b"".join(raw)
    got = [buf[s:e] for s, e in zip(w.starts, w.ends)]
    assert got == [x for r in raw for x in r.split()] and w.counts.tolist() == [len(r.split()) for r in raw]
    h = w.hashes().tolist()
    assert all((a == b) == (x == y) for a, x in zip(h, got) for b, y in zip(h, got))


def test_kernels():
    a = np.random.default_rng(1).integers(0, 1000, 50).astype(np.uint64)
    for w in (1, 2, 3, 10):
        assert sliding_min(a, w).tolist() == [min(a[i : i + w]) for i in range(51 - w)]
    assert len(grams(a, 5)) == 46 and len(grams(a[:3], 5)) == 0
    index = HashIndex(a)
    assert all(a[i] == x for i, x in zip(index.find(a), a)) and index.find(np.array([5000], np.uint64))[0] == -1
    assert [x.tolist() for x in unpack(pack(a, np.arange(3, dtype=np.uint16)))] == [a.tolist(), [0, 1, 2]]


def brute_dedup(rows, length=13):
    split = [(d, (t or "").encode().split()) for d, t in rows]
    out = {}
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if any(e < d and any(v[j : j + length] == w[i : i + length] for j in range(len(v) - length + 1)) for e, v in split):
                gone[i : i + length] = [True] * length
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_substring_dedup(spark):
    rows = substring_dedup(cluttered(docs(spark), "bucket", "kind", "data", "spans")).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == brute_dedup([(r[0], r[1]) for r in corpus()])
    for r in rows:
        assert sum(s.words for s in r.spans) == r.n_removed and all(s.words >= 13 for s in r.spans)
    assert substring_dedup(empty(spark)).count() == 0


def test_substring_dedup_repeated_ids(spark):
    text = words(30, 3)
    rows = [(1, text, "en", "a", 0), (1, text, "en", "a", 0), (1, words(5, 4) + " " + text, "en", "a", 0), (None, words(20, 9), "en", "a", 0), (2, text, "en", "a", 0)]
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in substring_dedup(docs(spark, rows)).collect())
    assert got == [(-1, 20, 0), (1, 30, 0), (1, 30, 0), (1, 35, 0), (2, 30, 30)]


def thue_morse(n, a="a", b="b"):
    return a if n == 0 else thue_morse(n - 1, a, b) + thue_morse(n - 1, b, a)


def removed(spark, rows):
    return {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup(docs(spark, [(d, t, "en", "a", 0) for d, t in rows])).collect()}


def test_substring_dedup_long_runs(spark):
    """A text that repeats one word, or two in turn, has no limit of its length."""
    rows = [(1, "a " * 200_000), (2, words(5, 4) + " a" * 20), (3, "- | " * 40_000), (4, words(5, 4) + " | -" * 10 + " x")]
    assert removed(spark, rows) == {1: (200_000, 0), 2: (25, 20), 3: (80_000, 0), 4: (26, 20)}


def test_substring_dedup_words_of_one_polynomial(spark):
    """Words that polynomial hashes modulo 2**64 cannot tell apart are different words."""
    one, two = (" ".join([thue_morse(10, *x)] * 13) for x in ("ab", "ba"))
    assert removed(spark, [(1, one), (2, two), (3, two)]) == {1: (13, 0), 2: (13, 0), 3: (13, 13)}


@pytest.mark.parametrize("hot, most, crowd, flush", [(64, 4_000_000, 2_000, 2_000_000), (1, 4_000_000, 2_000, 50), (64, 3, 2_000, 50), (64, 4_000_000, 3, 50), (0, 3, 1, 1)])
def test_substring_dedup_matches_brute_force(spark, hot, most, crowd, flush):
    """Passages in other surroundings, at text ends, inside each other and many times over, by every way of joining them."""
    rng = np.random.default_rng(12)
    passages = [words(n, 50 + n) for n in (11, 12, 13, 14, 20, 40)] + [" ".join(["a"] * 15), " ".join(["a", "b"] * 9)]
    rows = []
    for i in range(80):
        own = []
        for _ in range(int(rng.integers(0, 5))):
            p = passages[int(rng.integers(len(passages)))].split()
            lo = int(rng.integers(0, 5))
            own += words(int(rng.integers(0, 8)), int(rng.integers(0, 30))).split() + p[lo : len(p) - int(rng.integers(0, 5))]
        rows.append((int(rng.permutation(80)[0]) * 100 + i, " ".join(own)))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(docs(spark, [(d, t, "en", "a", 0) for d, t in rows]).repartition(3), 13, 4, hot, most, crowd, flush).collect()}
    assert got == brute_dedup(rows) and sum(x[1] for x in got.values()) > 200


def test_substring_dedup_equal_rows_and_smallest_id(spark):
    text = words(30, 3)
    low = -(1 << 63)
    rows = [(low, text, "en", "a", 0)] * 3 + [(None, text, "en", "a", 0)] * 2 + [(4, text, "en", "a", 0)] * 3
    got = Counter((r.doc_id, r.n_removed) for r in substring_dedup(docs(spark, rows)).collect())
    assert got == {(low, 0): 3, (None, 0): 2, (4, 30): 3}


WORKER = """
import re
import sys
from pyspark.sql import SparkSession, functions as F
from oneway.llm.substring_dedup import substring_dedup

def held(batches):
    yield from batches
    text = open("/proc/self/smaps_rollup").read()
    print("HELD", sum(map(int, re.findall("Pss_Anon: +([0-9]+)", text))) // 1024, flush=True)

conf = {"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2", "spark.sql.adaptive.enabled": "false"}
spark = SparkSession.builder.master("local[1]").config(map=conf).getOrCreate()
word = "concat(substring('seventeen', 1, 1 + cast(abs(xxhash64(id, i)) % 9 as int)), cast(abs(xxhash64(i, id)) % 5000 as string))"
docs = spark.range(0, 20000, 1, 1).select(F.col("id").alias("doc_id"), F.expr(f"concat_ws(' ', transform(sequence(1, 400), i -> {word}))").alias("text"))
docs.write.parquet(sys.argv[1])
substring_dedup(spark.read.parquet(sys.argv[1])).write.format("noop").mode("overwrite").save()
spark.range(0, 1, 1, 1).mapInArrow(held, "id long").collect()
spark.stop()
"""


@pytest.mark.skipif(sys.platform != "linux", reason="reads smaps")
def test_substring_dedup_gives_memory_back(tmp_path):
    """A worker that has gone through all stages, and waits for the next, holds little more than its libraries."""
    ran = subprocess.run([sys.executable, "-c", WORKER, str(tmp_path / "docs")], capture_output=True, text=True, timeout=300)
    held = re.findall(r"HELD (\d+)", ran.stdout + ran.stderr)
    assert held and int(held[-1]) < 105, (held, ran.stderr[-2000:])


def brute_simhash(rows, k=3):
    prints = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        g = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) > k else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in g]
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (f"{p:016x}", find(d)) for d, p in prints.items()}


def test_simhash(spark):
    base = words(200, 5).split()
    rows = corpus() + [(1000 + i, " ".join(base[:i] + ["x"] + base[i + 1 :]), "en", "a", 0) for i in range(0, 200, 20)]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.simhash_components(cluttered(docs(spark, rows), "fp", "rep", "key")).collect()}
    assert got == brute_simhash([(r[0], r[1]) for r in rows])
    assert S.simhash_components(empty(spark)).count() == 0


@pytest.mark.parametrize("group", [4, 4096])
def test_exact_links_large_groups(spark, group, monkeypatch):
    """Groups over the limit are cut by further bits and lose no link."""
    monkeypatch.setattr(S, "GROUP", group)
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 1 << 62))
    prints = {base} | {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (60, 2))} | {int(x) for x in rng.integers(0, 1 << 62, 40)}
    prints = sorted(prints)
    frame = spark.createDataFrame([(p, i) for i, p in enumerate(prints)], "fp long, rep long")
    roots = {r.node: r.root for r in connected_components(S.exact_links(frame, 2)).collect()}
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    assert all(roots.get(i, i) == find(i) for i in range(len(prints)))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates(spark):
    """Recall on pairs of similarity 0.8 or more, and nothing dropped that is far from all others."""
    rows, pairs = [], []
    for n in range(40):
        base = words(200, 100 + n, 5000).split()
        rows.append((2 * n, " ".join(base), "en", "a", 0))
        base[50] = base[120] = "changed"
        rows.append((2 * n + 1, " ".join(base), "en", "a", 0))
        pairs.append((2 * n, 2 * n + 1))
    rows += [(500 + i, words(150, 900 + i, 5000), "en", "a", 0) for i in range(30)] + [(None, rows[0][1], "en", "a", 0), (0, rows[0][1], "en", "a", 0)]
    kept = [r.doc_id for r in S.drop_near_duplicates(cluttered(docs(spark, rows), "rep")).collect()]
    assert len(kept) == len(set(kept)) and {500 + i for i in range(30)} <= set(kept)
    assert sum(b in kept for _, b in pairs) <= 1
    assert None in kept and 0 not in kept  # the null id is the smallest
    assert S.drop_near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_recall_near_the_limit(spark):
    """Of pairs whose five-word shingles have a Jaccard similarity of 0.80 to 0.85, nine in ten or more are found."""
    rows = []
    rng = np.random.default_rng(31)
    for n in range(150):
        one = words(int(rng.integers(60, 400)), 2000 + n, 5000).split()
        two, shingles = list(one), lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        while True:
            last = list(two)
            two[int(rng.integers(len(two)))] = f"new{int(rng.integers(10**6))}"
            a, b = shingles(one), shingles(two)
            if (similar := len(a & b) / len(a | b)) <= 0.85:
                break
        if similar >= 0.8:
            rows += [(10 * n, " ".join(one), "en", "a", 0), (10 * n + 1, " ".join(two), "en", "a", 0)]
    kept = {r.doc_id for r in S.drop_near_duplicates(docs(spark, rows)).collect()}
    pairs = [r[0] for r in rows[::2]]
    assert len(pairs) > 80 and sum(d + 1 not in kept for d in pairs) >= 0.9 * len(pairs) and set(pairs) <= kept


def test_near_duplicates_without_unique_ids(spark):
    """Rows that share an id, or have none, stay where their texts differ; only rows equal in both are one."""
    texts = [words(150, 700 + i, 5000) for i in range(12)]
    rows = [(None, t, "en", "a", 0) for t in texts[:6]] + [(3, t, "en", "a", 0) for t in texts[6:]] + [(None, texts[0], "en", "b", 0), (3, texts[6], "en", "b", 0), (1, texts[7], "en", "a", 0), (9, texts[1], "en", "a", 0)]
    kept = sorted(((r.doc_id, r.text) for r in S.drop_near_duplicates(docs(spark, rows)).collect()), key=lambda r: texts.index(r[1]))
    assert kept == [(1 if i == 7 else 3 if i >= 6 else None, t) for i, t in enumerate(texts)]


def test_banded_links_compare_large_groups_whole(spark, monkeypatch):
    """Pairs that agree on one band only are linked, however many rows share that band's value."""
    monkeypatch.setattr(S, "GROUP", 16)
    monkeypatch.setattr(S, "TILE", 8)
    rng = np.random.default_rng(3)
    bands, bits, radius = 4, 16, 12
    prints = []
    for i in range(300):
        base = int(rng.integers(0, 1 << 48)) << 16 | 5  # band 0 is common to all
        near = base ^ sum(1 << int(b) for band in (1, 2, 3) for b in band * 16 + rng.choice(16, 4, False))  # no other band agrees
        prints += [base, near]
    prints = sorted(set(prints))
    frame = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "rep long, f0 long")
    roots = {r.node: r.root for r in connected_components(S.banded_links(frame, radius, 1, bands, bits)).collect()}
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    assert len(prints) > 32 * S.GROUP and all(roots.get(i, i) == find(i) for i in range(len(prints)))


def brute_tile(doc, item, match):
    free_d, free_i, covered = [True] * len(doc), [True] * len(item), 0
    same = lambda x, y, n: x + n <= len(doc) and y + n <= len(item) and doc[x : x + n] == item[y : y + n] and all(free_d[x : x + n]) and all(free_i[y : y + n])
    while True:
        size = max((n for y in range(len(item)) for x in range(len(doc)) for n in range(match, len(item) - y + 1) if same(x, y, n)), default=0)
        if not size:
            return covered
        for y in range(len(item)):
            for x in range(len(doc)):
                if same(x, y, size):
                    free_d[x : x + size] = free_i[y : y + size] = [False] * size
                    covered += size


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=40), st.lists(st.integers(0, 4), min_size=1, max_size=20))
def test_tile_covers_as_brute_force(doc, item):
    assert D.tile(np.array(doc, np.uint64), np.array(item, np.uint64), 3) == brute_tile(doc, item, 3)


def test_tile_long_repeats():
    """A long text of one token against a repeated item is no quadratic case."""
    assert D.tile(np.full(300_000, 7, np.uint64), np.full(3_000, 7, np.uint64), 5) == 3_000
    assert D.tile(np.tile(np.array([1, 2, 3, 4, 5, 9], np.uint64), 30_000), np.tile(np.array([1, 2, 3, 4, 5, 8], np.uint64), 300), 5) == 1_500


def test_decontaminate_matches_brute_force(spark, monkeypatch):
    """Random passages of items in documents, turned, cut and repeated: verdict, number of items and best item, whatever the slices."""
    rng = np.random.default_rng(21)
    items = [(10 + i, words(int(rng.integers(3, 40)), 400 + i, 60)) for i in range(12)] + [(5, ""), (40, words(30, 477, 60)), (3, words(30, 477, 60).upper())]
    rows = []
    for i in range(60):
        own = words(int(rng.integers(0, 30)), i, 200).split()
        for _ in range(int(rng.integers(0, 4))):
            p = items[int(rng.integers(len(items)))][1].split()
            cut = int(rng.integers(0, len(p) + 1))
            own += p[cut:] + words(2, i + 500, 200).split() + p[: max(0, cut - int(rng.integers(0, 6)))]
        rows.append((i, " ".join(own), "", "", 0))
    rows.append((99, rows[3][1], "", "", 0))
    bench = spark.createDataFrame(items, "item_id long, text string")
    known = {}
    for i, t in items:
        key = tuple(t.lower().split())
        known[key] = min(i, known.get(key, i))
    want = {}
    for d, t, *_ in rows:
        share = {i: brute_tile(t.lower().split(), list(k), min(5, len(k))) / len(k) for k, i in known.items() if k}
        hits = {i: s for i, s in share.items() if s >= 0.6}
        want[d] = (bool(hits), len(hits), min((-s, i) for i, s in hits.items())[1] if hits else None)
    for size in (8 << 20, 200, 1):
        monkeypatch.setattr(D, "MAX_BENCHMARK", size)
        got = {r.doc_id: (r.contaminated, r.n_items, r.item_id if r.contaminated else None) for r in D.decontaminate(docs(spark, rows), bench).collect()}
        assert got == want
    assert 10 < sum(x[0] for x in want.values()) < 61


def test_decontaminate(spark):
    item = words(40, 77, 5000).split()
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "short one"), (3, ""), (4, None), (None, "x"), (1, " ".join(item))], "item_id long, text string")
    turned = " ".join(item[20:] + words(15, 5).split() + item[:20])
    noisy = words(80, 6) + " " + ", ".join(x.upper() for x in item) + "! " + words(50, 8)
    half = words(80, 6) + " " + " ".join(item[:18])
    rows = [(1, turned, "", "", 0), (2, noisy, "", "", 0), (3, half, "", "", 0), (4, "a Short, one", "", "", 0), (5, None, "", "", 0), (6, "", "", "", 0), (7, words(3000, 9), "", "", 0), (7, turned, "", "", 0)]
    got = [(r.doc_id, r.contaminated, r.item_id) for r in D.decontaminate(cluttered(docs(spark, rows), "coverage", "item_id"), bench).collect()]
    assert got == [(1, True, 1), (2, True, 1), (3, False, None), (4, True, 2), (5, False, None), (6, False, None), (7, False, None), (7, True, 1)]
    assert not any(r.contaminated for r in D.decontaminate(docs(spark), bench.limit(0)).collect())
    assert D.decontaminate(empty(spark), bench).count() == 0


def test_decontaminate_in_slices(spark, monkeypatch):
    items = [(i, words(30, 300 + i, 5000)) for i in range(6)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, words(20, i) + " " + t, "", "", 0) for i, t in items]
    whole = sorted(map(tuple, D.decontaminate(docs(spark, rows), bench).collect()))
    monkeypatch.setattr(D, "MAX_BENCHMARK", 300)
    assert sorted(map(tuple, D.decontaminate(docs(spark, rows), bench).collect())) == whole and all(r[-1] for r in whole)


def test_language_model_base_and_totals(spark):
    rows = corpus()
    got = {r.doc_id: r for r in LM.fit_and_score(cluttered(docs(spark, rows), "uid", "h", "held_out")).collect()}
    tokens = {d: (t or "").encode().lower().split() + [None] for d, t, *_ in rows}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    c = Counter(x for d, w in tokens.items() if not held[d] for x in w)
    n, v = sum(c.values()), len(c)
    for d, w in tokens.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(w), sum(x in c for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
    assert LM.fit_and_score(empty(spark)).count() == 0


def test_distinct_keys():
    rng = np.random.default_rng(1)
    few = rng.integers(0, 1 << 40, 300, dtype=np.uint64)
    for keys in (rng.choice(few, 5000), rng.choice(few << np.uint64(24), 5000), rng.choice(np.array([1, 2, 3, 1 << 63, (1 << 63) + 1, (1 << 64) - 1], np.uint64), 5000), few[:0], few[:1]):
        u, where = LM.distinct(keys)
        a, b = np.unique(keys, return_inverse=True)
        assert (u == a).all() and (where == b).all()
        for n in (1, 3, 1000):
            parts = list(LM.ranges(u, {"ranges": n}))
            assert [x for _, lo, hi in parts for x in range(lo, hi)] == list(range(len(u))) and all(r == int(x) // -(-(1 << 64) // n) < n for r, lo, hi in parts for x in u[lo:hi].tolist())


def brute_tree(train, depth, least, divergence, weight):
    """The definition over plain dictionaries: probability of a token after what precedes it in its document."""
    count = Counter(tuple(w[i : i + k]) for w in train for k in range(1, depth + 2) for i in range(len(w) - k + 1))
    n, v = sum(len(w) for w in train), sum(len(g) == 1 for g in count)
    states = {()}

    def prob(context, x, less=0):
        p = (count[(x,)] - less + 1) / (n - less + v + 1)
        for k in range(1, len(context) + 1):
            s = context[len(context) - k :]
            if s not in states:
                break
            p = (count[(*s, x)] - less + weight * p) / (count[s] - less + weight)
        return p

    for k in range(1, depth + 1):
        gain = Counter()
        for w in train:
            for i in range(k, len(w)):
                s = tuple(w[i - k : i])
                if count[s] >= least and s[1:] in states:
                    parent = prob(s[1:], w[i], 1)
                    own = (count[(*s, w[i])] - 1 + weight * parent) / (count[s] - 1 + weight)
                    gain[s] += round(math.log(own / parent) * LM.UNIT)
        states |= {s for s, g in gain.items() if g >= divergence * count[s] * LM.UNIT}
    return (lambda w, i: prob(tuple(w[max(0, i - depth) : i]), w[i])), states


@pytest.mark.parametrize("depth, block_bytes", [(3, 2_000), (2, 1 << 20)])
def test_language_model_matches_definition(spark, depth, block_bytes):
    """Scores of every document by the definition, with one block or many; states of every length; the gain on held-out documents."""
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(120):
        w = [0]
        while len(w) < 40:
            w.append(int((w[-1] * 3 + w[max(0, len(w) - 2)] * 5 + w[max(0, len(w) - 3)] + rng.integers(0, 2)) % 7))
        texts.append(" ".join(f"t{x}" for x in w))
    rows = [(i, t, "", "", 0) for i, t in enumerate(texts)] + [(7, texts[7], "", "", 0), (7, texts[7], "", "", 0), (500, "", "", "", 0), (501, None, "", "", 0), (502, "new words", "", "", 0), (None, "t1 t2", "", "", 0)]
    got = LM.fit_and_score(docs(spark, rows), depth=depth, least=8, divergence=0.02, weight=3.0, block_bytes=block_bytes).collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    split = [(d, (t or "").split() + [None]) for d, t, *_ in rows]
    prob, states = brute_tree([w for d, w in split if not held(d)], depth, 8, 0.02, 3.0)
    want = sorted((-1 if d is None else d, held(d), len(w), round(sum(math.log10(prob(w, j)) for j in range(len(w))), 9)) for d, w in split)
    have = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.score) for r in got)
    assert len(want) == len(have) and all(a[:3] == b[:3] and math.isclose(a[3], b[3], rel_tol=1e-6) for a, b in zip(want, have))
    assert Counter(map(len, states)).keys() == set(range(depth + 1))
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out) + 2
    known = {x for d, w in split if not held(d) for x in w}
    for context in ((), ("t0",), ("t0", "t3"), ("t1", "t4", "t2")):  # a distribution over the vocabulary and one unseen word
        w = list(context)
        assert math.isclose(sum(prob([*w, x], len(w)) for x in [*known, "unseen"]), 1, abs_tol=1e-9)


def test_base_scores_need_one_round(spark, sf_dir, monkeypatch):
    """The base columns are those of the whole operator, from the tokens' counts alone."""
    from oneway.llm import queries as Q
    from oneway.llm import suffix_tree_lm as L

    whole, written = Q.op8_suffix_tree_lm(spark, sf_dir), []
    monkeypatch.setattr(L, "bucketed", lambda df, name, *rest, own=L.bucketed: written.append(name) or own(df, name, *rest))
    base = Q.base8_add_one(spark, sf_dir)
    assert written == ["blocks", "answers"]
    assert sorted(base.collect()) == sorted(whole.selectExpr("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "round(base_score, 3) base_score").collect())
