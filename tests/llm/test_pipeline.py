import re
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

import corpus_pipeline as P
from oneway.llm.textkit import Words
from oneway.llm.toxicity import grades_of_labels, train
from tests.llm.cases import docs, empty, words
from tests.llm.test_other_ops import brute_shards, naive_mix
from tests.llm.test_text_ops import brute_tile


def test_stages_on_the_small_tables(spark, sf_dir):
    names = [n for n, _ in P.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    documents = P.table(spark, sf_dir, "documents")
    kept = P.toxicity(spark, documents, sf_dir).cache()
    assert kept.columns == P.COLUMNS and 0 < kept.count() < documents.count()
    assert kept.join(documents, "doc_id", "left_anti").count() == 0
    single = P.near_duplicates(spark, kept, sf_dir).cache()
    assert single.count() == single.select("doc_id").distinct().count() <= kept.count()
    # of exact copies one stays: the smallest id
    least = {r.text: r.m for r in kept.groupBy("text").agg(F.min("doc_id").alias("m")).collect()}
    assert all(least[r.text] == r.doc_id for r in single.collect())
    clean = P.decontamination(spark, single, sf_dir).cache()
    items = [" ".join(r.text.lower().split()) for r in P.table(spark, sf_dir, "benchmark").collect()]
    assert not any(i in " ".join(r.text.lower().split()) for r in clean.collect() for i in items)
    mixed = P.mixing(spark, clean, sf_dir).cache()
    assert mixed.columns == P.COLUMNS and max(Counter(r.doc_id for r in mixed.select("doc_id").collect()).values()) <= 2
    sharded = P.sharding(spark, mixed, sf_dir).collect()
    by = Counter()
    for r in sharded:
        by[r.shard] += r.bytes
    assert len(sharded) == mixed.count() and max(by.values()) <= P.SHARD_BYTES


def test_empty_documents(spark, sf_dir):
    docs = empty(spark)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0


def test_pipeline_matches_brute_force(spark, tmp_path):
    """The whole pipeline on a small fixture, each stage's decision recomputed in plain Python over what its predecessor kept; with null
    and repeated ids, empty texts, repeated rows and an extra column."""
    rng = np.random.default_rng(8)
    item = words(40, 990, 5000)
    rows, labels = [], []
    for i in range(300):
        w = words(int(rng.integers(40, 90)), 3000 + i, 4000).split()
        toxic = i % 6 == 0
        for b in rng.choice(["idiot", "scum", "moron"], 3) if toxic else []:
            w.insert(int(rng.integers(0, len(w))), str(b))
        labels.append((i, int(i % 4 > 0), int(toxic)))
        rows.append((i, " ".join(w), "en", ["a", "b", None][i % 3], 0))
    rows += [(1000 + i, rows[i * 7 + 1][1] + (" tail" if i % 2 else ""), "en", "b", 0) for i in range(20)]
    rows += [(2000 + i, words(30, i, 4000) + " " + item + " " + words(20, i + 50, 4000), "en", "a", 0) for i in range(5)]
    rows += [(None, words(50, 70 + i, 4000), "en", "a", 0) for i in range(3)] + [(2500, words(50, 80 + i, 4000), "en", "a", 0) for i in range(2)] + [(2600, "", "en", "b", 0), (2601, None, "en", "b", 0)]
    rows += [rows[-3], rows[3]]
    docs(spark, rows).withColumn("__cell", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    folder = str(tmp_path)

    model = train(docs(spark, rows), grades_of_labels(P.table(spark, folder, "labels")))
    weight = dict(zip(model.keys.tolist(), model.weights.tolist()))
    of = lambda w: int(Words(np.frombuffer(w, np.uint8), np.array([0, len(w)])).hashes()[0])
    kept = [r for r in rows if sum(weight.get(of(w), 0) for w in {x.lower() for x in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (r[1] or "").encode())}) < model.theta[0]]
    gone = [r for r in rows if r not in kept]
    assert len(gone) >= 45 and all(re.search("idiot|scum|moron", r[1]) for r in gone)

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()}

    distinct = sorted(set(kept), key=lambda r: (r[0] is not None, r[0] or 0))
    sets, root = [shingles(r[1]) for r in distinct], list(range(len(distinct)))
    for j in range(len(distinct)):
        for i in range(j):
            similar = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            assert similar >= 0.9 or similar < 0.5  # no borderline pairs here
            if similar >= 0.9:
                root[j] = min(root[j], root[i])
    single = [r for i, r in enumerate(distinct) if root[i] == i]
    tokens = item.split()
    clean = [r for r in single if brute_tile((r[1] or "").split(), tokens, 5) < 0.6 * len(tokens)]
    assert len(single) - len(clean) == 5
    own = (F.col("doc_id"), F.xxhash64("text"))
    by = {(r.doc_id, r.text): (r.o, r.c) for r in docs(spark, clean).select("doc_id", "text", F.xxhash64(F.lit(17), *own).alias("o"), F.pmod(F.xxhash64(F.lit(18), *own), F.lit(1 << 16)).alias("c")).collect()}
    _, taken = naive_mix(clean, [by[r[0], r[1]] for r in clean])
    mixed = [r for i, r in enumerate(clean) for _ in range(taken[i][1])]
    shards = brute_shards([r[0] for r in mixed], [len((r[1] or "").encode()) for r in mixed], P.SHARD_BYTES)
    key = lambda rs: sorted(rs, key=str)
    got = P.run(spark, folder).collect()
    assert key((r.doc_id, r.text, r.lang, r.source, r.n_chars, r.shard.split("+")[0]) for r in got) == key((*r, s) for r, s in zip(mixed, shards))
