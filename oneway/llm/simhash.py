"""SimHash near-duplicates by tiled exact comparison.

A fingerprint bit is the majority of that bit over the hashes of a text's word shingles.  Distinct fingerprints are laid
out in tiles; inside a tile's group rows are ordered by population count, tile pairs whose population counts differ by
more than the radius are skipped, and the others are compared by numpy exclusive-or and bit counts.

Exact layout (small radius): the bits are cut in radius + 1 segments.  Fingerprints within the radius agree on at least
one segment, so each goes to one group per segment and no link is lost.  A group above ``GROUP`` rows is cut again over
its remaining bits, which share the same property, until groups are small: no task ever holds an unbounded group, and
what remains undivided has too few free bits to be large.

Banded layout (large radius): a group is a band of bits of a longer fingerprint on which rows agree.  A group above ``GROUP`` rows is
dealt into numbered tiles of about ``GROUP`` rows, and every pair of tiles is compared, each in a task's group of its own, so a large
group is compared whole.  This is the one approximation: a pair that agrees on no band is not compared.  With 30 bands of 14 bits
and 512-bit fingerprints, pairs whose shingle sets have Jaccard similarity 0.8 (expected distance 78) agree on a band with
probability 0.96, those of 0.9 with more than 0.99; all comparisons are exact.  Measured on pairs of 0.80 to 0.86 that differ by replaced
words: 0.985 to 0.99 of them are linked (distance 65 +- 8), for texts of 60, 200 and 800 words.

A group reports the links as a forest (each fingerprint with its tile root), never all pairs.

Rows: null and empty texts have fingerprint zero, linked like any other.  Repeated rows and equal texts share a
fingerprint and hence a component.  A null doc_id counts as smaller than any other; rows without an id, or with one id, are
documents of their own where their texts differ (told apart by 128 bits of hash in drop_near_duplicates).  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oneway.llm.components import connected_components
from oneway.llm.shared import materialize
from oneway.llm.textkit import U64, chunks, group_starts, mix, text_bytes

#: Rows of a group that are compared in one task; larger groups are cut by further bits (exact layout) or into pairs of tiles (banded).
GROUP = 4096
#: Keys of large groups up to this many are broadcast.
BROADCAST_KEYS = 200_000
#: Side of a tile.
TILE = 512
NO_ID = -(1 << 63)


def text_keys() -> dict[str, Column]:
    """Two hashes that tell the texts of one doc_id apart."""
    text = F.col("text").cast("string")
    return {"t0": F.xxhash64(text), "t1": F.xxhash64(F.lit(1), text)}


def shingle_hashes(text: bytes, k: int, seed: int = 42) -> list[int]:
    """XXH64 of each k-word shingle, repeats included; of the whole sequence if it is shorter; none without words."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= k:
        return [h(joined, seed)]
    ends = [a + i for i, a in enumerate(accumulate(map(len, words)))]
    starts = [0, *(e + 1 for e in ends)]
    return [h(joined[s:e], seed) for s, e in zip(starts, ends[k - 1 :])]


def bit_majority(h: np.ndarray) -> int:
    """The 64-bit number whose bits are set in more than half of the values."""
    if not len(h):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        bits = np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 3, words: int = 1, with_text: bool = False) -> DataFrame:
    """doc_id, and the fingerprint of 64 * ``words`` bits as longs f0, f1, ...; word 0 uses XXH64 itself, the others
    remixes of it.  ``with_text``: with the text's hashes t0 and t1."""
    keys = list(text_keys()) if with_text else []
    names = [f"f{i}" for i in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                out = np.zeros((words, part.num_rows), U64)
                for d, text in enumerate(text_bytes(part.column("text"))):
                    h = np.array(shingle_hashes(text, k), U64)
                    for i in range(words):
                        out[i, d] = bit_majority(h)
                        h = mix(h + U64(0x9E3779B97F4A7C15))
                yield pa.record_batch([part.column("doc_id"), *(part.column(c) for c in keys), *(pa.array(x.view(np.int64)) for x in out)], names=["doc_id", *keys, *names])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(text_keys()[c].alias(c) for c in keys))
    return docs.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in keys + names))


def _deal(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Each row once per segment of its free bits: the key names the path of segments and their values."""
    for batch in batches:
        fp, rep, key, free = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "rep", "key", "free"))
        fp, key, free = fp.view(U64), key.view(U64), free.view(U64)
        out: list[tuple] = []
        for mask in np.unique(free).tolist():
            pick = np.flatnonzero(free == U64(mask))
            bits = [b for b in range(64) if mask >> b & 1]
            for i in range(parts):
                own = sum(1 << b for b in bits[len(bits) * i // parts : len(bits) * (i + 1) // parts])
                sub = mix(key[pick] ^ mix((fp[pick] & U64(own)) ^ mix(np.full(len(pick), own, U64))))
                out.append((sub, fp[pick], rep[pick], np.full(len(pick), mask & ~own, U64)))
        if out:
            cols = [np.concatenate([x[j] for x in out]).view(np.int64) for j in range(4)]
            yield pa.record_batch([pa.array(c) for c in cols], names=["key", "fp", "rep", "free"])


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links u-v as (node, root) pairs over the same components."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[other], nodes[root[other]]


def _tile_links(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside one group; ``fp`` is (rows, words).  Rows are tiled in order of population count."""
    pop = np.bitwise_count(fp).sum(axis=1, dtype=np.int64)
    order = np.argsort(pop, kind="stable")
    fp, pop = fp[order], pop[order]
    left, right = [], []
    for i in range(0, len(fp), TILE):
        a = fp[i : i + TILE]
        for j in range(i, len(fp), TILE):
            if pop[j] - pop[min(i + TILE, len(fp)) - 1] > radius:
                break  # later tiles are further away still
            b = fp[j : j + TILE]
            apart = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]).astype(np.int16)
            for w in range(1, fp.shape[1]):
                apart += np.bitwise_count(a[:, None, w] ^ b[None, :, w])
            x, y = np.nonzero(apart <= radius)
            ok = x + i < y + j
            left.append(order[x[ok] + i])
            right.append(order[y[ok] + j])
    return np.concatenate(left), np.concatenate(right)


def _cross_links(fp: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the rows of the two sides of a group, with the same skip by population count."""
    pop = np.bitwise_count(fp).sum(axis=1, dtype=np.int64)
    one, two = (own[np.argsort(pop[own], kind="stable")] for own in (np.flatnonzero(side != 2), np.flatnonzero(side == 2)))
    left, right = [one[:0]], [two[:0]]
    for i in range(0, len(one), TILE):
        x_rows = one[i : i + TILE]
        for j in range(0, len(two), TILE):
            y_rows = two[j : j + TILE]
            if pop[x_rows[0]] - pop[y_rows[-1]] > radius:
                continue
            if pop[y_rows[0]] - pop[x_rows[-1]] > radius:
                break
            apart = np.bitwise_count(fp[x_rows, None, 0] ^ fp[None, y_rows, 0]).astype(np.int16)
            for w in range(1, fp.shape[1]):
                apart += np.bitwise_count(fp[x_rows, None, w] ^ fp[None, y_rows, w])
            x, y = np.nonzero(apart <= radius)
            left.append(x_rows[x])
            right.append(y_rows[y])
    return np.concatenate(left), np.concatenate(right)


def _group_links(key: np.ndarray, fp: np.ndarray, radius: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the groups of equal (sorted) keys.  Small groups are compared together, shift by shift.  ``side``: 0, or 1 and 2 for
    the two tiles of a pair, of which only rows of different tiles need comparing."""
    at = group_starts(key)
    size = np.diff(np.append(at, len(key)))
    left, right = [], []
    for g in np.flatnonzero(size > 48):
        own = slice(at[g], at[g] + size[g])
        x, y = _cross_links(fp[own], side[own], radius) if side is not None and side[own].any() else _tile_links(fp[own], radius)
        left.append(x + at[g])
        right.append(y + at[g])
    small = np.flatnonzero((size > 1) & (size <= 48))
    rows = np.repeat(at[small] - np.cumsum(size[small]) + size[small], size[small]) + np.arange(size[small].sum())
    end = np.repeat(at[small] + size[small], size[small])
    pop = np.bitwise_count(fp).sum(axis=1, dtype=np.int64)
    for shift in range(1, 48):
        more = rows + shift < end
        rows, end = rows[more], end[more]
        if not len(rows):
            break
        near = np.flatnonzero(np.abs(pop[rows] - pop[rows + shift]) <= radius)
        x = rows[near]
        apart = np.bitwise_count(fp[x] ^ fp[x + shift]).sum(axis=1, dtype=np.int64)
        hit = x[apart <= radius]
        left.append(hit)
        right.append(hit + shift)
    none = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _compare(batches: Iterator[pa.RecordBatch], radius: int, words: int, sides: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; a group may go over several batches.  ``sides``: they have a column side."""
    names = ["key", "rep", *(f"f{i}" for i in range(words)), *["side"] * sides]
    rest = None

    def links(table: np.ndarray):
        key, rep, fp = table[0], table[1], np.ascontiguousarray(table[2 : 2 + words].T).view(U64)
        x, y = _group_links(key, fp, radius, table[-1] if sides else None)
        if len(x):
            u, v = _forest(rep[x], rep[y])
            yield pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in batches:
        table = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
        if rest is not None:
            table = np.concatenate([rest, table], axis=1)
        last = np.searchsorted(table[0], table[0, -1]) if table.shape[1] else 0
        rest = table[:, last:]
        if last:
            yield from links(table[:, :last])
    if rest is not None and rest.shape[1]:
        yield from links(rest)


def exact_links(distinct: DataFrame, radius: int) -> DataFrame:
    """Forests (u, v) of representatives over all pairs of distinct fingerprints (fp, rep) within the radius."""
    rows = distinct.select("fp", "rep", F.lit(0).cast("long").alias("key"), F.lit(-1).cast("long").alias("free"))
    found = None
    while True:
        dealt = rows.mapInArrow(lambda it: _deal(it, radius + 1), "key long, fp long, rep long, free long")
        dealt = materialize(dealt, "tiles")
        large = materialize(dealt.where("free <> 0").groupBy("key").count().where(F.col("count") > GROUP).select("key"), "large")
        settled = dealt.join(large, "key", "left_anti")
        links = (
            settled.select("key", "rep", F.col("fp").alias("f0")).repartition("key").sortWithinPartitions("key")
            .mapInArrow(lambda it: _compare(it, radius, 1), "u long, v long")
        )
        found = links if found is None else found.unionByName(links)
        if large.isEmpty():
            return found
        rows = dealt.join(large, "key", "left_semi").select("fp", "rep", "key", "free")


def _deal_bands(batches: Iterator[pa.RecordBatch], words: int, bands: int, bits: int, keys_only: bool) -> Iterator[pa.RecordBatch]:
    """Each row once per band: the key names the band and its value."""
    names = [f"f{i}" for i in range(words)]
    for batch in batches:
        fp = np.stack([batch.column(n).to_numpy(zero_copy_only=False).view(U64) for n in names])
        for band in range(bands):
            at, shift = divmod(band * bits, 64)
            value = fp[at] >> U64(shift)
            if shift + bits > 64:
                value = value | fp[at + 1] << U64(64 - shift)
            value &= U64((1 << bits) - 1)
            key = pa.array(mix(value + U64((band + 1) << 32)).view(np.int64))
            if keys_only:
                yield pa.record_batch([key], names=["key"])
            else:
                yield pa.record_batch([key, batch.column("rep"), *(batch.column(n) for n in names)], names=["key", "rep", *names])


def banded_links(distinct: DataFrame, radius: int, words: int, bands: int, bits: int) -> DataFrame:
    """Forests (u, v) over the pairs of distinct fingerprints (f0.., rep) that share a band and lie within the radius."""
    names = [f"f{i}" for i in range(words)]
    rows = distinct.select("rep", *names)
    keys = rows.mapInArrow(lambda it: _deal_bands(it, words, bands, bits, True), "key long")
    sizes = keys.groupBy("key").count().where(F.col("count") > GROUP)
    large = materialize(sizes.select("key", F.ceil(F.col("count") / GROUP).cast("long").alias("tiles")), "large")
    dealt = rows.mapInArrow(lambda it: _deal_bands(it, words, bands, bits, False), ", ".join(f"{n} long" for n in ["key", "rep", *names]))
    n = large.count()
    if n:
        # a row of a large group goes to each pair of tiles that its own is in
        dealt = dealt.join(F.broadcast(large) if n <= BROADCAST_KEYS else large, "key", "left")
        dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")))
        dealt = dealt.withColumn("other", F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))))
        pair = F.xxhash64("key", F.least("tile", "other"), F.greatest("tile", "other"))
        side = F.when(F.col("tile") < F.col("other"), 1).when(F.col("tile") > F.col("other"), 2).otherwise(0).cast("long")
        dealt = dealt.select(F.when(F.col("tiles").isNull(), F.col("key")).otherwise(pair).alias("key"), "rep", *names, side.alias("side"))
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _compare(it, radius, words, n > 0), "u long, v long")


def near_duplicates(docs: DataFrame, k: int = 5, radius: int = 86, words: int = 8, bands: int = 30, bits: int = 14) -> DataFrame:
    """doc_id, t0 and t1 of each row and the number component_id of its group, by 64 * ``words``-bit fingerprints over k-word shingles.  Of
    512 bits, distance 86 is where pairs of Jaccard similarity 0.8 (distance 78 expected, deviation 8) are linked with probability 0.85,
    those of 0.85 with 0.99.  Fingerprints are numbered, so neither null nor repeated ids tie groups together."""
    names = [f"f{i}" for i in range(words)]
    prints = materialize(fingerprints(docs, k, words, with_text=True), "fingerprints")
    distinct = materialize(prints.select(*names).distinct().withColumn("rep", F.monotonically_increasing_id()), "distinct")
    roots = connected_components(banded_links(distinct, radius, words, bands, bits))
    named = distinct.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(*names, F.coalesce("root", "rep").alias("component_id"))
    return materialize(prints.join(named, names).select("doc_id", "t0", "t1", "component_id"), "members")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per group: that of the smallest id (null is the smallest; of rows with that id, the one of the smallest text hash; of
    rows equal in id and text, any one)."""
    rows = near_duplicates(docs, **options).groupBy("component_id", "doc_id", "t0", "t1").agg(F.count("*").alias("n"))
    stays = materialize(rows.groupBy("component_id").agg(F.min(F.struct("doc_id", "t0", "t1", "n")).alias("row")).select("row.*"), "stays")
    one = stays.select(F.col("doc_id").alias("__id"), F.col("t0").alias("__t0"), F.col("t1").alias("__t1"))
    kept = docs.withColumns({"__own": F.col("doc_id").cast("long"), **{f"__own_{c}": v for c, v in text_keys().items()}})
    kept = kept.join(one, F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__own_t0") == F.col("__t0")) & (F.col("__own_t1") == F.col("__t1")), "left_semi")
    if not stays.where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["__own", "__own_t0", "__own_t1"])
    return kept.drop("__own", "__own_t0", "__own_t1")


def simhash_components(docs: DataFrame, k: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links."""
    prints = materialize(fingerprints(docs, k).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.col("f0").alias("fp")), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    roots = connected_components(exact_links(distinct, radius))
    named = distinct.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    null = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return prints.join(named, "fp").select(null("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), null("component_id"))
