"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items share a seed if they share ``match`` consecutive tokens (letters and digits, case folded).  For each
document and item whose seeds could cover enough of the item, the longest match of unmarked tokens is marked again and again,
found by running Karp-Rabin hashes of ever shorter lengths, down to ``match`` tokens.  The share of the item's tokens
that the tiles cover does not depend on their order, so reordered passages are caught; a document is contaminated if the share
reaches the threshold.  An item shorter than ``match`` tokens is one tile: it has to occur whole.

Scale: the benchmark is broadcast as hashes, in slices of at most ``MAX_BENCHMARK`` bytes of whole items.  With one slice, documents are
read once and never shuffled.  With more, each slice is a job of its own that writes what it finds by text, before the next
slice is broadcast, and documents are joined with their finds at the end.  Tiling is linear in a text for each length of match.

Rows: null and empty texts or items match nothing.  Items with the same tokens are one, that of the smallest id, however many
slices there are.  Extra columns are kept; columns named like the added ones are replaced.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oneway.llm.shared import materialize
from oneway.llm.textkit import SEP_PUNCT, U64, HashIndex, Words, chunks, grams, text_buffer

#: Bytes of benchmark text that are broadcast at a time.
MAX_BENCHMARK = 8 << 20
ADDED = ("item_id", "coverage", "n_items", "contaminated")


_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


class Running:
    """Karp-Rabin hashes of every run of tokens, from one pass over them."""

    def __init__(self, tokens: np.ndarray):
        def powers(base: int) -> np.ndarray:
            out = np.full(len(tokens) + 1, base, U64)
            out[0] = 1
            return np.multiply.accumulate(out)

        self.sums = np.zeros(len(tokens) + 1, U64)
        np.cumsum(tokens * powers(_BASE)[:-1], out=self.sums[1:])
        self.back = powers(_INVERSE)

    def runs(self, n: int, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of the runs of n free tokens."""
        count = np.concatenate([[0], np.cumsum(free)])
        at = np.flatnonzero(count[n:] - count[:-n] == n)
        return at, (self.sums[at + n] - self.sums[at]) * self.back[at]


def tile(doc: np.ndarray, item: np.ndarray, match: int) -> int:
    """Item tokens covered by greedy string tiling: at each length, longest first, non-overlapping matches are marked, in the order of
    their places in the item and then in the document."""
    free_d, free_i = np.ones(len(doc), bool), np.ones(len(item), bool)
    by_d, by_i = Running(doc), Running(item)
    covered, length = 0, min(len(doc), len(item))
    while length >= match:
        # longest match of unmarked tokens by bisection: a match of n tokens holds ones of n - 1
        lo, hi, best = match, length, 0
        while lo <= hi:
            n = (lo + hi) // 2
            if np.isin(by_i.runs(n, free_i)[1], by_d.runs(n, free_d)[1]).any():
                best, lo = n, n + 1
            else:
                hi = n - 1
        if not best:
            break
        x, hx = by_d.runs(best, free_d)
        order = np.argsort(hx, kind="stable")
        x, hx = x[order], hx[order]
        y, hy = by_i.runs(best, free_i)
        first, last = np.searchsorted(hx, hy, "left").tolist(), np.searchsorted(hx, hy, "right").tolist()
        at: dict[int, int] = {}  # what a hash's places in the document are used up to
        marked = 0
        for i, lo, hi in zip(y.tolist(), first, last):
            j = at.get(lo, lo)
            if j < hi and free_i[i : i + best].all():
                while j < hi and not (free_d[x[j] : x[j] + best].all() and (doc[x[j] : x[j] + best] == item[i : i + best]).all()):
                    j += 1
                if j < hi:
                    free_d[x[j] : x[j] + best] = free_i[i : i + best] = False
                    marked += best
                at[lo] = j
        covered += marked
        length = min(best if marked else best - 1, int(free_i.sum()))
    return covered


class Benchmark:
    """Token hashes of items, and an index from seeds to the items and places that have them."""

    def __init__(self, ids: list[int], tokens: list[np.ndarray], match: int):
        self.ids, self.tokens, self.match = ids, tokens, match
        seeds, place = [], []
        for i, t in enumerate(tokens):
            n = min(match, len(t))
            if n:
                g = grams(t, n, n)
                seeds.append(g)
                place.append(np.stack([np.full(len(g), i), np.arange(len(g))], 1))
        seed = np.concatenate(seeds) if seeds else np.empty(0, U64)
        where = np.concatenate(place) if place else np.empty((0, 2), np.int64)
        order = np.argsort(seed, kind="stable")
        self.where = where[order]
        self.seeds, self.start = np.unique(seed[order], return_index=True)
        self.start = np.append(self.start, len(order))
        self.short = sorted({len(t) for t in tokens if 0 < len(t) < match})
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.seeds >> U64(44)).astype(np.int64)] = True

    def seeds_in(self, h: np.ndarray, index: HashIndex) -> tuple[np.ndarray, np.ndarray]:
        """(place in h, seed number) of the seeds that occur in h; the places of shorter items' seeds likewise."""
        at, found = [], []
        for n in [*self.short, self.match]:
            g = grams(h, n, n)
            maybe = np.flatnonzero(self.filter[(g >> U64(44)).astype(np.int64)])
            s = index.find(g[maybe])
            at.append(maybe[s >= 0])
            found.append(s[s >= 0])
        return np.concatenate(at), np.concatenate(found)


def _judge(part: pa.RecordBatch, bench: Benchmark, index: HashIndex, threshold: float) -> list[tuple[int, float, int]]:
    """(document, best item, coverage, items at or over the threshold) of the documents with some coverage."""
    words = Words(*text_buffer(part.column("text")), SEP_PUNCT, lower=True)
    h = words.hashes()
    at, seed = bench.seeds_in(h, index)
    doc = np.searchsorted(words.first, at, "right") - 1
    # the seeds found near a text's end must not reach into the next text
    n = np.array([min(bench.match, len(bench.tokens[bench.where[bench.start[s], 0]])) for s in seed.tolist()], np.int64)
    inside = at + n <= words.first[doc + 1] if len(at) else np.zeros(0, bool)
    doc, seed = doc[inside], seed[inside]
    if not len(doc):
        return []
    pair = np.unique(np.stack([doc, seed], 1), axis=0)  # each seed once for a document
    size = np.diff(bench.start)[pair[:, 1]]
    rows = np.repeat(bench.start[pair[:, 1]] - np.cumsum(size) + size, size) + np.arange(size.sum())
    d, where = np.repeat(pair[:, 0], size), bench.where[rows]
    order = np.lexsort((where[:, 1], where[:, 0], d))
    d, where = d[order], where[order]
    cut = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (where[1:, 0] != where[:-1, 0])]))
    best: dict[int, tuple[int, float, int]] = {}
    for lo, hi in zip(cut, np.append(cut[1:], len(d))):
        i, own = int(where[lo, 0]), int(d[lo])
        item = bench.tokens[i]
        n = min(bench.match, len(item))
        mark = np.zeros(len(item) + 1, np.int64)
        np.add.at(mark, where[lo:hi, 1], 1)
        np.add.at(mark, where[lo:hi, 1] + n, -1)
        if (np.cumsum(mark)[:-1] > 0).sum() < threshold * len(item):
            continue  # its tiles could not reach the threshold
        part_h = h[words.first[own] : words.first[own + 1]]
        # tokens the item lacks separate matches; runs of them shrink to one
        known = np.isin(part_h, item)
        part_h = part_h[known | np.concatenate([[True], known[:-1]])]
        share = tile(part_h, item, n) / len(item)
        if share > 0:
            item_id, most, hits = best.get(own, (0, 0.0, 0))
            if share > most or share == most and bench.ids[i] < item_id:
                item_id, most = bench.ids[i], share
            best[own] = (item_id, most, hits + (share >= threshold))
    return [(own, *x) for own, x in sorted(best.items())]


def _slices(benchmark: DataFrame, match: int) -> Iterator[Benchmark]:
    text = F.col("text").cast("string")
    tokens = F.trim(F.regexp_replace(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), r"[\x00-/:-@\[-`{-\x7F]+", " "))
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), tokens.alias("tokens"))
    rows = rows.where("tokens <> ''").groupBy("tokens").agg(F.min("item_id").alias("item_id")).orderBy("item_id", "tokens")
    ids, hashes, size = [], [], 0
    for r in rows.toLocalIterator():
        ids.append(r["item_id"])
        hashes.append(Words(*text_buffer(pa.array([r["tokens"]])), SEP_PUNCT).hashes())
        size += len(r["tokens"])
        if size >= MAX_BENCHMARK:
            yield Benchmark(ids, hashes, match)
            ids, hashes, size = [], [], 0
    yield Benchmark(ids, hashes, match)


def _judged(docs: DataFrame, bench: Broadcast, threshold: float) -> DataFrame:
    """The rows with item_id, coverage and n_items by one slice."""
    plain = docs.columns
    schema = T.StructType([*docs.schema.fields, *map(T.StructField, ADDED[:3], (T.LongType(), T.DoubleType(), T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = HashIndex(bench.value.seeds)
        for batch in batches:
            for part in chunks(batch):
                item, cover, hits = [None] * part.num_rows, [0.0] * part.num_rows, [0] * part.num_rows
                for d, i, c, n in _judge(part, bench.value, index, threshold):
                    item[d], cover[d], hits[d] = i, c, n
                yield pa.record_batch([*part.columns, pa.array(item, pa.int64()), pa.array(cover, pa.float64()), pa.array(hits, pa.int64())], names=[*plain, *ADDED[:3]])

    return docs.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, match: int = 5, threshold: float = 0.6) -> DataFrame:
    """The rows with the best item, its coverage, the number of items at or over the threshold, and contaminated.  Items whose seeds in
    the document could not cover the threshold are not tiled: they count as coverage 0 and no item."""
    docs = docs.select([c for c in docs.columns if c.lower() not in ADDED])
    send = docs.sparkSession.sparkContext.broadcast
    slices = _slices(benchmark, match)
    first, second = next(slices), next(slices, None)
    if second is None:
        out = _judged(docs, send(first), threshold)
    else:
        # a text's finds are the same in all its rows
        keys = {"__t0": F.xxhash64("text"), "__t1": F.xxhash64(F.lit(1), "text")}
        found = []
        for bench in chain((first, second), slices):
            sent = send(bench)
            some = _judged(docs.select("text"), sent, threshold).where("item_id is not null").withColumns(keys).drop("text").dropDuplicates(list(keys))
            found.append(materialize(some, "finds"))
            sent.unpersist()
        best = F.max_by(F.struct("item_id", "coverage"), F.struct("coverage", (-F.col("item_id")).alias("i")))
        by_text = reduce(DataFrame.unionByName, found).groupBy(*keys).agg(best.alias("b"), F.sum("n_items").alias("n_items"))
        by_text = by_text.select(*(F.col(k).alias(k + "_of") for k in keys), F.col("b.item_id").alias("item_id"), F.coalesce("b.coverage", F.lit(0.0)).alias("coverage"), "n_items")
        out = docs.withColumns(keys).join(by_text, (F.col("__t0") == F.col("__t0_of")) & (F.col("__t1") == F.col("__t1_of")), "left")
        out = out.withColumns({"coverage": F.coalesce("coverage", F.lit(0.0)), "n_items": F.coalesce("n_items", F.lit(0).cast("long"))}).select(*docs.columns, *ADDED[:3])
    return out.withColumn("contaminated", F.col("coverage") >= threshold)
