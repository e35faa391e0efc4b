"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Each source gets a share of the total by its weight, at most ``most`` times its own words; what is above goes to the others by
weight.  Blocks of ``block`` words (fewer where a source's target would be under LEAST_BLOCKS of them) are apportioned to sources by highest quotients, and each source's blocks to its hash shards
likewise.  A shard's documents, in seeded hash order, form one stream of words cut in blocks; its quota takes the whole stream
so many times and then a seeded run of blocks.  A document contributes the words it has in taken blocks.

Scale: words are summed in one pass by source and fine hash cell, and shards are unions of cells; the driver holds one row per source
(an error beyond MAX_SOURCES) and shard.  Streams are windows over one shard, whose words are bounded, so a source with a third
of all rows is spread over many tasks; rows that share an id, or have none, are spread by their texts' hashes.

Rows: null or empty texts have size 0 and take 0.  A null source is a source of its own, last in order.  Repeated rows are
documents of their own.  Reruns agree, whatever the partitioning.  Extra columns are kept; those named like the added ones
are replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from oneway.llm.shared import materialize

#: Words of one shard's stream, at least; larger where there would be more than MAX_CELLS streams.
SHARD_WORDS = 250_000
MAX_CELLS = 100_000
#: Hash cells of a source, of which its shards are made.
CELLS = 1 << 16
#: Rows that the driver may hold: one for each source.
MAX_SOURCES = 1_000_000
#: Blocks in the smallest target, at least, as long as a block has a word.
LEAST_BLOCKS = 16
WORD = r"[^\x20\x09-\x0D]+"
ADDED = ("size", "source_size", "target", "taken", "copies")


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float = 2.0) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size; the excess is shared again by weight."""
    out: list[float | None] = [None] * len(sizes)
    left = float(total)
    while True:
        open_ = [i for i, t in enumerate(out) if t is None]
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > most * sizes[i]] if weight else []
        if not over:
            return [(left * weights[i] / weight if weight else 0.0) if t is None else t for i, t in enumerate(out)]
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]


def apportion(votes: Sequence[float], seats: int, caps: Sequence[int] | None = None) -> list[int]:
    """Sainte-Laguë: each seat goes to the highest quotient votes / (2 n + 1), ties to the smaller index."""
    caps = [seats] * len(votes) if caps is None else caps
    seats, total = min(seats, sum(caps)), sum(votes)
    if not total or seats <= 0:
        return [0] * len(votes)
    # rounding at a divisor that cannot give out too many seats starts every party at or below its result
    start = seats - len(votes) / 2
    n = [min(c, int(v * start / total + 0.5)) if start > 0 else 0 for v, c in zip(votes, caps)]
    heap = [(-v / (2 * k + 1), i) for i, (v, k, c) in enumerate(zip(votes, n, caps)) if k < c and v > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(n)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        n[i] += 1
        if n[i] < caps[i]:
            heapq.heappush(heap, (-votes[i] / (2 * n[i] + 1), i))
    return n


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: int = 2, block: int = 64, seed: int = 17) -> DataFrame:
    """The rows with size, source_size, target, taken (words, repeats counted) and copies (whole documents taken: one for each
    pass over the stream and one if the document starts in the last run of blocks)."""
    spark = docs.sparkSession
    docs = docs.select([c for c in docs.columns if c.lower() not in ADDED]).withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    own = (F.col("doc_id"), F.xxhash64("text"))
    cell = F.pmod(F.xxhash64(F.lit(seed + 1), *own), F.lit(CELLS)).cast("int")
    fine = materialize(docs.groupBy("source", cell.alias("__cell")).agg(F.sum("size").alias("words")), "cells")
    found = fine.groupBy("source").agg(F.sum("words").alias("words")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found = sorted(((r["source"], r["words"]) for r in found), key=lambda x: (x[0] is None, (x[0] or "").encode()))
    names, sizes = [x[0] for x in found], [x[1] for x in found]
    total = sum(sizes)
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], share * total, most)
    block = max(1, min(block, int(min((t for t in goal if t), default=block) // LEAST_BLOCKS)))
    each = max(SHARD_WORDS, -(-total // MAX_CELLS))
    shards = [min(CELLS, max(1, -(-n // each))) for n in sizes]
    schema = "__source string, source_size long, target double, __shards int"
    known = F.broadcast(spark.createDataFrame([(*x,) for x in zip(names, sizes, goal, shards)], schema).coalesce(1))
    placed = lambda rows: rows.join(known, F.col("source").eqNullSafe(F.col("__source"))).drop("__source").withColumn("__shard", F.col("__cell") % F.col("__shards"))
    cells = placed(fine).groupBy("source", "__shard").agg(F.sum("words").alias("words")).collect()  # at most MAX_CELLS and the sources
    rows = placed(docs.withColumns({"__cell": cell, "__order": F.xxhash64(F.lit(seed), *own)})).drop("__cell")
    by: dict = {n: [] for n in names}
    for r in sorted(cells, key=lambda r: r["__shard"]):
        by[r["source"]].append((r["__shard"], r["words"]))
    blocks = {n: [-(-w // block) for _, w in by[n]] for n in names}
    quotas = apportion(goal, round(sum(goal) / block), [most * sum(blocks[n]) for n in names])
    plan = []
    for name, quota in zip(names, quotas):
        shares = apportion([w for _, w in by[name]], quota, [most * b for b in blocks[name]])
        for (shard, _), q, b in zip(by[name], shares, blocks[name]):
            first = (shard * 2654435761 + seed * 40503) % b if b else 0
            plan.append((name, shard, q // b if b else 0, first * block, (first + q % b) * block if b else 0, b * block))
    plan = spark.createDataFrame(plan, "__s string, __k int, __full int, __from long, __to long, __end long").coalesce(1)
    rows = rows.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("__s")) & (F.col("__shard") == F.col("__k")))
    stream = W.partitionBy("source", "__shard").orderBy("__order", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("__at", F.coalesce(F.sum("size").over(stream), F.lit(0)))
    within = lambda lo, hi: F.greatest(F.lit(0), F.least(F.col("__at") + F.col("size"), hi) - F.greatest(F.col("__at"), lo))
    run, around = within(F.col("__from"), F.least("__to", "__end")), within(F.lit(0), F.col("__to") - F.col("__end"))
    starts = ((F.col("__at") >= F.col("__from")) & (F.col("__at") < F.col("__to"))) | (F.col("__at") < F.col("__to") - F.col("__end"))
    return rows.withColumns({"taken": (F.col("__full") * F.col("size") + run + around).cast("long"), "copies": F.col("__full") + starts.cast("int")}).drop(
        "__shards", "__order", "__shard", "__s", "__k", "__full", "__from", "__to", "__end", "__at"
    )
