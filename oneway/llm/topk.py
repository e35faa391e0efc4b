"""Exact top-k search by columnar branch and bound.

Candidates lie in blocks in vertical layout, one array per dimension, dimensions in order of falling variance.  For a block of
queries the inner products are accumulated dimension block by dimension block; after each, a candidate whose partial score plus
the product of the remaining norms (Cauchy-Schwarz) cannot reach the query's bound is out, and blocks compact to the
candidates that some query still needs.  A query's bound is its k-th best score over a first block of ``FIRST`` candidates, and rises
inside a task with the best that the task has seen.

Scale: queries are broadcast in slices of at most ``SLICE`` bytes, one job each over the candidate blocks, which never move; the
work is queries times candidates, as the contract says, cut by the bounds.  A task returns at most k rows a query, merged by
a window per query.  Each slice's finds are written before the next slice is sent.

Rows: vectors that are null or hold null or non-finite components take no part, neither as query nor as candidate.  Vectors of
unequal length are compared as if filled up with zeros.  Rows that repeat a vec_id are candidates of their own, never for
queries of that id; a query id that repeats is answered once, for its smallest vector.  Scores are exact for components of any
size; a score beyond the range of a long is that range's end, and such scores tie.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from oneway.llm.shared import materialize, partitions
from oneway.llm.textkit import pack, unpack

QUERY_BLOCK = 256
CANDIDATE_BLOCK = 2048
#: Bytes of packed queries that are broadcast at a time.
SLICE = 32 << 20
#: Dimensions that are accumulated between two looks at the bounds.
DIM_BLOCK = 8
#: Candidates that give the first bounds.
FIRST = 4096
#: From here on sums of products are not exact in doubles, and survivors are scored again in whole numbers.
EXACT = float(1 << 53)
LONG = (-(1 << 63), (1 << 63) - 1)


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and floor(scale * component) of the vectors that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    # every double of 2 ** 52 or more is whole, and a long could not hold all of them
    whole = lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(F.greatest(F.lit(-1.7e308), F.least(F.lit(1.7e308), x)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: whole(x.cast("double") * scale)).alias("v"))


def _small(v: np.ndarray) -> np.ndarray:
    """The values in the smallest type that keeps them."""
    return v.astype(np.int32) if np.abs(v).max(initial=0) < 1 << 31 else v


def _blocks(rows: DataFrame, size: int, dims: int) -> DataFrame:
    """Packed blocks of at most ``size`` rows: (block, data); a block is a run of rows of one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        ids, vectors, held = [], [], 0

        def flush(ids, vectors):
            i, v = np.concatenate(ids), np.concatenate(vectors)
            for lo in range(0, len(i), size):
                yield pack(i[lo : lo + size], _small(v[lo : lo + size].T.ravel()))

        for batch in batches:
            column = batch.column("v")
            lengths = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False)
            table = np.zeros((batch.num_rows, dims))
            row = np.repeat(np.arange(batch.num_rows), lengths)
            table[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
            ids.append(batch.column("vec_id").to_numpy(zero_copy_only=False))
            vectors.append(table)
            held += batch.num_rows
            if held >= size:
                for data in flush(ids, vectors):
                    yield pa.record_batch([pa.array([part << 32 | n], pa.int64()), pa.array([data], pa.binary())], names=["block", "data"])
                    n += 1
                ids, vectors, held = [], [], 0
        if held:
            for data in flush(ids, vectors):
                yield pa.record_batch([pa.array([part << 32 | n], pa.int64()), pa.array([data], pa.binary())], names=["block", "data"])
                n += 1

    return rows.mapInArrow(run, "block long, data binary").repartition(partitions(rows.sparkSession), "block")


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of matching columns in whole numbers, cut to a long's range."""
    whole = lambda x: np.frompyfunc(int, 1, 1)(x)
    return np.array([min(max(x, LONG[0]), LONG[1]) for x in (whole(q) * whole(c)).sum(axis=0)], np.int64)


def best(row: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's k largest scores, ties to the smaller id."""
    order = np.lexsort((ids, -(s + 1), row))  # -(s + 1) has no overflow
    row, ids, s = row[order], ids[order], s[order]
    top = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[top], ids[top], s[top]


def search_block(q_ids, q, bound, c_ids, c, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate id, score) of the candidates that reach ``bound`` and each query's k best of this block.

    ``q`` is (dims, queries), ``c`` (dims, candidates), both integer valued; ``bound`` holds one score per query."""
    dims = len(q)
    with np.errstate(over="ignore", invalid="ignore"):
        largest = dims * float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0))
        exact = largest < EXACT
        kind = np.float32 if largest < 1 << 24 else np.float64
        whole_q, whole_c = q, c
        q, c = q.astype(kind), c.astype(kind)
        q_mass = np.sqrt(np.cumsum((q.astype(np.float64) ** 2)[::-1], axis=0)[::-1])  # norms of what is left from a dimension on
        c_mass = np.sqrt(np.cumsum((c.astype(np.float64) ** 2)[::-1], axis=0)[::-1])
        alive = np.arange(c.shape[1])
        score = np.zeros((q.shape[1], len(alive)), kind)
        # what rounding may take from a score
        blur = (lambda: 0.0) if exact else (lambda: 1e-12 * q_mass[0][:, None] * c_mass[0][None, :])
        least = (bound - 1e-6 * (1 + np.abs(bound)))[:, None]
        for at in range(0, dims, DIM_BLOCK):
            to = min(dims, at + DIM_BLOCK)
            score += q[at:to].T @ c[at:to]
            if to < dims:
                keep = ~(score + q_mass[to][:, None] * c_mass[to][None, :] + blur() < least).all(axis=0)  # what is no number stays
                if keep.mean() < 0.8:  # compact the survivors
                    alive, score, c, c_mass = alive[keep], score[:, keep], c[:, keep], c_mass[:, keep]
                if not len(alive):
                    break
        own = q_ids[:, None] == c_ids[alive][None, :]
        row, col = np.nonzero((score >= bound[:, None] if exact else ~(score + blur() < least)) & ~own)
    if exact:
        s = score[row, col].astype(np.int64)
    else:
        s = np.concatenate([np.empty(0, np.int64), *(_exact(whole_q[:, row[i : i + 4096]], whole_c[:, alive[col[i : i + 4096]]]) for i in range(0, len(row), 4096))])
    return best(row, c_ids[alive][col], s, k)


def _raised(row: np.ndarray, s: np.ndarray, bound: np.ndarray, k: int) -> np.ndarray:
    """Bounds with the k-th best of rows as ``best`` gives them."""
    last = np.full(len(bound), -np.inf)
    full = np.flatnonzero(np.bincount(row, minlength=len(bound)) == k)
    if len(full):
        last[full] = s[np.searchsorted(row, full, "right") - 1]
    return np.maximum(bound, last)


def _slices(asked: DataFrame) -> Iterator[list[bytes]]:
    held, size = [], 0
    for r in asked.toLocalIterator():
        held.append(bytes(r["asked"]))
        size += len(held[-1])
        if size >= SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k largest inner products with rows of other ids, ties to the
    smaller vec_id."""
    spark = vectors.sparkSession
    rows = materialize(quantised(vectors, scale), "vectors")
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 1
    first = [(r["vec_id"], r["v"]) for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIRST).collect()]
    first_ids = np.array([x[0] for x in first], np.int64)
    first_v = np.zeros((dims, len(first)))
    for i, (_, v) in enumerate(first):
        first_v[: len(v), i] = v
    with np.errstate(over="ignore", invalid="ignore"):
        by_spread = np.argsort(-np.nan_to_num(first_v.var(axis=1)), kind="stable") if first else np.arange(dims)
    start = spark.sparkContext.broadcast((first_ids, _small(first_v[by_spread]), by_spread))

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids0, v0, order = start.value
        for batch in batches:
            for data in batch.column("data").to_pylist():
                ids, v = unpack(data)
                v = v.reshape(dims, len(ids))[order]
                row, _, s = search_block(ids, v, np.full(len(ids), -np.inf), ids0, v0, k)
                yield pa.record_batch([pa.array([pack(ids, v.ravel(), _raised(row, s, np.full(len(ids), -np.inf), k))], pa.binary())], names=["asked"])

    asked = materialize(_blocks(queries, QUERY_BLOCK, dims).mapInArrow(bounds, "asked binary"), "queries")
    blocks = materialize(_blocks(rows, CANDIDATE_BLOCK, dims), "candidates")
    found = [spark.createDataFrame([], "query_id long, vec_id long, score long")]
    for part in _slices(asked):
        sent = spark.sparkContext.broadcast(part)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            order = start.value[2]
            wanted = [unpack(x) for x in sent.value]
            held: list[list] = [[] for _ in wanted]
            for batch in batches:
                for data in batch.column("data").to_pylist():
                    c_ids, c = unpack(data)
                    c = c.reshape(dims, len(c_ids))[order]
                    for i, (ids, v, bound) in enumerate(wanted):
                        held[i].append(search_block(ids, v.reshape(dims, len(ids)), bound, c_ids, c, k))
                        if len(held[i]) == 8:
                            held[i] = [best(*map(np.concatenate, zip(*held[i])), k)]
                            wanted[i][2] = _raised(held[i][0][0], held[i][0][2], bound, k)
            for (ids, *_), parts in zip(wanted, held):
                if parts:
                    row, near, s = best(*map(np.concatenate, zip(*parts)), k)
                    yield pa.record_batch([pa.array(ids[row]), pa.array(near), pa.array(s)], names=["query_id", "vec_id", "score"])

        found.append(materialize(blocks.mapInArrow(search, "query_id long, vec_id long, score long"), "found"))
        sent.unpersist()
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    ranked = reduce(DataFrame.unionByName, found[1:] or found).withColumn("rank", rank)
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_k_sql(every: int, k: int, scale: int) -> str:
    return f"""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS v FROM embeddings
               WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {every} = 0)
    SELECT query_id, rank, vec_id, score FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= {k}"""
