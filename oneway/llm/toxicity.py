"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade <= j) = sigmoid(theta_j - w x): one weight vector for all ordered thresholds theta_0 < theta_1 < ...  Features are the
presence of folded words (letters and digits); a screen keeps those whose shares among clean and toxic documents differ
significantly, and an L1 penalty keeps few of these.  Toxic and clean documents weigh the same in total.  The result is the probability of each grade or more, the expected
severity, and the toxic flag (probability of grade 1 or more at least one half).

The model is fitted on the driver to at most ``SAMPLE`` labelled documents (those of smallest id hash, until they have ``SAMPLE_WORDS``
different words each counted in its document); scoring reads every whole text.  The broadcast model has the words that pass the screen,
at most ``SAMPLE_WORDS`` / 2 of 16 bytes, as a word must be in two documents.

Rows: null and empty texts have no features and get the base severity.  Labels with nulls are left out; of repeated labels the
largest grade counts, of texts that share a labelled id that of the smallest hash.  Without labels of two grades no document is toxic.  Extra columns are kept; columns named like the
added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oneway.llm.shared import materialize
from oneway.llm.textkit import SEP_PUNCT, U64, HashIndex, Words, chunks, group_starts, text_buffer

#: Labelled documents that the model is fitted to, at most.
SAMPLE = 8_000
#: Words of the sample, each once for a document that has it; the document that reaches it is the last.
SAMPLE_WORDS = 8_000_000
SCREEN_Z = 4.5
L1 = 2e-3


@dataclass
class OrdinalModel:
    """``keys``: word hashes, ``weights``: their weights, ``theta``: thresholds between the ordered grades."""

    keys: np.ndarray
    weights: np.ndarray
    theta: np.ndarray
    grades: np.ndarray

    def at_least(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... for linear predictors x; grades the sample lacks share the next higher's."""
        most = int(self.grades.max()) if len(self.grades) else 0
        out = np.zeros((len(x), most))
        for g in range(1, most + 1):
            j = int(np.searchsorted(self.grades, g)) - 1  # the threshold below the first known grade that is g or more
            out[:, g - 1] = 1 / (1 + np.exp(np.clip(self.theta[j] - x, -500, 500)))
        return out


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, word hash), each pair once, sorted."""
    h, d = words.hashes(), words.text_of_word()
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    at = group_starts(d, h)
    return d[at], h[at]


def _sample(docs: DataFrame, grades: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    grades = grades.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    chosen = grades.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "grade").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                words = Words(*text_buffer(part.column("text")), SEP_PUNCT, lower=True)
                d, h = features(words)
                cut = np.searchsorted(d, np.arange(part.num_rows + 1))
                yield pa.record_batch([part.column("doc_id"), part.column("grade"), pa.array([h[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], names=["doc_id", "grade", "words"])

    found = materialize(texts.mapInArrow(run, "doc_id long, grade int, words binary"), "sample")  # at most SAMPLE rows
    before = F.sum(F.octet_length("words") / 8).over(W.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, -1))
    within = found.select("doc_id", before.alias("before")).where(F.coalesce("before", F.lit(0)) < SAMPLE_WORDS).select("doc_id")
    rows = sorted(found.join(within, "doc_id").collect())
    return [np.frombuffer(bytes(r["words"]), U64) for r in rows], np.array([r["grade"] for r in rows], np.int64)


def fit(words: list[np.ndarray], grade: np.ndarray, steps: int = 600) -> OrdinalModel:
    """Adam with a proximal L1 step; thresholds stay ordered as a first value and positive gaps."""
    known = np.unique(grade)
    if len(known) < 2:
        return OrdinalModel(np.empty(0, U64), np.empty(0), np.empty(0), np.empty(0, np.int64))
    row = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])
    flat = np.concatenate(words)
    keys, seen = np.unique(flat, return_counts=True)
    keys = keys[seen >= 2]  # a word of one document cannot pass the screen
    col = HashIndex(keys).find(flat).astype(np.int32)
    row, col = row[col >= 0], col[col >= 0]
    del flat
    toxic = grade > known[0]
    n1, n0 = toxic.sum(), (~toxic).sum()
    a, b = (np.bincount(col[side[row]], minlength=len(keys)) for side in (toxic, ~toxic))
    p = (a + b) / (n1 + n0)
    z = (a / n1 - b / n0) / np.sqrt(np.maximum(p * (1 - p) * (1 / n1 + 1 / n0), 1e-12))  # two proportions, pooled
    keep = np.flatnonzero(np.abs(z) >= SCREEN_Z)  # all that pass: their number is bounded by the sample's words
    place = np.full(len(keys), -1, np.int32)
    place[keep] = np.arange(len(keep), dtype=np.int32)
    col = place[col]
    row, col = row[col >= 0], col[col >= 0]
    y = np.searchsorted(known, grade)
    k, n = len(known), len(y)
    # clean and toxic documents weigh the same in total, so rare toxic ones decide as much as common clean ones
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y == 0).sum())
    share = np.cumsum(np.bincount(y, weights=weight, minlength=k))[:-1]
    theta = np.log(share / (1 - share))
    w = np.zeros(len(keep))
    free = np.concatenate([theta[:1], np.log(np.maximum(np.diff(theta), 1e-3)), w])
    m, v = np.zeros_like(free), np.zeros_like(free)
    for step in range(1, steps + 1):
        gaps = np.exp(np.clip(free[1 : k - 1], -20, 20))
        theta, w = free[0] + np.concatenate([[0], np.cumsum(gaps)]), free[k - 1 :]
        x = np.bincount(row, weights=w[col], minlength=n)
        cut = np.concatenate([[-np.inf], theta, [np.inf]])
        hi, lo = (1 / (1 + np.exp(-np.clip(cut[y + s] - x, -500, 500))) for s in (1, 0))
        p = np.maximum(hi - lo, 1e-9)
        up, down = hi * (1 - hi) / p, lo * (1 - lo) / p
        by_theta = np.zeros(k + 1)
        np.add.at(by_theta, y + 1, -up * weight)
        np.add.at(by_theta, y, down * weight)
        inner = by_theta[1:k]
        grad = np.concatenate([[inner.sum()], gaps * np.cumsum(inner[::-1])[::-1][1:], np.bincount(col, weights=((up - down) * weight)[row], minlength=len(w))])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        rate = 0.1 / (1 + step / 200)
        free = free - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        free[k - 1 :] = np.sign(free[k - 1 :]) * np.maximum(np.abs(free[k - 1 :]) - rate * L1, 0)
    theta, w = free[0] + np.concatenate([[0], np.cumsum(np.exp(np.clip(free[1 : k - 1], -20, 20)))]), free[k - 1 :]
    used = np.flatnonzero(w)
    return OrdinalModel(keys[keep][used], w[used], theta, known)


def train(docs: DataFrame, grades: DataFrame) -> OrdinalModel:
    """``grades`` has doc_id and grade (0: clean)."""
    return fit(*_sample(docs, grades))


def grades_of_labels(labels: DataFrame) -> DataFrame:
    """0: not toxic, 1: toxic, 2: toxic and of low quality."""
    return labels.where("toxic is not null").select("doc_id", (F.col("toxic") * (1 + F.when(F.col("quality") == 0, 1).otherwise(0))).alias("grade"))


def score_toxicity(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """The rows with p_toxic, p_severe (null if the model knows no second grade), expected_severity, grade (rounded), toxic."""
    spark = docs.sparkSession
    added = ("p_toxic", "p_severe", "expected_severity", "grade", "toxic")
    docs = docs.select([c for c in docs.columns if c.lower() not in added])
    shared = spark.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        index = HashIndex(model.keys)
        for batch in batches:
            for part in chunks(batch):
                words = Words(*text_buffer(part.column("text")), SEP_PUNCT, lower=True)
                at = index.find(words.hashes())
                hit = np.flatnonzero(at >= 0)
                d = words.text_of_word()[hit]
                pair = np.unique(d.astype(np.int64) * max(1, len(model.keys)) + at[hit])  # presence, not counts
                n = max(1, len(model.keys))
                x = np.bincount(pair // n, weights=model.weights[pair % n] if len(pair) else None, minlength=part.num_rows).astype(float)
                p = model.at_least(x)
                first = p[:, 0] if p.shape[1] else np.zeros(part.num_rows)
                severe = pa.array(p[:, 1]) if p.shape[1] > 1 else pa.nulls(part.num_rows, pa.float64())
                expected = p.sum(axis=1)
                yield pa.record_batch(
                    [*part.columns, pa.array(first), severe, pa.array(expected), pa.array(np.floor(expected + 0.5).astype(np.int32)), pa.array(first >= 0.5)],
                    names=[*names, *added],
                )

    kinds = (T.DoubleType(), T.DoubleType(), T.DoubleType(), T.IntegerType(), T.BooleanType())
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *map(T.StructField, added, kinds)]))
