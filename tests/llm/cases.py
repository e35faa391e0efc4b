"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""

from __future__ import annotations

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def words(n: int, seed: int, vocabulary: int = 300) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus() -> list[tuple]:
    passage = words(40, 1)
    texts = [words(60, 10), words(50, 11) + " " + passage, passage + "\n" + words(30, 12), words(60, 10), "", None, "One", "A  b\tC", words(2000, 13), "é ü " + words(20, 14), passage + " " + passage, words(60, 10) + " tail"]
    sources = ["a", "b", None, "a", "b", "c", "a", "ß", "a", "a", None, "b"]
    return [(i * 7, t, "en", s, len(t or "")) for i, (t, s) in enumerate(zip(texts, sources))]


def docs(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def cluttered(frame, *names):
    """The same rows with extra columns that clash with what operators add."""
    from pyspark.sql import functions as F

    for n in names:
        frame = frame.withColumn(n, F.lit("x"))
    return frame
