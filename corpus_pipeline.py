"""A corpus from raw documents: toxic ones out, one of each group of near-duplicates, none with benchmark passages, sources mixed to
their weights, and shards of bounded size.  Each stage is written and read again before the next.

Rows: stages take the five columns of documents and leave others out, whatever they are called.  Null and empty texts are never toxic, never
contaminated, near-duplicates of each other only, and take part in the mix with size 0, of which no copy is taken.  Rows without an
id, or with one id, are documents of their own where their texts differ; of rows equal in id and text near_duplicates keeps one.
Ties go to the smaller id.  Empty tables give empty stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oneway.llm.decontaminate import decontaminate
from oneway.llm.mixing import mix_sources
from oneway.llm.queries import SHARD_BYTES, table
from oneway.llm.sharding import extendible_shards, read_shards, write_shards
from oneway.llm.shared import materialize, new_path
from oneway.llm.simhash import drop_near_duplicates
from oneway.llm.toxicity import grades_of_labels, score_toxicity, train

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic is at least one half go."""
    docs = docs.select(COLUMNS)
    model = train(docs, grades_of_labels(table(spark, sf_dir, "labels")))
    return score_toxicity(docs, model).where(~F.col("toxic")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word-shingle similarity 0.8 or more stays."""
    return drop_near_duplicates(docs.select(COLUMNS)).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tiles cover three fifths of a benchmark item go."""
    return decontaminate(docs.select(COLUMNS), table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select(COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document appears once for each copy that the mix takes of it, or not at all."""
    mixed = mix_sources(docs.select(COLUMNS)).where("copies > 0")
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(COLUMNS)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard, as read back from shards written one folder each (``s`` and the shard's name)."""
    sharded = extendible_shards(docs.select(COLUMNS), SHARD_BYTES)
    path = new_path(spark, "shards")
    write_shards(sharded, path)
    return read_shards(spark, path, sharded.schema)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: Not expressible in SQL: the toxicity model and the fingerprints are fitted and compared outside of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
