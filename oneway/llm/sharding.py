"""Sharding by extendible hashing.

A row's bucket is a prefix of its key's 60 hash bits.  The directory starts as one bucket; only buckets over the byte limit
split on another bit, so a row's shard is its shortest prefix whose rows fit.  Sums over a fine prefix are rolled up to all
shorter ones, which finds every split of a round at once; cells that are still too large go on with further bits.

Rows whose keys have equal hashes cannot be split by bits: they form overflow pages, each of as many rows as fit if all were
as large as the largest.  A row larger than the limit has a page of its own.  Such pages are numbered per partition and then offset, so that no task needs
all rows of a key.

Rows: a null key hashes as the empty string, a null text has size 0.  An empty table has no shards.  Extra columns are
kept; columns named like the added ones are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from oneway.llm.shared import materialize, new_path

BITS = 60
#: Directories up to this many cells are broadcast (24 bytes each); larger ones are joined by shuffle.
BROADCAST_CELLS = 200_000
#: Prefixes of up to so many bits (at most 2 ** (SHORT + 1) of them) are broadcast.
SHORT = 12
ADDED = ("shard", "depth", "page", "bytes")


def key_hash(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(hash_: str, bits: int) -> Column:
    return F.shiftright(hash_, BITS - bits) if bits else F.lit(0).cast("long")


def _cells(keyed: DataFrame, least: int, most: int, limit: int) -> DataFrame:
    """For each prefix of ``most`` bits its bucket's depth (null: too large still) and whether that holds one hash only."""
    fine = keyed.groupBy(_prefix("h", most).alias("cell")).agg(F.sum("b").alias("b"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.sum("n").alias("n"), F.max("most").alias("most"))
    fine = materialize(fine, "cells")
    levels = fine.withColumn("d", F.explode(F.sequence(F.lit(least), F.lit(most)))).withColumn("p", F.expr(f"shiftright(cell, {most} - d)"))
    fits = levels.groupBy("d", "p").agg(F.sum("b").alias("b"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"), F.max("most").alias("most"))
    fits = fits.where((F.col("b") <= limit) | (F.col("lo") == F.col("hi")))
    fits = fits.withColumn("capacity", F.when(F.col("b") > limit, F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("most", F.lit(1))))))
    # all cells share the short prefixes, of which there are few: those are broadcast
    short = F.col("d") <= SHORT
    cells, fits = levels.select("cell", "d", "p"), fits.select("d", "p", "capacity")
    held = cells.where(short).join(F.broadcast(fits.where(short)), ["d", "p"]).unionByName(cells.where(~short).join(fits.where(~short), ["d", "p"]))
    leaf = held.groupBy("cell").agg(F.min(F.struct("d", "capacity")).alias("leaf"))
    return fine.select("cell").join(leaf, "cell", "left").select("cell", F.col("leaf.d").alias("depth"), F.col("leaf.capacity").alias("capacity"))


def extendible_shards(rows: DataFrame, limit: int, key: str = "doc_id", size: Column | None = None) -> DataFrame:
    """The rows with shard (hash prefix as bits, with ``+page`` for overflow pages), depth, page and bytes."""
    size = F.octet_length("text") if size is None else size
    rows = rows.select([c for c in rows.columns if c.lower() not in ADDED])
    rows = rows.withColumns({"__h": key_hash(F.col(key)), "bytes": F.coalesce(size.cast("long"), F.lit(0).cast("long"))})
    keyed = rows.select(F.col("__h").alias("h"), F.col("bytes").alias("b"), F.lit(1).alias("n"), F.col("bytes").alias("most"))
    total = keyed.agg(F.sum("b")).first()[0] or 0
    least, most = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + 4)
    rows = rows.withColumns({"depth": F.lit(None).cast("int"), "__capacity": F.lit(None).cast("long")})
    plain = True
    while True:
        cells = materialize(_cells(keyed, least, most, limit), "directory")
        plain = plain and cells.where("capacity is not null").isEmpty()
        n = cells.count()
        named = cells.select(F.col("cell").alias("__cell"), F.col("depth").alias("__d"), F.col("capacity").alias("__c"))
        rows = rows.join(F.broadcast(named) if n <= BROADCAST_CELLS else named, _prefix("__h", most) == F.col("__cell"), "left")
        rows = rows.withColumns({"depth": F.coalesce("depth", "__d"), "__capacity": F.coalesce("__capacity", "__c")}).drop("__cell", "__d", "__c")
        large = cells.where("depth is null").select("cell")
        if most == BITS or large.isEmpty():
            break
        keyed = keyed.join(large, _prefix("h", most) == F.col("cell"), "left_semi")
        least, most = most + 1, min(BITS, most + 12)
    return _named(rows, plain)


def _named(rows: DataFrame, plain: bool) -> DataFrame:
    bits = F.expr(f"lpad(bin(shiftright(__h, {BITS} - depth)), depth, '0')")
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(bits)
    if plain:
        return rows.withColumns({"page": F.lit(0).cast("long"), "shard": bits}).drop("__h", "__capacity")
    spark = rows.sparkSession
    path = new_path(spark, "overflow")
    rows.where("__capacity is not null").withColumn("__part", F.spark_partition_id()).write.parquet(path)
    over = spark.read.parquet(path)
    # a hash's rows are numbered inside each part, and parts are offset by the counts before them
    counts = over.groupBy("__h", "__part").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(W.partitionBy("__h").orderBy("__part").rowsBetween(W.unboundedPreceding, -1))).drop("__n")
    at = F.row_number().over(W.partitionBy("__h", "__part").orderBy("bytes")) - 1 + F.coalesce("__before", F.lit(0))
    over = over.join(before, ["__h", "__part"]).withColumn("page", F.floor(at / F.col("__capacity")).cast("long")).drop("__part", "__before")
    rest = rows.where("__capacity is null").withColumn("page", F.lit(0).cast("long"))
    rows = rest.unionByName(over.select(rest.columns))
    shard = F.when(F.col("__capacity").isNotNull(), F.concat(bits, F.lit("+"), F.col("page").cast("string"))).otherwise(bits)
    return rows.withColumn("shard", shard).drop("__h", "__capacity")


def write_shards(sharded: DataFrame, path: str, file_format: str = "parquet") -> None:
    """One folder per shard (``s`` and the shard's name); the rows of a shard meet in one task, which its byte limit bounds."""
    sharded.withColumn("folder", F.concat(F.lit("s"), "shard")).repartition("folder").write.partitionBy("folder").format(file_format).save(path)


def read_shards(spark: SparkSession, path: str, schema: StructType, file_format: str = "parquet") -> DataFrame:
    """All shards that were written."""
    return spark.read.schema(schema).format(file_format).load(path).select(schema.names)


def shards_sql(limit: int) -> str:
    """The shards of ``documents`` by the definition, for DuckDB."""
    return f"""
    WITH h AS (SELECT doc_id, coalesce(strlen(text), 0) AS bytes,
                      ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h FROM documents),
    b AS (SELECT d, h >> ({BITS} - d) AS p, sum(bytes) AS total, max(bytes) AS most, min(h) = max(h) AS one
          FROM h, (SELECT unnest(range(0, {BITS + 1}))::INTEGER AS d) GROUP BY ALL),
    leaf AS (SELECT h.h, min(b.d) AS depth FROM (SELECT DISTINCT h FROM h) h JOIN b ON b.p = h.h >> ({BITS} - b.d)
             WHERE b.total <= {limit} OR b.one GROUP BY ALL),
    named AS (SELECT doc_id, bytes::BIGINT AS bytes, depth, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h.h >> ({BITS} - depth)), depth, '0') END AS name,
                     row_number() OVER (PARTITION BY h.h ORDER BY bytes) - 1 AS place, total, greatest(1, {limit} // greatest(1, most)) AS capacity
              FROM h JOIN leaf ON leaf.h = h.h JOIN b ON b.d = depth AND b.p = h.h >> ({BITS} - depth))
    SELECT doc_id, bytes, depth, CASE WHEN total > {limit} THEN name || '+' || (place // capacity)::VARCHAR ELSE name END AS shard FROM named"""
