"""Tamper-evident evidence: Merkle roots, HMAC signatures, a hash chain per sensor, and its parallel verification.

Trees are unrolled to the few rounds that a block or bundle can have.  Sealing folds over a sensor's block headers, which carry one
root each and go on from the sensor's last block; verification compares every block with its predecessor by a window and needs no fold.  What is
hashed is canonical JSON (``functions.canonical``).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from oneway.functions.canonical import Json, canonical
from oneway.operators.ranges import positions
from oneway.operators.shared import written

BATCH = 8
ZERO = "0" * 64
EMPTY = hashlib.sha256(b"empty").hexdigest()
GENESIS = hashlib.sha256(b"genesis").hexdigest()
#: The leaf that stands for a bundle without packets.
NO_PACKETS = hashlib.sha256(b"-").hexdigest()
_LINK = {"s": pa.string(), "index": pa.int64(), "ts": pa.float64(), "merkle_root": pa.string(), "prev_hash": pa.string(), "header_hash": pa.string()}


def sha_pair(a: Column, b: Column) -> Column:
    return F.sha2(F.concat(F.unhex(a), F.unhex(b)), 256)


def next_level(level: Column) -> Column:
    """Pairs hashed; an odd last node pairs with itself."""
    half = F.ceil(F.size(level) / 2).cast("int")
    at = lambda i: F.element_at(level, i)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(half, F.lit(1))), lambda i: sha_pair(at(2 * i - 1), F.when(2 * i <= F.size(level), F.try_element_at(level, 2 * i)).otherwise(at(2 * i - 1))))
    return F.when(F.size(level) > 1, pairs).otherwise(level)


def merkle_levels(rows: DataFrame, leaves: str, most: int = 64) -> DataFrame:
    """Adds level0, level1, ... up to the root of at most ``most`` leaves (an error for more); no leaves count as one of
    sha256('empty')."""
    rounds = max(1, (most - 1).bit_length())
    many = F.raise_error(F.concat(F.lit(f"more than {most} leaves: "), F.size(leaves).cast("string"))).cast("array<string>")
    rows = rows.withColumn("level0", F.when(F.size(leaves) > most, many).when(F.size(leaves) > 0, F.col(leaves)).otherwise(F.array(F.lit(EMPTY))))
    for i in range(rounds):
        rows = rows.withColumn(f"level{i + 1}", next_level(F.col(f"level{i}")))
    return rows


def merkle_root(rows: DataFrame, leaves: str, most: int = 64, name: str = "merkle_root") -> DataFrame:
    rounds = max(1, (most - 1).bit_length())
    out = merkle_levels(rows, leaves, most).withColumn(name, F.element_at(f"level{rounds}", 1))
    return out.drop(*(f"level{i}" for i in range(rounds + 1)))


def proofs(rows: DataFrame, leaves: str, keep: list[str], most: int = 64) -> DataFrame:
    """One row per leaf: index, leaf, root and proof, an array of (sibling, side)."""
    rounds = max(1, (most - 1).bit_length())
    levels = merkle_levels(rows, leaves, most)
    each = levels.select(*keep, *(f"level{i}" for i in range(rounds + 1)), F.posexplode("level0").alias("index", "leaf"))
    steps = []
    for i in range(rounds):
        place = F.shiftright("index", i)
        sibling = place.bitwiseXOR(F.lit(1))
        level = F.col(f"level{i}")
        right = (sibling > place) | (sibling >= F.size(level))
        step = F.struct(F.coalesce(F.try_element_at(level, sibling + 1), F.try_element_at(level, place + 1)).alias("sibling"), F.when(right, "R").otherwise("L").alias("side"))
        steps.append(F.when(F.size(level) > 1, step))
    proof = F.filter(F.array(*steps), lambda s: s.isNotNull())
    return each.select(*keep, "index", "leaf", F.element_at(f"level{rounds}", 1).alias("root"), proof.alias("proof"))


def verify_proof(leaf: Column, proof: Column, root: Column) -> Column:
    """True if the proof leads from the leaf to the root; any side but L or R fails."""
    end = F.aggregate(proof, leaf, lambda h, s: F.when(s["side"] == "R", sha_pair(h, s["sibling"])).when(s["side"] == "L", sha_pair(s["sibling"], h)))
    return F.coalesce(end == root, F.lit(False))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a string, as hex, by two nested hashes over the padded key."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ p for b in key)) for p in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


Fields = Column | Json | dict


def bundle_json(alert: Fields, flow: Fields, packet_root: Column, features: Fields, model: Fields) -> Column:
    return canonical(alert=alert, flow=flow, features=features, model=model, pkt_root=packet_root)


def bundle_digest(alert: Fields, flow: Fields, packet_root: Column, features: Fields, model: Fields) -> Column:
    return F.sha2(bundle_json(alert, flow, packet_root, features, model), 256)


def batches(bundles: DataFrame, sensor: str = "sensor_id", order: str = "seq", digest: str = "digest", batch: int = BATCH) -> DataFrame:
    """(sensor, index from 1, ts, digests): bundles in order, sealed by ``batch``; the last may be short."""
    numbered = positions(bundles, [sensor], [order], "__n")
    grouped = numbered.groupBy(sensor, (F.floor(F.col("__n") / batch) + 1).cast("long").alias("index"))
    rows = grouped.agg(F.max("ts").alias("ts"), F.array_sort(F.collect_list(F.struct(F.col("__n").alias("n"), F.col(digest).alias("d")))).alias("__d"))
    return rows.withColumn("digests", F.transform("__d", lambda x: x["d"])).drop("__d")


def _at(ts: Column) -> Column:
    return ts.cast("decimal(20,6)")


def header_hash(index: Column, ts: Column, prev: Column, root: Column, sensor: Column) -> Column:
    return F.sha2(canonical(index=index, ts=_at(ts), prev_hash=prev, merkle_root=root, sensor_id=sensor), 256)


def _header(index: int, root: str, prev: str, sensor: str | None, at: str) -> str:
    """``header_hash`` for the fold."""
    sensor = "null" if sensor is None else json.dumps(sensor).replace("\x7f", "\\u007f")
    return hashlib.sha256(f'{{"index":{index},"merkle_root":"{root}","prev_hash":"{prev}","sensor_id":{sensor},"ts":{at}}}'.encode()).hexdigest()


def seal(blocks: DataFrame, key: bytes, sensor: str = "sensor_id", heads: DataFrame | None = None) -> DataFrame:
    """The blocks with prev_hash, header_hash, signature and anchor; before the first of a sensor its genesis (index 0).

    Each header hashes the one before, so a sensor's headers are folded in order: they come sorted from the shuffle, the fold carries
    one hash, and only index, time and root travel; digests stay where they are.  ``heads`` (sensor, index, header_hash) are the last blocks of chains
    to go on from; their sensors' blocks have later indexes.
    """
    rooted = written(merkle_root(blocks, "digests", BATCH), "blocks")  # headers and digests are read apart
    at = F.col("ts").cast("double")
    rows = rooted.select(F.col(sensor).cast("string").alias("s"), F.col("index").cast("long").alias("index"), at.alias("ts"), _at(at).cast("string").alias("at"), "merkle_root", F.lit(None).cast("string").alias("head"))
    if heads is not None:
        ends = heads.select(F.col(sensor).cast("string").alias("s"), F.col("index").cast("long").alias("index"), F.lit(None).cast("double").alias("ts"), F.lit(None).cast("string").alias("at"), F.lit(None).cast("string").alias("merkle_root"), F.col("header_hash").alias("head"))
        rows = rows.unionByName(ends)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, prev, known = None, ZERO, False
        for batch in batches:
            out = []
            for s, index, ts, at, root, head in zip(*(batch.column(c).to_pylist() for c in ("s", "index", "ts", "at", "merkle_root", "head"))):
                if not known or s != own:
                    own, known, prev = s, True, head or ZERO
                    if head is None:
                        h = _header(0, GENESIS, ZERO, s, "0.000000")
                        out.append((s, 0, 0.0, GENESIS, ZERO, h))
                        prev = h
                if head is None:
                    h = _header(index, root, prev, s, at)
                    out.append((s, index, ts, root, prev, h))
                    prev = h
            if out:
                yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*out), _LINK.values())], names=list(_LINK))

    links = rows.repartition("s").sortWithinPartitions("s", "index").mapInArrow(fold, "s string, index long, ts double, merkle_root string, prev_hash string, header_hash string")
    digests = rooted.select(F.col(sensor).cast("string").alias("__s"), F.col("index").alias("__i"), "digests")
    chain = links.withColumnRenamed("s", sensor).join(digests, F.col(sensor).eqNullSafe(F.col("__s")) & (F.col("index") == F.col("__i")), "left").drop("__s", "__i")
    chain = chain.withColumn("digests", F.coalesce("digests", F.array().cast("array<string>")))
    return chain.withColumns({"signature": hmac_sha256(key, F.col("header_hash")), "anchor": F.when(F.col("index") > 0, F.concat(F.lit("anchor://"), F.substring("header_hash", 1, 16)))})


class Ledger:
    """A chain in a folder that all executors share, to which batches of bundles are appended.

    A batch writes the blocks that it fills, and its state: the last block of each sensor and the bundles that wait for the next block.  It counts once
    its marker stands, which is made last and in one step; until then a retry writes over what is there, and afterwards it changes nothing.  Batches are
    appended in the order of their numbers.
    """

    BUNDLE = "sensor_id string, seq long, ts double, digest string"

    def __init__(self, spark: SparkSession, path: str, key: bytes):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def _fs(self):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def batches(self) -> list[int]:
        """Numbers of the batches that count."""
        fs, where = self._fs()
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(where)) if fs.exists(where) else []

    def chain(self) -> DataFrame:
        """All blocks so far."""
        done = self.batches()
        if not done:
            raise ValueError(f"no batch was appended to {self.path}")
        return self.spark.read.parquet(*(f"{self.path}/blocks/{n}" for n in done))

    def _state(self, number: int | None) -> tuple[DataFrame, DataFrame]:
        heads = "sensor_id string, index long, header_hash string"
        if number is None:
            return self.spark.createDataFrame([], heads), self.spark.createDataFrame([], self.BUNDLE)
        return self.spark.read.schema(heads).parquet(f"{self.path}/heads/{number}"), self.spark.read.schema(self.BUNDLE).parquet(f"{self.path}/pending/{number}")

    def pending(self) -> DataFrame:
        """Bundles that wait for a block."""
        return self._state((self.batches() or [None])[-1])[1]

    def append(self, bundles: DataFrame, number: int, close: bool = False) -> bool:
        """Add bundles (sensor_id, seq, ts, digest) as batch ``number``; with ``close`` the last, short blocks are sealed, too.  False if that batch counts
        already."""
        done = self.batches()
        if number in done:
            return False
        if done and number < done[-1]:
            raise ValueError(f"batch {number} comes after {done[-1]}")
        heads, pending = self._state(done[-1] if done else None)
        rows = written(pending.unionByName(bundles.selectExpr("cast(sensor_id as string) sensor_id", "cast(seq as long) seq", "cast(ts as double) ts", "digest")), "bundles")
        cut = batches(rows)
        full = cut if close else cut.where(F.size("digests") == BATCH)
        last = heads.select(F.col("sensor_id").alias("__s"), F.col("index").alias("__last"))
        full = full.join(last, F.col("sensor_id").eqNullSafe(F.col("__s")), "left").withColumn("index", F.col("index") + F.coalesce("__last", F.lit(0))).drop("__s", "__last")
        sealed = seal(full, self.key, heads=heads)
        sealed.write.mode("overwrite").parquet(f"{self.path}/blocks/{number}")
        sealed = self.spark.read.parquet(f"{self.path}/blocks/{number}")
        ends = sealed.groupBy("sensor_id").agg(F.max("index").alias("index"), F.max_by("header_hash", "index").alias("header_hash")).unionByName(heads)
        ends.groupBy("sensor_id").agg(F.max("index").alias("index"), F.max_by("header_hash", "index").alias("header_hash")).write.mode("overwrite").parquet(f"{self.path}/heads/{number}")
        if close:
            rest = rows.limit(0)
        else:
            place = positions(rows, ["sensor_id"], ["seq"], "__n")
            size = rows.groupBy(F.col("sensor_id").alias("__s")).agg(F.count("*").alias("__m"))
            rest = place.join(size, F.col("sensor_id").eqNullSafe(F.col("__s"))).where(F.col("__n") >= F.col("__m") - F.col("__m") % BATCH)
        rest.select("sensor_id", "seq", "ts", "digest").write.mode("overwrite").parquet(f"{self.path}/pending/{number}")
        fs, where = self._fs()
        fs.mkdirs(where)
        fs.create(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where, str(number)), False).close()
        return True

    def append_stream(self, bundles: DataFrame, checkpoint: str) -> StreamingQuery:
        """Append each micro-batch under its number, so that one that is retried counts once."""
        return bundles.writeStream.foreachBatch(lambda rows, number: self.append(rows, number) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def verify_chain(chain: DataFrame, key: bytes, sensor: str = "sensor_id") -> DataFrame:
    """One row per sensor: blocks, intact, and the first index whose root, link, header or signature does not hold."""
    rows = merkle_root(chain, "digests", BATCH, "__root")
    w = W.partitionBy(sensor).orderBy("index")
    genesis = F.col("index") == 0
    own = header_hash(F.col("index"), F.col("ts"), F.col("prev_hash"), F.col("merkle_root"), F.col(sensor))
    ok = (
        (own == F.col("header_hash")) & (F.when(genesis, F.col("merkle_root") == GENESIS).otherwise(F.col("__root") == F.col("merkle_root")))
        & (F.when(genesis, F.col("prev_hash") == ZERO).otherwise(F.col("prev_hash") == F.lag(own).over(w)))
        & (F.col("signature") == hmac_sha256(key, own))
    )
    rows = rows.withColumn("ok", F.coalesce(ok, F.lit(False)))
    return rows.groupBy(sensor).agg(F.count("*").alias("blocks"), F.min(F.when(~F.col("ok"), F.col("index"))).alias("broken_at")).withColumn("intact", F.col("broken_at").isNull())


def summary(chain: DataFrame, key: bytes, sensor: str = "sensor_id") -> DataFrame:
    rows = chain.groupBy(sensor).agg(F.sum(F.size("digests").cast("long")).alias("bundles"), F.substring(F.max_by("header_hash", "index"), 1, 16).alias("head"), F.count("anchor").alias("anchored"))
    return rows.join(verify_chain(chain, key, sensor), sensor)


def bundle_proofs(chain: DataFrame, sensor: str = "sensor_id") -> DataFrame:
    """A proof for each bundle against its own block's root, verified against the ledger and never against a root handed in."""
    named = chain.where(F.size("digests") > 0).select(sensor, F.col("index").alias("block"), "merkle_root", "digests")
    out = proofs(named, "digests", [sensor, "block", "merkle_root"], BATCH)
    return out.withColumn("verified", verify_proof(F.col("leaf"), F.col("proof"), F.col("merkle_root")))
