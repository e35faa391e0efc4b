"""Tables written in the cluster's shared folder, to cut lineage and to feed several consumers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only where none is set, as in local tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="oneway-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/oneway-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: a lost executor costs no recomputation beyond it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession, total_bytes: int = 0, each: int = 16 << 20) -> int:
    """Buckets for ``total_bytes``: as many as the session's shuffle partitions, more where a bucket would exceed ``each``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total_bytes) // each), 1)


#: Buckets that a bucketed table can have, well below Spark's own limit.
MOST_BUCKETS = 50_000


def bucketed(df: DataFrame, name: str, by: str, n: int) -> DataFrame:
    """Write a table to the shared folder in ``n`` buckets of a column, so that grouping by it needs no further exchange; with more
    buckets than MOST_BUCKETS it is only written, and grouping exchanges it."""
    if n > MOST_BUCKETS:
        return materialize(df, name)
    spark = df.sparkSession
    table = f"oneway_{name}_{uuid.uuid4().hex}"
    df.repartition(n, by).write.bucketBy(n, by).sortBy(by).option("path", new_path(spark, name)).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the plan keeps its buckets and files; the catalog keeps nothing
    return out
