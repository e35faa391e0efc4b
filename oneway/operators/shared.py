"""Tables that several parts of a plan read, written once to the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only where none is set and the master is local, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="oneway-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def written(table: DataFrame, name: str) -> DataFrame:
    """The table, written and read again: it is computed once, a lost executor takes nothing of it along, and readers fetch the columns that
    they need.  The files go when the session's JVM ends."""
    spark = table.sparkSession
    path = f"{shared_folder(spark)}/oneway-{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)
