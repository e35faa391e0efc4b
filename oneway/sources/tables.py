"""Result tables: records by kind, jobs by key, and label corpora."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_domains(spark: SparkSession, path: str) -> DataFrame:
    """label, family, domain from CSV; rows with fewer fields are left out."""
    rows = spark.read.schema("label string, family string, domain string, bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad").csv(path)
    return rows.where("domain is not null").select("label", "family", "domain")


def replace_records(records: DataFrame, path: str) -> None:
    """Replace the stored records of the kinds present: one folder per kind."""
    records.withColumn("payload", F.to_json(F.struct(*[c for c in records.columns if c not in ("kind", "record_id")]))).select("kind", "record_id", "payload").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind").parquet(path)


def load_records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("kind") == kind).select("record_id", "payload")


#: What a job can be in, in the order of its life.
JOB_STATES = ("queued", "processing", "completed", "failed")


def latest_jobs(changes: DataFrame) -> DataFrame:
    """Each job's last version."""
    return changes.groupBy("job_id").agg(F.max_by(F.struct(*changes.columns), "version").alias("__last")).select("__last.*")


def job_counts(jobs: DataFrame) -> DataFrame:
    """Jobs by status, zero for a state that none is in."""
    states = jobs.sparkSession.createDataFrame([(s,) for s in JOB_STATES], "status string")
    known = jobs.groupBy("status").agg(F.count("*").alias("jobs"))
    return states.join(known, "status", "full").select("status", F.coalesce("jobs", F.lit(0)).alias("jobs"))


def upsert_jobs(current: DataFrame | None, changes: DataFrame, path: str) -> str:
    """Jobs after changes (job_id, version, ...), written as a new snapshot folder whose path is returned: readers of the old one are
    not disturbed, and a failed write leaves it in force."""
    rows = changes if current is None else current.unionByName(changes, allowMissingColumns=True)
    last = latest_jobs(rows)
    snapshot = f"{path}/{uuid.uuid4().hex}"
    last.write.parquet(snapshot)
    return snapshot


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_jdbc(rows: DataFrame, url: str, table: str, **options) -> None:
    rows.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()
