"""Spark session defaults and the shared working folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "larkspur", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    Shuffle partitions are left to the cluster: adaptive execution coalesces small ones and splits skewed ones.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "5000",
        "spark.sql.parquet.filterPushdown": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, else the warehouse folder. Never a machine-local temporary one."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/shared"
    return configured.rstrip("/")


def workspace(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared one; every caller gets its own."""
    return f"{shared_root(spark)}/larkspur/{purpose}-{uuid.uuid4().hex}"


def application_folder(spark: SparkSession, purpose: str, source: str) -> str:
    """A folder that all jobs of this application that read the same source share."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, source).hex
    return f"{shared_root(spark)}/larkspur/{spark.sparkContext.applicationId}/{purpose}-{name}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows, written to the shared folder and read back: later plans start from there, also after failures."""
    path = workspace(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
