"""Shared scratch space: where plans that must cut their lineage write tables.

The folder is the one the cluster names in ``spark.checkpoint.dir``; only where
that setting is absent and the master is local a temporary folder takes its place;
on a cluster without it, asking for the folder is an error.  Tables
stay until the owner of the folder clears it, as results read later start at them.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """Base folder that the driver and every executor can reach."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local_dirs:
            _local_dirs[app] = "file://" + tempfile.mkdtemp(prefix="lectern-")
        base = _local_dirs[app]
    return f"{base.rstrip('/')}/lectern"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the scratch space and read it back.

    The returned plan starts at files every executor can read, so a lost
    executor costs only a re-read.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
