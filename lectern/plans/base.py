"""Helpers of the query modules: tables, and inputs derived by SQL that both engines run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Runs ``sql``, in which ``{name}`` stands for a table."""
    names = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def duck(sql: str) -> str:
    """The same SQL for an engine that knows the tables by name."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt evenly over the tasks of a shuffle: a file of one row group is read by one task, which would do all the work of its rows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
