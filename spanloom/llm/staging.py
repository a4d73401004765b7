"""Intermediate tables in the folder that driver and executors share.

A staged table cuts the lineage: if an executor is lost, later stages read the
written files again instead of recomputing. The folder is the one the cluster
names in ``spark.checkpoint.dir``; where that is unset, a local master (tests on a
single machine) gets a folder of this process, and a cluster an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI, without a trailing slash."""
    found = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_KEY} to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set(_KEY, found)
    return found.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/spanloom/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read from there; options are the Parquet writer's."""
    return stage_at(df, stage_path(df.sparkSession, name), options)


def stage_at(df: DataFrame, path: str, options: dict | None = None) -> DataFrame:
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more (it does so at a collection)."""
    spark.sparkContext._jvm.System.gc()


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a staged folder through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
