"""Folders for the files that queries write and read back: where driver and executors both reach them."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

_KEY = "spark.checkpoint.dir"


def folder(spark: SparkSession) -> str:
    """A new folder's local path, in the shared folder that the cluster names; on a single machine a temporary one."""
    found = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_KEY} to a folder that driver and executors share")
        return tempfile.mkdtemp(prefix="spanloom-")
    path = Path(found.removeprefix("file://").removeprefix("file:")) / f"files-{uuid.uuid4().hex}"
    path.mkdir(parents=True)
    return str(path)


def uri(path: str) -> str:
    return Path(path).as_uri()
