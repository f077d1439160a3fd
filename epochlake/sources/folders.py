"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own under ``spark.checkpoint.dir``; a local one if Spark itself is local and that is unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        named = "file://" + tempfile.mkdtemp(prefix="folders-")
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"
