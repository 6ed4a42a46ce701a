"""Folders for what queries write on their way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the session's shared folder; in one of our own where the session names none and all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="logweir-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
