"""The folder that all executors share: spark.checkpoint.dir, or a local one where that is unset and so is the master."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = getattr(shared_folder, "own", None) or tempfile.mkdtemp(prefix="tessaline-")
        shared_folder.own = folder
    return folder.rstrip("/")


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in it."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
