"""The folder that driver and executors share: spark.checkpoint.dir, or in a single local process one of our own."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="rillset-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_root(spark: SparkSession) -> str:
    """A new folder for an engine's state."""
    return f"{shared_folder(spark)}/engine-{uuid.uuid4().hex[:12]}"
