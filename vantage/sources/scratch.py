"""A folder for files that a query writes and reads again: below ``spark.checkpoint.dir``, or a temporary one in local mode."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="vantage-")
        spark.sparkContext.setCheckpointDir(at)
    return f"{at}/vantage-files/{uuid.uuid4().hex}"
