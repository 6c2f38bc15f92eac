"""A fresh folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def work_dir(spark: SparkSession, tag: str) -> str:
    """A new path in spark.checkpoint.dir; where that is unset, beside the warehouse's tables on a cluster, and in a
    temporary folder in local mode (tests), where driver and executors are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
        root = "file://" + tempfile.mkdtemp(prefix="pelagia-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_pelagia"
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
