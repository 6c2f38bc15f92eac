"""Sessions whose Python workers can import this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


#: What a batch that goes to a Python worker holds at most; a larger row is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def bounded(spark: SparkSession) -> SparkSession:
    """Bound the batches that go to Python workers by bytes, and have workers give freed memory back. Settings that are
    tighter already stay."""
    batch = "spark.sql.execution.arrow.max{}PerBatch"
    found = spark._jsparkSession.sessionState().conf()
    if int(found.getConfString(batch.format("Records"))) > BATCH_ROWS:
        spark.conf.set(batch.format("Records"), str(BATCH_ROWS))
    now = found.getConfString(batch.format("Bytes")).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(batch.format("Bytes"), str(BATCH_BYTES))
    env = spark.sparkContext.environment
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    env.setdefault("MALLOC_ARENA_MAX", "2")
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Put the repository on the Python workers' path, however the session was made, and bound what goes to them."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return bounded(spark)


def local_session(cpus: int = 8, name: str = "pelagia", memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)
