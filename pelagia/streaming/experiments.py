"""The experiment over a folder that fills up: the file source remembers which files it has seen, so a restart resumes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pelagia.operators import experiment, images
from pelagia.sources.files import decode

FILE = "path string, modificationTime timestamp, length long, content binary"


def image_stream(spark: SparkSession, folder: str, pattern: str = "*.png", per_batch: int = 100) -> DataFrame:
    """image_id (the path), image in [0, 1]; files that cannot be decoded are left out."""
    found = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch).load(folder)
    return found.select(F.col("path").alias("image_id"), images.apply_named(decode(F.col("content")), "normalize_minmax").alias("image")).filter("image.data is not null")


def run(spark: SparkSession, folder: str, out: str, checkpoint: str, seed: int = 42, methods: list[str] | None = None) -> StreamingQuery:
    """Append the metrics of every new image to out. A batch that is run again after a failure replaces its own folder."""

    def batch(df: DataFrame, number: int) -> None:
        experiment.run(df, seed, methods=methods).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return image_stream(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
