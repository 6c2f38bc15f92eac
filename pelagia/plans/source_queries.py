"""Queries of the image sinks and sources: images go to files and come back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.plans.standins import PX, images
from pelagia.registry import query
from pelagia.sources import image_source
from pelagia.sources.sinks import write_images
from pelagia.sources.work import work_dir


def _written(spark: SparkSession, sf_dir: str) -> str:
    """A folder of folders of PNG files, one for each image."""
    folder = work_dir(spark, "images")
    name = F.concat((F.col("image_id") % 7).cast("string"), F.lit("/"), F.col("image_id").cast("string"), F.lit(".png"))
    write_images(images(spark, sf_dir).withColumn("name", name), folder).write.format("noop").mode("overwrite").save()
    image_source.register(spark)
    return folder


@query("image_source_read", f"with {PX}, q as (select image_id, round_even(v * 255, 0) as v from px) select image_id, (image_id % 7)::varchar as folder, 8 as height, 8 as width, sum(v) as total, max(v) as most from q group by image_id")
def image_source_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image, written as PNG and read by the data source."""
    df = spark.read.format(image_source.NAME).load(_written(spark, sf_dir))
    total = F.aggregate("image.data", F.lit(0.0), lambda a, v: a + v)
    return df.select(F.split("name", r"\.")[0].cast("long").alias("image_id"), "folder", "image.height", "image.width", total.alias("total"), F.array_max("image.data").alias("most"))


@query("image_source_pushdown", "select (vec_id % 7)::varchar as folder, count(*) as files from embeddings where vec_id % 7 in (2, 5) group by 1")
def image_source_pushdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two folders: the others are left out at planning, and none is opened."""
    df = spark.read.format(image_source.NAME).option("images", "false").load(_written(spark, sf_dir))
    return df.filter(F.col("folder").isin("2", "5")).groupBy("folder").agg(F.count("*").alias("files"))
