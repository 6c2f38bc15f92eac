"""Queries of the error channel: bad rows among good ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.operators import errors, stages
from pelagia.operators.images import pack
from pelagia.plans.standins import PX, SIDE, images
from pelagia.registry import query
from pelagia.sources.work import work_dir


def damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images on the channel: some lack a pixel, some are missing."""
    d, k = F.col("image.data"), F.col("image_id")
    data = F.when(k % 50 == 7, F.slice(d, 1, 63)).when(k % 50 != 9, d)
    return errors.channel(images(spark, sf_dir).select("image_id", pack(data, SIDE, SIDE).alias("image")))


_STATUS = "case when image_id % 50 = 7 then 'contrast: 63 values for 8 x 8 pixels' when image_id % 50 = 9 then 'contrast: no image' end"


@query("error_quarantine", f"with e as (select vec_id as image_id from embeddings) select {_STATUS} as error, count(*) as images from e group by 1")
def error_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contrast and sharpening of damaged images: how many went through, and the reasons of the others."""
    good, bad, _ = errors.settle(stages.sharpen(stages.contrast(damaged(spark, sf_dir))), work_dir(spark, "settled"))
    both = good.select(F.lit(None).cast("string").alias("error")).unionByName(bad.select("error"))
    return both.groupBy("error").agg(F.count("*").alias("images"))


@query("error_isolation", f"""with {PX}, r as (select image_id, quantile_cont(v, 0.02) as lo, quantile_cont(v, 0.98) as hi from px group by 1)
select image_id, pos, round((least(greatest(v, lo), hi) - lo) / (hi - lo), 6) as v from px join r using (image_id) where image_id % 50 not in (7, 9)""")
def error_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels of the images beside the bad ones."""
    good, _, _ = errors.settle(stages.contrast(damaged(spark, sf_dir)), work_dir(spark, "settled"))
    return good.select("image_id", F.posexplode("image.data").alias("pos", "v")).select("image_id", "pos", F.round("v", 6).alias("v"))
