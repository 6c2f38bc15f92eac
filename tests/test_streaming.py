"""A folder of images that fills up."""

import numpy as np
from pyspark.sql import functions as F

from pelagia.sources import sinks
from pelagia.streaming import experiments
from tests.test_images import frame


def test_new_images_are_added_once(spark, tmp_path):
    rng = np.random.default_rng(0)
    df = frame(spark, *[rng.random((12, 12)) for _ in range(3)]).withColumn("name", F.concat(F.col("image_id").cast("string"), F.lit(".png")))
    at = [f"{tmp_path}/{x}" for x in ("in", "out", "check")]

    def more(rows):
        sinks.write_images(rows, at[0]).collect()
        experiments.run(spark, *at, methods=["median", "kuan"]).awaitTermination()
        return spark.read.parquet(at[1]).count()

    assert more(df.filter("image_id < 2")) == 20
    assert more(df.filter("image_id = 2")) == 30
    assert more(df.limit(0)) == 30
