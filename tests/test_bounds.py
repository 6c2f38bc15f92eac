"""What reaches a Python worker at once is bounded, whatever the size of a partition."""

import pandas as pd
from pyspark.sql import functions as F

from pelagia.operators import images as im
from pelagia.session import BATCH_ROWS, ship


def test_batches_of_images_are_bounded(spark):
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "10000")
    try:
        ship(spark)
        size = F.pandas_udf(lambda x: pd.Series([len(x)] * len(x)), "long")
        assert spark.range(0, 9000, 1, 1).select(size("id").alias("n")).agg(F.max("n")).first()[0] <= BATCH_ROWS
    finally:
        spark.conf.set(batch, before)


def test_filters_of_many_images_are_those_of_each(spark):
    import numpy as np

    r = np.random.default_rng(1)
    x = r.random((im.PIXELS // 64 + 5, 8, 8))  # more than one stack
    df = spark.createDataFrame([(i, (8, 8, a.ravel().tolist())) for i, a in enumerate(x)], f"image_id long, image {im.IMAGE}").coalesce(1)
    got = df.select("image_id", F.explode(im.apply_filters(F.col("image"), ["median", "kuan"])).alias("f")).collect()
    assert len(got) == 2 * len(x)
    for row in got:
        kernel, params = im.FILTERS[row.f.method]
        assert np.allclose(row.f.image.data, kernel(x[row.image_id][None], **params)[0].ravel(), atol=1e-12)


def test_rows_of_one_block_are_numbered_in_many_tasks(spark, tmp_path, monkeypatch):
    from pelagia.sources import files

    monkeypatch.setattr(files, "RUN", 5, raising=False)
    spark.range(0, 3000, 1, 1).select((F.col("id") * 7 % 3000).alias("k")).write.parquet(f"{tmp_path}/t")
    rows = files.numbered(files.placed(spark.read.parquet(f"{tmp_path}/t")).filter("k % 3 > 0"))
    got = rows.select("ordinal", "k").orderBy("ordinal").collect()
    want = [k for k in (i * 7 % 3000 for i in range(3000)) if k % 3 > 0]
    assert [x.k for x in got] == want
    assert [x.ordinal for x in got] == list(range(len(want)))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a large table
    try:
        many = files.numbered(files.placed(spark.read.parquet(f"{tmp_path}/t"))).groupBy(F.spark_partition_id()).agg(F.max("ordinal")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(many) > 1
