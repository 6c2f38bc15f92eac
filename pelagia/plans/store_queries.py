"""Queries of what is computed once and kept: the noisy-image store and the replaceable checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.operators import experiment, noise, store
from pelagia.plans.pixel_queries import CLIP, NORMAL, Q
from pelagia.plans.standins import PX, images, near
from pelagia.registry import query
from pelagia.sources.work import work_dir


@query("noisy_store", f"""with {PX}, n as (select image_id, pos, 'salt_pepper' as noise_type, v from ns
union all select image_id, pos, 'gaussian', {CLIP.format(f"v + 0.1::double * {NORMAL}")} from us union all select image_id, pos, 'speckle', {CLIP.format(f"v + v * 0.2::double * {NORMAL}")} from us)
select image_id, noise_type, case when image_id % 2 = 0 then 1 else 2 end as computed_in, count(*) as pixels, round(avg(v), 6) as mean from n group by all""")
def noisy_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the images fill a store, then all do: what each noisy image is, and in which run it was computed."""
    df, path = images(spark, sf_dir).select("image_id", "image"), work_dir(spark, "noisy")
    models = {k: noise.MODELS[k] for k in ("gaussian", "salt_pepper", "speckle")}
    store.fill(df.filter("image_id % 2 = 0"), path, models=models)
    first = [f.path for f in spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select("path").collect()]  # a few files a task
    early = spark.read.option("basePath", path).parquet(*first).select("image_id", "noise_type").distinct().withColumn("early", F.lit(1))
    store.fill(df, path, models=models)
    out = store.stored(spark, path).join(early, ["image_id", "noise_type"], "left")
    total = F.aggregate("noisy.data", F.lit(0.0), lambda a, v: a + v)
    return out.select("image_id", "noise_type", F.coalesce("early", F.lit(2)).alias("computed_in"), F.size("noisy.data").cast("long").alias("pixels"), F.round(total / F.size("noisy.data"), 6).alias("mean"))


@query("checkpoint_replace", f"""with {PX}, q as (select image_id, pos, y, x, {Q} as v from ns), {near('n', 'q', 5, 'edge')}, d as (select image_id, pos, median(v) / 255 as v from n group by 1, 2)
select image_id, 'salt_pepper' as noise_type, 'median' as denoising_method, count(*) // 64 as copies, round(avg((px.v - d.v) * (px.v - d.v)), 6) as mse from px join d using (image_id, pos) group by 1""")
def checkpoint_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the images, then all, then all again into one checkpoint: every key is there once."""
    df, path = images(spark, sf_dir).select("image_id", "image"), work_dir(spark, "checkpoint")
    only = {"methods": ["median"], "noise_types": ["salt_pepper"], "batches": 16}
    experiment.checkpointed(df.filter("image_id % 3 = 0"), path, True, **only)
    experiment.checkpointed(df, path, True, **only)
    out = experiment.checkpointed(df, path, True, **only)
    return out.groupBy(*experiment.KEYS).agg(F.count("*").alias("copies"), F.round(F.max("MSE"), 6).alias("mse"))
