"""Queries of the image stages, the sources behind them and what a validation adds up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.functions import augment, points
from pelagia.operators import evaluation, stages
from pelagia.operators import images as im
from pelagia.plans.pixel_queries import Q
from pelagia.plans.standins import PX, images, near, pixels, table
from pelagia.registry import query
from pelagia.sources import files
from pelagia.sources.sinks import write_csv, write_images
from pelagia.sources.work import work_dir

_STRETCHED = "r as (select image_id, quantile_cont(v, 0.02) as lo, quantile_cont(v, 0.98) as hi from px group by 1), st as (select px.image_id, pos, y, x, (least(greatest(v, lo), hi) - lo) / (hi - lo) as v from px join r using (image_id))"


@query("contrast_then_sharpen", f"""with {PX}, {_STRETCHED}, {near('n', 'st', 5, 'reflect')}
select image_id, pos, round(least(greatest(any_value(c) + (any_value(c) - sum(v * exp(-(dy * dy + dx * dx) / 2.0)) / sum(exp(-(dy * dy + dx * dx) / 2.0))), 0), 1), 6) as v from n group by 1, 2""")
def contrast_then_sharpen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contrast and the sharpening stage, one after the other."""
    df = stages.sharpen(stages.contrast(images(spark, sf_dir).select("image_id", "image")))
    return pixels(df, df["image"])


@query("basic_stage", f"""with {PX}, q as (select image_id, y, x, {Q} as v from px where image_id % 9 <> 4), r as (select image_id, min(v) as lo, max(v) as hi from q group by 1),
s as (select q.image_id, ((y // 2) * 4 + x // 2)::int as pos, avg((v - lo) / (hi - lo)) as v from q join r using (image_id) group by 1, 2)
select 'in/' || image_id || '.png' as original_image_path, 'P' || (image_id % 7) || '_mass_LEFT_UNKNOWN_' || image_id || '.png' as name, (image_id % 2)::int as label, 4 as width, pos, round(v, 6) as v from s""")
def basic_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of decoded 8-bit images, normalised and resized to 4 x 4; some files cannot be decoded, some paths come twice."""
    df = images(spark, sf_dir)
    k = F.col("image_id")
    path = F.concat(F.lit("in/"), k.cast("string"), F.lit(".png"))
    decoded = df.select(path.alias("path"), F.when(k % 9 != 4, points.quantize(F.col("image"))).alias("image"))
    master = df.select(k, path.alias("image_path"), F.concat(F.lit("P"), (k % 7).cast("string")).alias("patient_id"), F.lit("mass").alias("abnormality_category"), F.lit("LEFT").alias("left_or_right_breast"), F.lit(" ").alias("image_view"), F.lit("BENIGN").alias("pathology"), (k % 2).alias("label"))
    twice = master.unionByName(master.withColumns({"image_id": k + 10**9, "patient_id": F.lit("later")}))
    out = stages.basic(twice, decoded, ["image_id"], size=(4, 4))
    return im.long(out, keys=("original_image_path", "name", "label", "width")).withColumn("v", F.round("v", 6))


@query("noise_stage", """select vec_id::varchar as name, unnest(['gaussian', 'salt_pepper', 'speckle', 'poisson', 'mixed_poisson_gaussian']) as noise_type,
unnest(['{"mean":0.0,"var":0.01,"seed":42}', '{"amount":0.04,"salt_vs_pepper":0.5,"seed":42}', '{"var":0.04,"seed":42}', '{"scale":255.0,"seed":42}', '{"poisson_scale":255.0,"gaussian_var":0.005,"seed":42}']) as noise_parameters, true as is_synthetic, 64 as pixels from embeddings""")
def noise_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The noise stage's table: five rows an image, with parameters."""
    out = stages.add_noise(images(spark, sf_dir).select(F.col("image_id").cast("string").alias("name"), "image"))
    return out.select("name", "noise_type", "noise_parameters", "is_synthetic", F.size("image.data").alias("pixels"))


@query("denoise_stage_status", f"select m as denoising_method, case when m in ('gaussian', 'kuan') then 'GPU' else 'CPU' end as hardware_architecture, 'SUCCESS' as status, count(*) as n from embeddings, (select unnest([{', '.join(repr(m) for m in im.FILTERS)}]) as m) group by all")
def denoise_stage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many images each of the denoising stage's eight filters went through, and how it ended."""
    df = images(spark, sf_dir, even=True).select("image_id", F.col("image").alias("clean"), F.col("noisy").alias("image"))
    return stages.denoise(df).groupBy("denoising_method", "hardware_architecture", "status").agg(F.count("*").alias("n"))


@query("sample_checks", f"with {PX}, a as (select image_id, min(v) as lo, max(v) as hi from ns group by 1) select image_id, case when image_id % 10 = 3 or lo >= hi then 'FAILED' else 'PASSED' end as status, round(hi, 6) as original_max from a")
def sample_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Original and processed images beside each other: those without a range fail."""
    df = images(spark, sf_dir)
    flat = im.pack(F.transform("noisy.data", lambda _: F.lit(0.5)), 8, 8)
    done = df.select("image_id", F.when(F.col("image_id") % 10 == 3, flat).otherwise(F.col("noisy")).alias("image"))
    out = stages.sample_check(df.select("image_id", F.col("noisy").alias("image")), done, "image_id")
    return out.select("image_id", "status", F.round("original.max", 6).alias("original_max"))


@query("image_channels", f"with {PX} select image_id, c::int as channel, count(*) as n, round(avg(v), 6) as mean from px, range(3) r(c) group by all")
def image_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images as three equal channels: what networks for colour images are fed."""
    out = im.long(images(spark, sf_dir).select("image_id", augment.repeated(F.col("image"), 3).alias("i")), "i")
    return out.groupBy("image_id", F.floor(F.col("pos") / 64).cast("int").alias("channel")).agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"))


_P = "1 / (1 + exp(-4 * embedding[1]::double))"


@query("validation_losses", f"""with p as (select {_P} as p, vec_id % 3 = 0 as t from embeddings), c as (select p, t, -ln(greatest(case when t then p else 1 - p end, 1e-12)) as ce, (p >= 0.5) = t as ok from p)
select 'ce' as loss_name, round(avg(ce), 6) as loss, round(avg(ok::int), 6) as accuracy from c union all select 'focal', round(avg(0.25 * power(1 - exp(-ce), 2) * ce), 6), round(avg(ok::int), 6) from c
union all select 'weighted_ce', round(sum(ce * case when t then 3.0::double else 1 end) / sum(case when t then 3.0::double else 1 end), 6), round(avg(ok::int), 6) from c""")
def validation_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean loss and accuracy of one set of probabilities, by each loss."""
    e = table(spark, sf_dir, "embeddings")
    rows = e.select((1 / (1 + F.exp(-4 * F.element_at("embedding", 1).cast("double")))).alias("p"), F.when(F.col("vec_id") % 3 == 0, 1).otherwise(0).alias("t"))
    out = None
    for name in ("ce", "focal", "weighted_ce"):
        one = evaluation.validate(rows, "t", "p", name, {1: 3.0}).select(F.lit(name).alias("loss_name"), F.round("loss", 6).alias("loss"), F.round("accuracy", 6).alias("accuracy"))
        out = one if out is None else out.unionByName(one)
    return out


@query("csv_round_trip", """select page_id, url, length(html) as html_chars, md5(html) as digest from pages""")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their quotes and line ends, written as CSV and read again."""
    path = work_dir(spark, "csv")
    write_csv(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    back = files.read_csv(spark, path, "page_id long, url string, html string")
    return back.select("page_id", "url", F.length("html").cast("long").alias("html_chars"), F.md5("html").alias("digest"))


@query("folder_inventory", "select (vec_id % 5)::varchar as folder, count(*) as n, min(vec_id || '.png') as first, max(vec_id || '.png') as last from embeddings group by 1")
def folder_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image files by folder, contents unread."""
    folder = work_dir(spark, "images")
    name = F.concat((F.col("image_id") % 5).cast("string"), F.lit("/"), F.col("image_id").cast("string"), F.lit(".png"))
    write_images(images(spark, sf_dir).withColumn("name", name), folder).write.format("noop").mode("overwrite").save()
    return files.inventory(spark, folder).groupBy("folder").agg(F.count("*").alias("n"), F.min("name").alias("first"), F.max("name").alias("last"))
