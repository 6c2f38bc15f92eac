"""The image stages as DataFrame steps. Each adds or replaces an ``image`` column; write_stage puts images in files and
paths in the table.

A table with a column ``error`` (errors.channel) is on the error channel: a row whose image is missing, damaged or too much
for a kernel keeps its first reason, and errors.settle sets it aside and counts it by an Observation. Off the channel, rows
without an image are dropped by ``basic``, and a kernel that raises fails the task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.functions import pixels
from pelagia.operators import errors, noise
from pelagia.operators import images as im
from pelagia.operators.catalog import hardware, int_or, keep_first, output_name, text_or

ATTRIBUTES = ["patient_id", "abnormality_category", "breast_side", "image_view", "pathology"]


def attributes(df: DataFrame) -> DataFrame:
    """Text attributes without blanks (UNKNOWN for them), label 0 for null, split train for null; absent columns count as null."""
    if "breast_side" not in df.columns and "left_or_right_breast" in df.columns:
        df = df.withColumnRenamed("left_or_right_breast", "breast_side")
    there = lambda c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
    new = {c: text_or(there(c), "unknown" if c == "abnormality_category" else "UNKNOWN") for c in ATTRIBUTES}
    return df.withColumns(new | {"label": int_or(there("label")), "dataset_split": text_or(there("dataset_split"), "train")})


def basic(master: DataFrame, decoded: DataFrame, order: list[str], path: str = "image_path", size: tuple[int, int] = (512, 512), head: int | None = None, channel: bool = False) -> DataFrame:
    """Normalised, resized images of the distinct source files, the first record of each. decoded: path, image (8-bit values).
    channel puts the result on the error channel; files that decoded lacks are there, too, with the reason "no image".

    head is the stage's test mode."""
    rows = keep_first(master.filter(F.col(path).isNotNull()), [path], order)
    if head is not None:
        rows = rows.orderBy(*order).limit(head)
    rows = attributes(rows).join(decoded.select(F.col("path").alias("_path"), "image"), F.col(path) == F.col("_path"), "left" if channel else "inner").drop("_path")
    scaled = lambda x: pixels.resize(pixels.normalize_image(x), *size)
    if channel:
        rows = errors.step(errors.channel(rows), "basic", scaled)
    else:
        rows = rows.filter("image.data is not null").withColumn("image", im.apply(F.col("image"), scaled))
    name = output_name(*[F.col(c) for c in ATTRIBUTES[:4]], path=F.col(path))
    return rows.select(*ATTRIBUTES, "label", "dataset_split", F.col(path).alias("original_image_path"), name.alias("name"), F.lit(size[0]).alias("width"), F.lit(size[1]).alias("height"), "image", *[c for c in ("error",) if channel])


def _step(df: DataFrame, stage: str, name: str, **params) -> DataFrame:
    if errors.on_channel(df):
        return errors.step(df, stage, name, **params)
    return df.withColumn("image", im.apply_named(F.col("image"), name, **params))


def contrast(df: DataFrame, lower: float = 2.0, upper: float = 98.0) -> DataFrame:
    return _step(df, "contrast", "stretch_contrast", lower=lower, upper=upper)


def sharpen(df: DataFrame, amount: float = 1.0, sigma: float = 1.0, kernel_size: tuple[int, int] = (5, 5)) -> DataFrame:
    return _step(df, "sharpen", "unsharp_mask", amount=amount, sigma=sigma, kernel_size=kernel_size)


def add_noise(df: DataFrame, key: str = "name", seed: int = 42) -> DataFrame:
    """Five rows for each: noise_type, noise_parameters (JSON), clean (the image it was made from), image."""
    many = F.explode(noise.all_models(F.col("image"), F.col(key), seed)).alias("n")
    params = F.create_map(*[x for k, p in noise.MODELS.items() for x in (F.lit(k), F.to_json(F.struct(*[F.lit(v).alias(a) for a, v in p.items()], F.lit(seed).alias("seed"))))])
    rest = [c for c in df.columns if c != "image"]
    out = df.select(*rest, F.col("image").alias("clean"), many)
    return out.select(*rest, F.col("n.noise_type").alias("noise_type"), params[F.col("n.noise_type")].alias("noise_parameters"), F.lit(True).alias("is_synthetic"), "clean", F.col("n.image").alias("image"))


def denoise(df: DataFrame, methods: list[str] | None = None) -> DataFrame:
    """A row for each filter: denoising_method, hardware_architecture, status (FAILED on the error channel), image."""
    on = errors.on_channel(df)
    rest = [c for c in df.columns if c not in ("image", "error")]
    made = errors.attempt_filters(F.when(F.col("error").isNull(), F.col("image")), methods) if on else im.apply_filters(F.col("image"), methods)
    out = df.select(*rest, *[c for c in ("error",) if on], F.explode(made).alias("f"))
    m = F.col("f.method")
    same = (F.col("f.image.height") == F.col("clean.height")) & (F.col("f.image.width") == F.col("clean.width"))
    status = F.when(same, "SUCCESS").otherwise("SHAPE_MISMATCH")
    if on:
        status = F.when(F.col("f.error").isNotNull(), "FAILED").otherwise(status)
        rest = [*rest, F.coalesce("error", F.concat(m, F.lit(": "), F.col("f.error"))).alias("error")]
    return out.select(*rest, m.alias("denoising_method"), hardware(m).alias("hardware_architecture"), status.alias("status"), F.col("f.image").alias("image"))


def full_pipeline(df: DataFrame, size: tuple[int, int] = (512, 512)) -> DataFrame:
    """df (image of 8-bit values, standardized_pathology, ...): validated, then robustly normalised, segmented, without the
    corner muscle, cropped, resized, equalised by CLAHE and sharpened; bucket is the class folder of the final image."""

    def enhance(x):
        q = pixels.truncate(pixels.robust_min_max_normalize(x))
        out = []
        for mask, image in zip(pixels.segment_breast(q), q, strict=True):
            t, b, left, right = pixels.bounding_box(mask > 0)
            cut = pixels.suppress_corner((image * mask)[None])[:, t:b, left:right] / 255
            out.append(pixels.unsharp_mask(pixels.clahe(pixels.resize(cut, *size)))[0])
        return out

    valid = df.filter(im.validity(F.col("image"))["is_valid"])
    bucket = F.when(F.col("standardized_pathology") == "BENIGN", "benign").when(F.col("standardized_pathology") == "MALIGNANT", "malignant")
    return valid.withColumn("image", im.apply(F.col("image"), enhance)).withColumn("bucket", bucket)


def write_stage(df: DataFrame, folder: str, column: str, name: Column | None = None) -> DataFrame:
    """Write the images and put their paths in ``column``; the image column goes."""
    from pelagia.sources.sinks import write_images

    named = df.withColumn("name", name) if name is not None else df
    written = write_images(named, folder)
    return named.drop("image").join(written.withColumnRenamed("path", column), "name")


def sample_check(original: DataFrame, processed: DataFrame, key: str = "name") -> DataFrame:
    """Statistics of both images and PASSED where the processed one has a range."""
    a = original.select(key, im.statistics(F.col("image")).alias("original"))
    b = processed.select(key, im.statistics(F.col("image")).alias("processed"))
    return a.join(b, key).withColumn("status", F.when(F.col("processed.max") > F.col("processed.min"), "PASSED").otherwise("FAILED"))


def noise_table(noisy: DataFrame, key: str = "name") -> DataFrame:
    """One row per image: a map of noise to whether it is realistic, and whether all are."""
    r = noise.realism(F.col("clean"), F.col("image"), F.col("noise_type"))["passed"]
    return noisy.select(key, "noise_type", r.alias("ok")).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("noise_type", "ok")))).alias("models"), F.bool_and("ok").alias("passed"))
