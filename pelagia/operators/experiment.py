"""The image x noise x filter experiment: cross product, resume, run and summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.operators import errors, images, noise, store
from pelagia.operators.catalog import grouped_statistics
from pelagia.sources.sinks import write_images

KEYS = ["image_id", "noise_type", "denoising_method"]
#: One filter and seven metrics a second, and an average image's size, as the reference estimates them.
RATE, IMAGE_KB = 5.25, 200


def estimate(n_images: int, n_noise: int = 5, n_methods: int = 8, n_metrics: int = 7) -> dict[str, float]:
    experiments = n_images * n_noise * n_methods
    noisy, files = n_images * n_noise, n_images * n_noise + experiments
    evaluations = experiments * n_metrics
    return {"experiments": experiments, "noise_operations": noisy, "denoise_operations": experiments, "metric_evaluations": evaluations, "total_operations": noisy + experiments + evaluations, "files": files, "disk_mb": files * IMAGE_KB / 1024, "seconds": experiments / RATE}


def keys(df: DataFrame, noise_types: list[str] | None = None, methods: list[str] | None = None) -> DataFrame:
    """image_id x noise x method; the two lists are literals, so nothing is joined."""
    n = F.explode(F.array(*[F.lit(x) for x in noise_types or list(noise.MODELS)])).alias("noise_type")
    m = F.explode(F.array(*[F.lit(x) for x in methods or list(images.FILTERS)])).alias("denoising_method")
    return df.select("image_id", n).select("image_id", "noise_type", m)


def remaining(wanted: DataFrame, done: DataFrame, files: DataFrame | None = None, path: str = "denoised_image") -> DataFrame:
    """Keys that are not done; one counts as done only if its file is in the inventory. Keyed by image, not by patient."""
    if files is not None:
        done = done.join(files.select(F.col("path").alias(path)).distinct(), path, "left_semi")
    return wanted.join(done.select(*KEYS).distinct(), KEYS, "left_anti")


def run(df: DataFrame, seed: int = 42, todo: DataFrame | None = None, methods: list[str] | None = None, noise_types: list[str] | None = None, noisy_path: str | None = None, keep_image: bool = False, mask: str | None = None, radius: int = 15, isolate: bool = False) -> DataFrame:
    """df (image_id, image in [0, 1], other columns): a row with the seven metrics for each key (each in todo, if given).

    An image makes its 40 results in one task. Nothing is shuffled unless todo is joined or the table has fewer
    than images.SPREAD partitions for each core. noisy_path: a store of noisy images that is used, and filled with those it lacks;
    keep_image adds the filtered image as ``denoised``. mask: a column of packed lesion masks; CNR and CII of all 40 results
    of an image are then those of the same pixels, which the mask and the clean image fix (images.metric_values)."""
    df = images.spread(df)
    if noisy_path is not None:
        some = df if todo is None else df.join(todo.select("image_id").distinct(), "image_id", "left_semi")
        models = {k: noise.MODELS[k] for k in noise_types or noise.MODELS}
        noisy = df.join(store.noisy_images(some.select("image_id", "image"), noisy_path, seed, models).drop("image"), "image_id")
    else:
        noisy = df.withColumn("n", F.explode(noise.all_models(F.col("image"), F.col("image_id"), seed, noise_types)))
        noisy = noisy.select(*df.columns, F.col("n.noise_type").alias("noise_type"), F.col("n.image").alias("noisy"))
    if todo is not None:
        by = todo.groupBy("image_id", "noise_type").agg(F.collect_set("denoising_method").alias("wanted"))
        noisy = noisy.join(by, ["image_id", "noise_type"])
    lesion = F.col(mask) if mask else None
    made = images.apply_filters(F.col("noisy"), methods) if keep_image else images.filter_metrics(F.col("image"), F.col("noisy"), methods, lesion, radius)
    done = noisy.withColumn("f", F.explode(made)).withColumn("denoising_method", F.col("f.method"))
    if todo is not None:
        done = done.filter(F.array_contains("wanted", F.col("denoising_method")))
    rest = [c for c in df.columns if c not in ("image", "image_id", mask)]
    if not keep_image:
        of = [F.col(f"f.{m}").alias(m) for m in images.METRICS]
        if isolate:
            return done.select(*rest, *KEYS, *of, F.col("f.error").alias("error"))
        reason = F.concat(F.col("denoising_method"), F.lit(" on "), F.col("image_id").cast("string"), F.lit(": "), F.col("f.error"))
        first = F.when(F.col("f.error").isNotNull(), F.raise_error(reason).cast("double")).otherwise(F.col(f"f.{images.METRICS[0]}"))
        return done.select(*rest, *KEYS, first.alias(images.METRICS[0]), *of[1:])
    if isolate:
        raise ValueError("errors are isolated where no image is kept")
    out = done.select(*rest, *KEYS, F.col("f.image").alias("denoised"), images.metrics(F.col("image"), F.col("f.image"), mask=lesion, radius=radius).alias("m"))
    return out.select(*rest, *KEYS, "denoised", *[f"m.{m}" for m in images.METRICS])


def summary(metrics: DataFrame) -> DataFrame:
    """Two keys and 35 statistics."""
    return grouped_statistics(metrics, ["noise_type", "denoising_method"], images.METRICS)


def isolated(df: DataFrame, path: str, **how) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """run() with errors set aside: the good results, the quarantine and how many of each there are, from one table written
    at path (errors.settle)."""
    return errors.settle(run(df, isolate=True, **how), path, None)


BY = ["noise_type", "denoising_method", "batch"]


def checkpointed(df: DataFrame, path: str, confirm: bool, seed: int = 42, mode: str = "full", head: int = 10, batches: int = 64, methods: list[str] | None = None, noise_types: list[str] | None = None, noisy_path: str | None = None, folder: str | None = None) -> DataFrame | None:
    """Run what the table at path does not have yet; a full run needs confirmation; mode estimate only counts.

    The table is partitioned by noise, filter and a batch of images. Every batch with something to do is replaced as a
    whole (store.replace), by its rows that still count and the new ones. folder: filtered images are written there, their
    paths are kept as ``denoised_image``, and a row counts as done only while its file is there."""
    spark = df.sparkSession
    if mode == "estimate":
        return spark.createDataFrame([tuple(float(v) for v in estimate(df.count()).values())], ", ".join(f"{k} double" for k in estimate(0)))
    if mode == "full" and not confirm:
        return None
    if mode == "test":
        df = df.orderBy("image_id").limit(head)
    old = spark.read.parquet(path) if store.exists(spark, path) else None
    todo = keys(df, noise_types, methods).withColumn("batch", store.batch_of(batches=batches))
    if old is not None:
        files = None
        if folder is not None:
            found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(folder)
            files = found.select(F.element_at(F.split("path", "/"), -1).alias("path"))
        have = old if files is None else old.withColumn("file", F.element_at(F.split("denoised_image", "/"), -1))
        todo = remaining(todo, have, files, "file")
    new = run(df, seed, todo if old is not None else None, methods, noise_types, noisy_path, folder is not None)
    new = new.withColumn("batch", store.batch_of(batches=batches))
    if folder is not None:
        name = F.concat_ws("_", "denoising_method", "noise_type", F.col("image_id").cast("string"))
        new = write_images(new.withColumn("name", F.concat(name, F.lit(".png"))), folder, image="denoised", keep=[c for c in new.columns if c != "denoised"])
        new = new.withColumnRenamed("path", "denoised_image").drop("name")
    store.replace(store.replaced(old, new, todo, KEYS, BY), path, BY)
    return spark.read.parquet(path)
