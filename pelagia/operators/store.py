"""Results kept in tables and made only on a miss.

The noisy-image store is keyed by image, noise model, a hash of the model's parameters and seed, and a hash of the clean
image: a changed parameter or a changed image misses, nothing else does. Misses are found by an anti-join on the keys (no
stored pixel is read for it) and appended; an append is whole or absent, and what a lost one has left is found again.
One writer at a time.

The checkpoint of results is cut into batches by a hash of the image. A batch is replaced as a whole, never added to, so
a batch that was lost half-way and runs again, or whose files have vanished, leaves no row twice.

Defined cases: an empty table of images makes an empty store; images without an id share the null key, which is computed
again each time; repeated rows of one image are stored once; a null image has null noisy ones."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.observation import Observation

from pelagia.operators import noise

KEYS = ["image_id", "clean", "noise_type", "parameters"]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a committed table is at the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)) and bool(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select("path").head(1))


def parameters(model: str, values: dict, seed: int) -> str:
    """Sixteen hex digits of the model, its parameters (in any order) and the seed."""
    return hashlib.sha256(json.dumps([model, sorted(values.items()), seed]).encode()).hexdigest()[:16]


def wanted(images: DataFrame, seed: int = 42, models: dict[str, dict] | None = None) -> DataFrame:
    """KEYS and image of every image and model."""
    models = models or noise.MODELS
    each = F.array(*[F.struct(F.lit(m).alias("noise_type"), F.lit(parameters(m, v, seed)).alias("parameters")) for m, v in models.items()])
    one = images.select("image_id", F.xxhash64("image").alias("clean"), "image").dropDuplicates(["image_id", "clean"])
    return one.select("image_id", "clean", F.explode(each).alias("m"), "image").select("image_id", "clean", "m.noise_type", "m.parameters", "image")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """KEYS and noisy of the store, with the partition columns as text."""
    found = spark.read.option("basePath", path).parquet(path)
    return found.select("image_id", "clean", *[F.col(c).cast("string").alias(c) for c in ("noise_type", "parameters")], "noisy")


def made(rows: DataFrame, seed: int = 42, models: dict[str, dict] | None = None) -> Column:
    """The noisy image of a row's model. Kernels outside Spark get a null, and so no work, for rows of other models."""
    image, key, kind = rows["image"], rows["image_id"], rows["noise_type"]
    branches = [(kind == m, noise.ADD[m](F.when(kind == m, image), key, **v, seed=seed)) for m, v in (models or noise.MODELS).items()]
    return reduce(lambda c, b: c.when(*b), branches[1:], F.when(*branches[0]))


def fill(images: DataFrame, path: str, seed: int = 42, models: dict[str, dict] | None = None) -> int:
    """Compute and append what the store does not have for images (image_id, image); how many noisy images that were."""
    spark, seen = images.sparkSession, Observation()
    rows = wanted(images, seed, models)
    if exists(spark, path):
        rows = rows.join(stored(spark, path).select(*KEYS), KEYS, "left_anti")
    new = rows.select(*KEYS, made(rows, seed, models).alias("noisy")).observe(seen, F.count("*").alias("computed"))
    new.write.mode("append").partitionBy("noise_type", "parameters").parquet(path)
    return seen.get["computed"]


def noisy_images(images: DataFrame, path: str, seed: int = 42, models: dict[str, dict] | None = None) -> DataFrame:
    """image_id, image, noise_type, noisy of every image and model, from the store, after filling it."""
    fill(images, path, seed, models)
    rows, kept = wanted(images, seed, models), stored(images.sparkSession, path).dropDuplicates(KEYS)
    return rows.join(kept, KEYS).select("image_id", "image", "noise_type", "noisy")


def batch_of(key: str = "image_id", batches: int = 64) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(batches)).cast("int")


def replace(rows: DataFrame, path: str, by: list[str]) -> None:
    """Write rows in place of the partitions (by) that they belong to; other partitions stay. Rows may come from the table itself."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def replaced(old: DataFrame | None, new: DataFrame, todo: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """What the partitions (by) of todo hold from now on: old rows there that are not in todo (keys), and the new ones."""
    if old is None:
        return new
    there = old.join(todo.select(*by).distinct(), by, "left_semi")
    return there.join(todo.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)
