"""What is computed once: the noisy-image store and the checkpoint whose batches are replaced."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagia.operators import experiment, noise, store
from pelagia.operators.images import pack


def frame(spark, n, side=8, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(v) for v in rng.random(side * side)]) for i in range(n)]
    return spark.createDataFrame(rows, "image_id long, d array<double>").select("image_id", pack(F.col("d"), side, side).alias("image"))


def test_second_run_computes_nothing_and_a_changed_parameter_everything(spark, tmp_path):
    df, path = frame(spark, 6), f"{tmp_path}/noisy"
    assert store.fill(df.filter("image_id < 4"), path) == 20
    assert store.fill(df, path) == 10
    assert store.fill(df, path) == 0
    assert store.stored(spark, path).count() == 30
    other = noise.MODELS | {"gaussian": {"mean": 0.0, "var": 0.02}}
    assert store.fill(df, path, models=other) == 6  # of that model only
    assert store.fill(df, path, seed=43) == 30
    brighter = df.withColumn("image", F.when(F.col("image_id") == 1, pack(F.transform("image.data", lambda v: v / 2), 8, 8)).otherwise(F.col("image")))
    assert store.fill(brighter, path) == 5  # the changed image's


def test_stored_images_are_the_models(spark, tmp_path):
    df = frame(spark, 3)
    got = {(r.image_id, r.noise_type): r.noisy.data for r in store.noisy_images(df, f"{tmp_path}/noisy").collect()}
    want = df.select("image_id", F.explode(noise.all_models(F.col("image"), F.col("image_id"))).alias("n")).collect()
    assert len(got) == 15 and all(np.allclose(got[r.image_id, r.n.noise_type], r.n.image.data) for r in want)


def test_kernels_get_no_rows_of_other_models(spark, tmp_path, monkeypatch):
    """The Python kernel of Poisson noise sees null for all rows but its own."""
    seen = []
    monkeypatch.setitem(noise.ADD, "poisson", lambda image, key, **_: seen.append(str(image)) or image)
    store.fill(frame(spark, 2), f"{tmp_path}/noisy", models={k: noise.MODELS[k] for k in ("gaussian", "poisson")})
    assert len(seen) == 1 and "CASE WHEN" in seen[0] and "poisson" in seen[0]


def test_awkward_images(spark, tmp_path):
    df = frame(spark, 2)
    assert store.fill(df.filter("image_id < 0"), f"{tmp_path}/a") == 0
    assert store.fill(df.unionByName(df), f"{tmp_path}/b") == 10
    null = df.withColumn("image", F.when(F.col("image_id") == 0, F.col("image")))
    assert store.fill(null, f"{tmp_path}/c") == 10
    assert store.stored(spark, f"{tmp_path}/c").filter("noisy.data is null").count() == 5


def test_run_uses_the_store(spark, tmp_path):
    df, path = frame(spark, 2), f"{tmp_path}/noisy"
    one = {tuple(r[c] for c in experiment.KEYS): r.MSE for r in experiment.run(df, noisy_path=path, methods=["median", "kuan"]).collect()}
    two = {tuple(r[c] for c in experiment.KEYS): r.MSE for r in experiment.run(df, methods=["median", "kuan"]).collect()}
    assert one == pytest.approx(two) and len(one) == 20
    assert store.fill(df, path) == 0


ONLY = {"methods": ["median", "gaussian"], "noise_types": ["salt_pepper", "speckle"], "batches": 3}


def keys_of(df):
    return sorted(tuple(r) for r in df.select(*experiment.KEYS).collect())


def test_killed_and_repeated_batches_leave_no_row_twice(spark, tmp_path):
    df, path = frame(spark, 7), f"{tmp_path}/metrics"
    out = experiment.checkpointed(df.filter("image_id < 3"), path, True, **ONLY)
    assert out.count() == 12
    before = {f: os.path.getmtime(f"{d}/{f}") for d, _, fs in os.walk(path) for f in fs if f.startswith("part")}
    out = experiment.checkpointed(df, path, True, **ONLY)
    assert out.count() == 28 and keys_of(out) == sorted(set(keys_of(out)))
    # a lost run leaves part of its batches: here one batch loses a file
    victim = next(f"{d}/{f}" for d, _, fs in os.walk(path) for f in fs if f.startswith("part"))
    os.remove(victim)
    spark.catalog.refreshByPath(path)
    out = experiment.checkpointed(df, path, True, **ONLY)
    assert out.count() == 28 and keys_of(out) == sorted(set(keys_of(out)))
    untouched = {f for d, _, fs in os.walk(path) for f in fs if f.startswith("part")}
    out = experiment.checkpointed(df, path, True, **ONLY)
    assert out.count() == 28 and {f for d, _, fs in os.walk(path) for f in fs if f.startswith("part")} == untouched
    assert before


def test_a_vanished_file_is_made_again_and_its_row_replaced(spark, tmp_path):
    df, path, folder = frame(spark, 3), f"{tmp_path}/metrics", f"{tmp_path}/images"
    out = experiment.checkpointed(df, path, True, folder=folder, **ONLY)
    files = sorted(r.denoised_image for r in out.collect())
    assert len(files) == 12 and all(os.path.exists(f) for f in files)
    os.remove(files[5])
    out = experiment.checkpointed(df, path, True, folder=folder, **ONLY)
    assert out.count() == 12 and keys_of(out) == sorted(set(keys_of(out)))
    assert os.path.exists(files[5])


def test_replace_leaves_other_partitions(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.createDataFrame([(i, i % 3) for i in range(9)], "v int, p int")
    store.replace(rows, path, ["p"])
    store.replace(rows.filter("p = 1").withColumn("v", F.col("v") * 10), path, ["p"])
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [0, 2, 3, 5, 6, 8, 10, 40, 70]
