"""How often work is done: what belongs to an image or to a stack of images is done once for it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagia.functions import pixels as px
from pelagia.operators import images as im


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def images_of(spark, n=4):
    return spark.range(0, n, 1, 1).select(F.col("id").alias("image_id"), im.pack(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i / 63.0), 8, 8).alias("image"))


def test_regions_of_a_stack_are_found_at_once(monkeypatch):
    r = np.random.default_rng(5)
    x = r.random((30, 9, 8))
    y = np.clip(x + r.normal(0, 0.2, x.shape), 0, 1)
    x[3], y[4], y[5, :, :4], y[6] = 0, 0, 0, 0.5
    calls, found = [], px.otsu_regions
    monkeypatch.setattr(px, "otsu_regions", lambda *a: calls.append(1) or found(*a))
    known: dict = {}
    got = im.metric_values(x, y, ["CNR", "CII"], known=known)
    assert len(calls) == 2  # one for the clean images, one for the others
    im.metric_values(x, np.clip(y * 0.9, 0, 1), ["CNR", "CII"], known=known)
    assert len(calls) == 3  # the clean ones are known
    for i, (u, v) in enumerate(zip(x, y, strict=True)):
        (r1, b1), (r0, b0) = found(v), found(u)
        assert got["CNR"][i] == pytest.approx(px.cnr(v[r1], v[b1])) and got["CII"][i] == pytest.approx(px.cii(v[r1], v[b1], u[r0], u[b0]))


@pytest.mark.parametrize("shape", [(3, 8, 8), (2, 17, 5), (1, 1, 1)])
def test_order_filters_give_the_medians_of_their_windows(shape):
    x = np.random.default_rng(6).integers(0, 6, shape) / 5
    assert np.array_equal(px.denoise_median(x, 5), np.median(px.windows(px.quantize(x), 5, "edge"), -1) / 255)
    want, left = np.empty_like(x), np.ones(shape, bool)
    for k in (3, 5, 7):
        w = px.windows(x, k, "symmetric")
        low, mid, high = w.min(-1), np.median(w, -1), w.max(-1)
        want = np.where(left, np.where((low < mid) & (mid < high) & (low < x) & (x < high), x, mid), want)
        left &= ~((low < mid) & (mid < high))
    assert np.array_equal(px.denoise_adaptive_median(x, 7), want)


def test_non_local_means_are_those_of_all_patches():
    x = np.random.default_rng(7).random((2, 6, 5))
    q, h, t, s = px.quantize(x), 10.0, 1, 2
    p = np.pad(q, ((0, 0), (s + t, s + t), (s + t, s + t)), mode="reflect")
    patch = lambda n, y, x: p[n, y + s : y + s + 3, x + s : x + s + 3]
    for n, y, z in np.ndindex(x.shape):
        near = [(dy, dx) for dy in range(-s, s + 1) for dx in range(-s, s + 1)]
        w = [np.exp(-((patch(n, y, z) - patch(n, y + dy, z + dx)) ** 2).sum() / 9 / (h * h)) for dy, dx in near]
        v = [p[n, y + dy + s + t, z + dx + s + t] for dy, dx in near]
        assert px.denoise_nlm(x, h, 3, 5)[n, y, z] == np.rint(np.dot(w, v) / np.sum(w)) / 255


def test_random_numbers_are_made_once_for_all_models(spark):
    from pelagia.operators import noise

    df = images_of(spark)
    out = df.select("image_id", noise.all_models(F.col("image"), F.col("image_id")).alias("n"))
    assert plan(out).count("md5(") <= 4  # uniform, two for normal, Poisson's
    assert plan(out).count("inverted(") == 1
    got = {(r.image_id, r.noise_type): r.data for r in out.select("image_id", F.explode("n").alias("n")).select("image_id", "n.noise_type", "n.image.data").collect()}
    for k, add in noise.ADD.items():
        for r in df.select("image_id", add(F.col("image"), F.col("image_id"), **noise.MODELS[k], seed=42).alias("one")).collect():
            assert got[r.image_id, k] == r.one["data"]


def test_an_experiment_on_one_partition_is_dealt_out(spark):
    from pelagia.operators import experiment

    df = images_of(spark, 64)
    for few in (df, df.repartition(spark.sparkContext.defaultParallelism)):
        assert experiment.run(few, methods=["gaussian"]).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("bilinear", [False, True])
def test_augmentation_evaluates_an_image_once(spark, bilinear):
    from pelagia.functions import augment

    out = images_of(spark).select("image_id", augment.train(F.col("image"), F.col("image_id"), bilinear=bilinear).alias("m"))
    assert plan(out).count("md5(") <= 4  # across, down, turn for its cosine and its sine


def test_the_range_of_a_stand_in_is_found_once(spark):
    from pelagia.plans.standins import images

    text = plan(images(spark, "/root/testdata/sf0.001").select("image_id", "image"))
    assert text.count("array_min(") == 1 and text.count("array_max(") == 1
    assert not any("array_min(" in line for line in text.splitlines() if "try_divide" in line or " / " in line)


@pytest.mark.parametrize("name", ["augment_train", "augment_train_bilinear"])
def test_an_augmented_image_is_made_once_and_after_it_is_dealt_out(spark, name):
    from pelagia.registry import queries

    text = plan(queries()[name](spark, "/root/testdata/sf0.001"))
    assert text.count("md5(") <= 4  # across, down, turn for its cosine and its sine
    above, _, below = text.partition("Repartition")
    assert "transform(" in above and below and "transform(" not in below


def test_pixels_of_an_image_are_those_it_has(spark):
    rows = [(1, (1, 2, [0.5, None])), (2, (0, 0, [])), (3, (1, 1, None)), (4, None), (5, (1, 1, [float("nan")]))]
    df = spark.createDataFrame(rows, f"image_id int, image {im.IMAGE}")
    doubled = df.withColumn("image", F.when(F.col("image").isNotNull(), im.pack(F.transform("image.data", lambda v: v * 2), 1, F.size("image.data"))))
    out = im.long(doubled)
    assert sorted(map(str, out.collect())) == ["Row(image_id=1, pos=0, v=1.0)", "Row(image_id=1, pos=1, v=None)", "Row(image_id=5, pos=0, v=nan)"]
    assert plan(out).count("transform(") == 1  # in no filter before it


@pytest.mark.parametrize("name", ["experiment_closed", "experiment_metrics"])
def test_the_experiment_scales_its_images_after_they_are_dealt_out(spark, name):
    from pelagia.registry import queries

    above, _, below = plan(queries()[name](spark, "/root/testdata/sf0.001")).partition("Repartition")
    assert "array_min(" in above and below and "transform(" not in below and "array_min(" not in below
