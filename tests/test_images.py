"""Kernels, noise, metrics and image files on the fixtures of the reference's own tests."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagia.functions import pixels as px
from pelagia.operators import images as im
from pelagia.operators import noise
from pelagia.sources import files, sinks


def ramp(n=48, seed=42):
    rng = np.random.default_rng(seed)
    return np.clip(np.linspace(0.1, 0.9, n * n).reshape(1, n, n) + rng.normal(0, 0.05, (1, n, n)), 0, 1)


def frame(spark, *stack):
    rows = [(i, (x.shape[0], x.shape[1], [float(v) for v in x.ravel()])) for i, x in enumerate(stack)]
    return spark.createDataFrame(rows, f"image_id long, image {im.IMAGE}")


def back(row):
    return np.array(row["data"]).reshape(row["height"], row["width"])


@pytest.mark.parametrize("name", im.FILTERS)
def test_filters_keep_shape_bounds_and_input(name):
    kernel, params = im.FILTERS[name]
    x = ramp()
    x[0, 5, 5], x[0, 10, 10] = np.nan, np.inf
    before = x.copy()
    y = kernel(x, **params)
    assert y.shape == x.shape and np.isfinite(y).all() and y.min() >= 0 and y.max() <= 1
    assert np.array_equal(x, before, equal_nan=True)


def test_filters_reduce_noise():
    clean = np.full((1, 48, 48), 0.5)
    noisy = np.clip(clean + np.random.default_rng(0).normal(0, 0.1, clean.shape), 0, 1)
    for name in ("median", "gaussian", "wiener", "bilateral", "adaptive_median", "kuan", "anscombe_wiener"):
        kernel, params = im.FILTERS[name]
        params = params | ({"sigma": 25.0} if name == "anscombe_wiener" else {})
        inner = lambda x: x[:, 8:-8, 8:-8]  # noqa: E731  a zero border darkens what is near it
        assert px.mse(inner(clean), inner(kernel(noisy, **params)))[0] < px.mse(inner(clean), inner(noisy))[0], name
    assert not px.denoise_anscombe_wiener(noisy, compat=True).any()


def test_bad_parameters_raise():
    for call in (lambda: px.denoise_median(ramp(), 4), lambda: px.denoise_adaptive_median(ramp(), 1), lambda: px.stretch_contrast(ramp(), 98, 2), lambda: px.resize(ramp(), 0, 4), lambda: px.mse(ramp(), ramp(32)), lambda: px.psnr(ramp(), ramp(), -1.0), lambda: px.normalize_image(np.empty((1, 0, 0)))):
        with pytest.raises(ValueError):
            call()


def test_intensity():
    assert (px.normalize_image(np.full((1, 50, 50), 128.0)) == 0).all()
    assert px.quantize(np.array([[[0, 0.5], [0.75, 1]]])).tolist() == [[[0, 128], [191, 255]]]
    dirty = px.stretch_contrast(np.array([[[0.2, np.nan], [np.inf, -np.inf]]]))
    assert np.isfinite(dirty).all() and dirty.min() == 0 and dirty.max() == 1
    flat = np.full((1, 10, 10), 0.5)
    assert (px.stretch_contrast(flat) == 0.5).all() and (px.z_score_normalize(flat) == 0).all() and (px.min_max_normalize(flat) == 0).all() and (px.robust_min_max_normalize(flat) == 0).all()
    z = px.z_score_normalize(ramp())
    assert abs(z.mean()) < 1e-9 and z.std() == pytest.approx(1)
    spike = np.full((1, 20, 20), 0.9)
    spike[0, 10, 10] = 1
    assert px.unsharp_mask(spike, 2.0).max() <= 1 and px.unsharp_mask(spike, kernel_size=(4, 4)).shape == spike.shape
    assert np.allclose(px.laplacian_sharpen(flat), 0.5)
    e = px.histogram_equalize(ramp())
    assert e.min() == 0 and e.max() == 1
    c = px.clahe(ramp(50))
    assert c.shape == (1, 50, 50) and 0 <= c.min() and c.max() <= 1 and c.std() > 0


def test_geometry():
    x = np.linspace(0, 255, 15000).reshape(1, 100, 150)
    assert px.resize(x, 64, 48).shape == (1, 48, 64) and px.resize(x, 300, 200).shape == (1, 200, 300)
    assert px.resize(x, 75, 50).mean() == pytest.approx(x.mean())
    assert (px.suppress_corner(np.ones((1, 20, 20)))[0, 0, :5] == 0).all() and px.suppress_corner(np.ones((1, 20, 20)))[0, 19, 19] == 1
    disc = np.zeros((1, 80, 80))
    yy, xx = np.mgrid[:80, :80]
    disc[0][(yy - 40) ** 2 + (xx - 30) ** 2 < 400] = 0.8
    disc[0, 2:5, 70:73] = 0.9
    mask = px.segment_breast(disc)[0] > 0
    assert mask[40, 30] and not mask[3, 71] and px.bounding_box(mask, 0)[0] >= 18
    assert px.bounding_box(np.zeros((5, 7))) == (0, 5, 0, 7)
    parts = np.zeros((6, 8), bool)
    parts[0, 0] = parts[1, 1] = parts[2, 2] = parts[4, 6] = True
    assert px.largest_component(parts).sum() == 3
    assert px.largest_component(np.zeros((2, 2), bool)).all()
    assert px.ellipse(7).sum(1).tolist() == [1, 5, 7, 7, 7, 5, 1]


def test_metrics():
    a = np.linspace(0.1, 0.9, 64 * 64).reshape(1, 64, 64)
    b = np.clip(a + np.random.default_rng(42).normal(0, 0.05, a.shape), 0, 1)
    assert px.mse(a, a)[0] == 0 and np.isinf(px.psnr(a, a)[0]) and px.ssim(a, a)[0] == 1 and np.isinf(px.snr(a, a)[0])
    assert 0 < px.mse(a, b)[0] < 0.01 and 20 < px.psnr(a, b)[0] < 40 and 0 < px.ssim(a, b)[0] < 1 and px.snr(a, b)[0] > 10
    assert px.snr(np.zeros((1, 4, 4)), np.ones((1, 4, 4)))[0] == 0
    assert px.entropy(np.full((1, 50, 50), 0.5))[0] == 0
    half = np.zeros((1, 50, 50))
    half[0, 25:] = 1
    assert px.entropy(half, 2)[0] == pytest.approx(1) and px.entropy(np.random.default_rng(0).random((1, 100, 100)))[0] > 6
    roi, bg = np.array([0.8, 0.82, 0.79, 0.81]), np.array([0.2, 0.21, 0.19, 0.22])
    assert px.cnr(roi, bg) == pytest.approx(abs(roi.mean() - bg.mean()) / np.sqrt(roi.var() + bg.var()))
    assert px.cnr(roi, bg, "rose") > px.cnr(roi, bg) and px.cnr(np.full(5, 0.8), np.full(5, 0.2)) == 0 and px.cnr(roi[:0], bg) == 0
    one = lambda v: np.array([v])
    assert px.cii(one(0.7), one(0.3), one(0.5), one(0.4)) > 1
    assert px.cii(one(0.5), one(0.5), one(0.5), one(0.5)) == 1


def test_regions():
    x = np.full((64, 64), 0.3)
    x[:10] = 0
    x[25:35, 25:35] = 0.8
    mask = np.zeros((64, 64))
    mask[25:35, 25:35] = 1
    roi, bg = px.ring_regions(x, mask)
    assert roi.sum() == 100 and x[roi].mean() == pytest.approx(0.8) and x[bg].mean() == pytest.approx(0.3)
    y = np.zeros((48, 48))
    y[10:40, 10:40] = 0.2
    y[20:30, 20:30] = 0.8
    roi, bg = px.otsu_regions(y)
    assert roi.sum() == 100 and bg.sum() == 800
    assert px.otsu_regions(np.zeros((4, 4)))[0].all()
    with pytest.raises(ValueError):
        px.ring_regions(x, mask[:5])


def test_noise_models(spark):
    patch = np.linspace(0.1, 0.8, 32 * 32).reshape(32, 32)
    df = frame(spark, patch, np.full((32, 32), 0.5))
    rows = df.select("image_id", F.explode(noise.all_models(F.col("image"), F.col("image_id"))).alias("n")).select("image_id", "n.*").collect()
    got = {(r.image_id, r.noise_type): back(r.image) for r in rows}
    again = {(r.image_id, r.noise_type): back(r.image) for r in df.repartition(3).select("image_id", F.explode(noise.all_models(F.col("image"), F.col("image_id"))).alias("n")).select("image_id", "n.*").collect()}
    assert len(got) == 10 and all(np.array_equal(got[k], again[k]) for k in got)
    flat = lambda k: got[1, k] - 0.5
    assert flat("gaussian").std() == pytest.approx(0.1, rel=0.1) and abs(flat("gaussian").mean()) < 0.02
    assert flat("speckle").std() == pytest.approx(0.1, rel=0.1)
    assert flat("poisson").std() == pytest.approx(np.sqrt(0.5 / 255), rel=0.15)
    assert flat("mixed_poisson_gaussian").var() == pytest.approx(0.5 / 255 + 0.005, rel=0.15)
    assert 0.02 < (flat("salt_pepper") != 0).mean() < 0.06
    for v in got.values():
        assert v.min() >= 0 and v.max() <= 1
    r = df.select(noise.realism(F.col("image"), F.col("image"), F.lit("gaussian")).alias("r")).first().r
    assert not r.changed and not r.passed


def test_columns_and_crop(spark):
    df = frame(spark, ramp(8)[0], np.full((4, 4), 0.5)).union(spark.createDataFrame([(9, None)], f"image_id long, image {im.IMAGE}"))
    out = {r.image_id: r for r in df.select("image_id", im.apply_named(F.col("image"), "median").alias("y"), im.validity(F.col("image")).alias("v")).collect()}
    assert np.allclose(back(out[0].y), px.denoise_median(ramp(8))[0]) and out[9].y.data is None
    assert (out[0].v.is_valid, out[1].v.is_valid, out[9].v.is_valid) == (True, False, False)
    mask = im.pack(F.transform("image.data", lambda v: (v > 0.85).cast("double")), 8, 8)
    c = frame(spark, ramp(8)[0]).select(im.crop(F.col("image"), mask, 0).alias("c")).first().c
    assert c.height <= 8 and max(c.data) == ramp(8)[0].max()


def test_png_round_trip(spark, tmp_path):
    x = np.linspace(0, 1, 150).reshape(10, 15)
    df = frame(spark, x, x[::-1]).withColumn("name", F.concat(F.lit("benign/i"), F.col("image_id").cast("string"), F.lit(".png")))
    wrote = sinks.write_images(df, f"file://{tmp_path}/out").collect()
    assert len(wrote) == 2
    (tmp_path / "out" / "bad.png").write_bytes(b"no image")
    got = {r.path.rpartition("/")[2]: r.image for r in files.read_images(spark, f"{tmp_path}/out").collect()}
    assert np.array_equal(back(got["i0.png"]), px.quantize(x[None])[0]) and got["bad.png"].data is None
    same = files.read_image_source(spark, f"{tmp_path}/out/benign").collect()
    assert {r.path.rpartition("/")[2]: r.image.data for r in same}["i0.png"] == got["i0.png"].data
    assert files.read_images(spark, f"{tmp_path}/out", invalid="drop").count() == 2
    with pytest.raises(Exception, match="cannot decode"):
        files.read_images(spark, f"{tmp_path}/out", invalid="fail").collect()
    with pytest.raises(PermissionError):
        sinks.write_images(df, "/x/data/raw/y")
    found = files.inventory(spark, f"{tmp_path}/out")
    assert {r.key for r in files.recursive_index(found).collect()} >= {"i0.png", "benign", "out"}


def test_regions_by_masks(spark):
    from pelagia.operators import experiment, images

    rng = np.random.default_rng(3)
    clean = [np.clip(rng.normal(0.5, 0.1, (24, 20)), 0.05, 1) for _ in range(4)]
    lesion = np.zeros((24, 20))
    lesion[8:14, 6:12] = 1
    masks = [lesion, lesion * 0, None, np.ones((24, 20))]
    rows = [(i, [float(v) for v in x.ravel()], None if m is None else [float(v) for v in m.ravel()]) for i, (x, m) in enumerate(zip(clean, masks, strict=True))]
    df = spark.createDataFrame(rows, "image_id long, d array<double>, m array<double>").select("image_id", images.pack(F.col("d"), 24, 20).alias("image"), F.when(F.col("m").isNotNull(), images.pack(F.col("m"), 24, 20)).alias("mask"))
    out = experiment.run(df, mask="mask", radius=3, keep_image=True, methods=["median", "gaussian"]).collect()
    assert len(out) == 4 * 5 * 2
    for r in out:
        x, y, m = clean[r.image_id], np.array(r.denoised.data).reshape(24, 20), masks[r.image_id]
        roi, bg = px.ring_regions(x, m > 0, radius=3) if m is not None and m.any() else px.otsu_regions(x)
        assert r.CNR == pytest.approx(px.cnr(y[roi], y[bg])) and r.CII == pytest.approx(px.cii(y[roi], y[bg], x[roi], x[bg]))
    path = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "resolved_roi_mask_path string, k int")
    known = df.filter("image_id = 0").select(F.lit("a").alias("path"), F.col("mask").alias("image"))
    got = {r.k: r.mask for r in images.with_masks(path, known.unionByName(known)).collect()}
    assert got[1].height == 24 and got[2] is None and got[3] is None
    with pytest.raises(Exception, match="a mask of"):
        df.withColumn("mask", images.pack(F.array(F.lit(1.0)), 1, 1)).select(images.metrics(F.col("image"), F.col("image"), mask=F.col("mask"))).collect()
