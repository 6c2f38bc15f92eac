"""Built-in point operators and metrics against the kernels, and both from SQL."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagia.functions import pixels as px
from pelagia.functions import points, sql
from pelagia.operators.images import FILTERS, KERNELS, METRICS, pack

NAN, INF = float("nan"), float("inf")


def frame(spark, *arrays):
    rows = [(i, x.shape[0], x.shape[1], [float(v) for v in x.ravel()]) for i, x in enumerate(arrays)]
    df = spark.createDataFrame(rows, "k int, h int, w int, d array<double>")
    return df.select("k", pack(F.col("d"), F.col("h"), F.col("w")).alias("image"))


@pytest.fixture(scope="module")
def arrays():
    rng = np.random.default_rng(0)
    dirty = rng.random((4, 5))
    dirty[0, 0], dirty[1, 1], dirty[2, 2] = NAN, INF, -INF
    return {"plain": rng.random((6, 5)), "wide": rng.normal(0, 3, (3, 9)), "flat": np.full((4, 4), 0.5), "one": np.array([[0.25]]), "dirty": dirty}


@pytest.mark.parametrize(("name", "args"), [("normalize_image", ()), ("normalize_image", (0.1, 0.9)), ("min_max_normalize", ()), ("robust_min_max_normalize", ()), ("z_score_normalize", ()), ("stretch_contrast", ()), ("stretch_contrast", (10.0, 60.0)), ("quantize", ()), ("truncate", ()), ("suppress_corner", (0.5,)), ("anscombe", ()), ("inverse_anscombe", ())])
def test_point_operators_are_the_kernels(spark, arrays, name, args):
    some = {k: x for k, x in arrays.items() if k != "dirty" or name in ("normalize_image", "stretch_contrast", "quantize", "truncate")}
    out = frame(spark, *some.values()).select("k", getattr(points, name)(F.col("image"), *args).alias("m"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.k: r.m for r in out.collect()}
    for k, x in enumerate(some.values()):
        want = getattr(px, name)(x[None], *args)[0]
        assert np.allclose(np.array(got[k].data).reshape(want.shape), want, atol=1e-12), list(some)[k]


@pytest.mark.parametrize("name", ["mse", "mae", "psnr", "snr"])
def test_metrics_are_the_kernels(spark, arrays, name):
    pairs = [(x, np.clip(x + 0.1 * np.cos(np.arange(x.size)).reshape(x.shape), -9, 9)) for x in arrays.values()] + [(arrays["plain"], arrays["plain"]), (np.zeros((2, 2)), np.ones((2, 2)))]
    a, b = frame(spark, *[p[0] for p in pairs]), frame(spark, *[p[1] for p in pairs]).withColumnRenamed("image", "other")
    out = a.join(b, "k").select("k", getattr(points, name)(F.col("image"), F.col("other")).alias("v"))
    got = {r.k: r.v for r in out.collect()}
    for k, (x, y) in enumerate(pairs):
        assert got[k] == pytest.approx(getattr(px, name)(x[None], y[None])[0]), k
    swapped = frame(spark, np.ones((2, 3))).crossJoin(frame(spark, np.ones((3, 2))).select(F.col("image").alias("other")))
    assert swapped.select(getattr(points, name)(F.col("image"), F.col("other"))).first()[0] is None


def test_null_images_and_bad_parameters(spark):
    df = frame(spark, np.ones((2, 2))).select(F.lit(None).cast("struct<height:int,width:int,data:array<double>>").alias("image"))
    assert df.select(points.stretch_contrast(F.col("image")).alias("a"), points.z_score_normalize(F.col("image")).alias("b")).first() == (None, None)
    with pytest.raises(ValueError):
        points.stretch_contrast(F.col("image"), 98.0, 2.0)
    with pytest.raises(ValueError):
        points.psnr(F.col("image"), F.col("image"), 0.0)


@pytest.fixture(scope="module")
def view(spark):
    rng = np.random.default_rng(1)
    clean = [rng.random((8, 8)) for _ in range(3)] + [rng.random((6, 9))]
    a, b = frame(spark, *clean), frame(spark, *[np.clip(x + rng.normal(0, 0.1, x.shape), 0, 1) for x in clean]).withColumnRenamed("image", "noisy")
    names = sql.register(spark)
    assert set(names) == {"denoise", "transform_image", "image_metric", "pixels", *sql.BUILT_IN}
    df = a.join(b, "k")
    df.createOrReplaceTempView("v")
    return {r.k: [np.array(x.data).reshape(x.height, x.width) for x in (r.image, r.noisy)] for r in df.collect()}


@pytest.mark.parametrize("name", [n for n in FILTERS if n != "non_local_means"])
def test_filters_by_name(spark, view, name):
    for r in spark.sql(f"select k, denoise(noisy, '{name}', null) as m from v").collect():
        want = FILTERS[name][0](view[r.k][1][None], **FILTERS[name][1])[0]
        assert np.allclose(np.array(r.m.data).reshape(want.shape), want)


def test_names_and_parameters_may_be_columns(spark, view):
    got = spark.sql("""select k, t.method, denoise(noisy, t.method, t.params) as m from v join
        (values ('median', '{"kernel_size": 3}'), ('median', '{"kernel_size": 5}'), ('gaussian', '{"kernel_size": [3, 3], "sigma": 2.0}'), (null, null)) t(method, params) order by k, t.method, t.params""").collect()
    assert len(got) == 16 and sum(r.m.data is None if r.m else True for r in got) == 4
    first = next(r for r in got if r.k == 0 and r.method == "median")
    assert np.allclose(first.m.data, px.denoise_median(view[0][1][None], 3).ravel())
    small = spark.sql("""select k, transform_image(image, 'resize', '{"width": 4, "height": 2}') as m from v""").collect()
    assert all((r.m.height, r.m.width) == (2, 4) for r in small)
    assert {"resize", "clahe"} <= set(KERNELS)


def test_metrics_by_name(spark, view):
    rows = spark.sql(f"select k, n.name, image_metric(image, noisy, n.name) as v from v lateral view explode(array({', '.join(repr(m) for m in METRICS)})) n as name").collect()
    assert len(rows) == 28
    for r in rows:
        if r.name in ("MSE", "PSNR", "SSIM", "SNR"):
            x, y = (a[None] for a in view[r.k])
            assert r.v == pytest.approx(getattr(px, r.name.lower())(x, y)[0])
    built = spark.sql("select k, image_mse(image, noisy) as mse, image_mae(image, noisy) as mae, image_psnr(image, noisy) as psnr, image_snr(image, noisy) as snr from v")
    assert "Python" not in built._jdf.queryExecution().executedPlan().toString()
    for r in built.collect():
        x, y = (a[None] for a in view[r.k])
        assert (r.mse, r.mae, r.psnr, r.snr) == pytest.approx(tuple(f(x, y)[0] for f in (px.mse, px.mae, px.psnr, px.snr)))


def test_pixels_and_unknown_names(spark, view):
    got = spark.sql("select k, p.* from v, lateral pixels(noisy) p").collect()
    assert len(got) == 3 * 64 + 54
    assert all(r.v == view[r.k][1][r.y, r.x] and r.pos == r.y * view[r.k][1].shape[1] + r.x for r in got)
    assert spark.sql("select p.* from (select cast(null as struct<height:int,width:int,data:array<double>>) as i) t, lateral pixels(i) p").collect() == []
    with pytest.raises(Exception, match="none of"):
        spark.sql("select denoise(noisy, 'nothing', null) from v").collect()
    with pytest.raises(Exception, match="none of"):
        spark.sql("select image_metric(image, noisy, 'nothing') from v").collect()
