"""The error channel: one bad image of many loses one row, with its reason."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagia.operators import errors, images, stages
from pelagia.operators.images import pack
from pelagia.sources.files import encode_png, read_images


def frame(spark, n=12, side=8):
    rng = np.random.default_rng(1)
    rows = [(f"i{i}", [float(v) for v in rng.random(side * side)]) for i in range(n)]
    df = spark.createDataFrame(rows, "name string, d array<double>")
    return errors.channel(df.select("name", pack(F.col("d"), side, side).alias("image")))


def broken(df, name, data):
    return df.withColumn("image", F.when(F.col("name") == name, pack(data, 8, 8)).otherwise(F.col("image")))


def test_one_bad_image_of_many_loses_one_row(spark, tmp_path):
    df = broken(broken(frame(spark), "i3", F.slice("image.data", 1, 60)), "i5", F.lit(None).cast("array<double>"))
    good, bad, counts = errors.settle(stages.sharpen(stages.contrast(df.coalesce(1))), f"{tmp_path}/t")
    assert counts == {"succeeded": 10, "failed": 2}
    assert good.columns == ["name", "image"] and good.filter("image.data is null").count() == 0 and good.count() == 10
    assert sorted(tuple(r) for r in bad.select("name", "error").collect()) == [("i3", "contrast: 60 values for 8 x 8 pixels"), ("i5", "contrast: no image")]


def test_a_raising_kernel_names_the_row_and_spares_its_stack(spark, tmp_path):
    def kernel(x):
        if (x[:, 0, 0] > 5).any():
            raise OverflowError("too bright")
        return x + 1

    df = broken(frame(spark).coalesce(1), "i7", F.transform("image.data", lambda v: v + 9))
    good, bad, counts = errors.settle(errors.step(df, "custom", kernel), f"{tmp_path}/t")
    assert counts["failed"] == 1 and bad.first().error == "custom: OverflowError: too bright" and good.count() == 11
    plain = {r.name: r.image.data for r in df.collect()}
    assert all(np.allclose(r.image.data, np.array(plain[r.name]) + 1) for r in good.collect())


def test_rows_with_an_error_meet_no_further_kernel(spark, tmp_path):
    df = broken(frame(spark), "i2", F.slice("image.data", 1, 2))
    twice = errors.step(errors.step(df, "first", "min_max"), "second", "min_max")
    assert twice.filter("name = 'i2'").first().error == "first: 2 values for 8 x 8 pixels"


def test_a_failing_filter_leaves_the_others(spark, monkeypatch, tmp_path):
    def none(x, **_):
        raise ValueError("no")

    monkeypatch.setitem(images.FILTERS, "kuan", (none, {}))
    df = frame(spark, 3).withColumn("clean", F.col("image"))
    out = stages.denoise(df, ["median", "kuan"])
    assert {(r.denoising_method, r.status) for r in out.select("denoising_method", "status").distinct().collect()} == {("median", "SUCCESS"), ("kuan", "FAILED")}
    good, bad, counts = errors.settle(out, f"{tmp_path}/t")
    assert counts == {"succeeded": 3, "failed": 3} and {r.error for r in bad.collect()} == {"kuan: ValueError: no"}


def test_damaged_files_of_a_folder_are_named(spark, tmp_path):
    rng = np.random.default_rng(2)
    for i in range(5):
        (tmp_path / f"f{i}.png").write_bytes(encode_png(rng.integers(0, 255, (6, 6))))
    (tmp_path / "f3.png").write_bytes(b"\x89PNG\r\n\x1a\nrubbish")
    decoded = read_images(spark, str(tmp_path))
    master = decoded.select(F.col("path").alias("image_path"), F.lit("P").alias("patient_id"))
    master = master.unionByName(spark.createDataFrame([("file:/gone.png", "P")], "image_path string, patient_id string"))
    good, bad, counts = errors.settle(stages.basic(master, decoded, ["image_path"], size=(4, 4), channel=True), f"{tmp_path}/t")
    assert counts == {"succeeded": 4, "failed": 2}
    assert sorted((r.original_image_path.rpartition("/")[2], r.error) for r in bad.collect()) == [("f3.png", "basic: no image"), ("gone.png", "basic: no image")]
    assert good.filter("size(image.data) = 16").count() == 4
    off = stages.basic(master, decoded, ["image_path"], size=(4, 4))
    assert "error" not in off.columns and off.count() == 4


def test_awkward_tables(spark, tmp_path):
    good, bad, counts = errors.settle(stages.contrast(frame(spark).limit(0)), f"{tmp_path}/t")
    assert good.collect() == bad.collect() == [] and counts == {"succeeded": 0, "failed": 0}
    assert errors.reason(ValueError("x" * 500)) == ("ValueError: " + "x" * 500)[:200]
    with pytest.raises(KeyError):
        errors.step(frame(spark), "s", "no such kernel")


def test_a_failed_result_of_the_experiment_costs_itself_alone(spark, monkeypatch, tmp_path):
    from pelagia.operators import experiment

    kernel, params = images.FILTERS["median"]

    def picky(x, **how):
        if (x[:, 0, 0] > 0.4).any():
            raise ArithmeticError("bright corner")
        return kernel(x, **how)

    monkeypatch.setitem(images.FILTERS, "kuan", (picky, params))
    data = F.transform("image.data", lambda v, i: F.when((i == 0) & (F.col("name") == "i4"), 1.0).when(i == 0, 0.1).otherwise(v))
    df = frame(spark).drop("error").select(F.col("name").alias("image_id"), pack(data, 8, 8).alias("image")).coalesce(1)
    good, bad, counts = experiment.isolated(df, f"{tmp_path}/t", methods=["median", "kuan"], noise_types=["speckle"])
    assert counts == {"succeeded": 23, "failed": 1} and good.count() == 23
    r = bad.first()
    assert (r.image_id, r.denoising_method, r.error) == ("i4", "kuan", "ArithmeticError: bright corner")
    plain = {(r.image_id, r.denoising_method): r.MSE for r in experiment.run(df, methods=["median"], noise_types=["speckle"]).collect()}
    assert all(plain[r.image_id, "median"] == pytest.approx(r.MSE) for r in good.filter("denoising_method = 'median'").collect())
    with pytest.raises(Exception, match="kuan on i4: ArithmeticError: bright corner"):
        experiment.run(df, methods=["kuan"], noise_types=["speckle"]).collect()
