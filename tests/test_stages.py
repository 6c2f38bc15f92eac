"""The chain of image stages, files included."""

import numpy as np
from pyspark.sql import functions as F

from pelagia.operators import images as im
from pelagia.operators import stages
from pelagia.sources import files
from tests.test_images import frame


def test_chain(spark, tmp_path):
    rng = np.random.default_rng(0)
    yy, xx = np.mgrid[:120, :100]
    stack = [np.where((yy - 60) ** 2 + (xx - 50) ** 2 < 1500, 150, 5) + rng.integers(0, 60, (120, 100)) for _ in range(3)]
    raw = frame(spark, *stack).withColumn("name", F.concat(F.lit("r"), F.col("image_id").cast("string"), F.lit(".png")))
    from pelagia.sources import sinks

    paths = spark.createDataFrame(sinks.write_images(raw, f"{tmp_path}/raw", scaled=False).collect())
    (tmp_path / "raw" / "bad.png").write_bytes(b"x")
    master = paths.select(F.lit("P_1").alias("patient_id"), F.lit("mass").alias("abnormality_category"), F.lit("LEFT").alias("left_or_right_breast"), F.lit(None).cast("string").alias("image_view"), F.lit("BENIGN").alias("pathology"), F.lit(None).cast("int").alias("label"), F.concat(F.lit("file:"), F.regexp_replace("path", "^file:/*", "/")).alias("image_path"))
    master = master.unionByName(master).unionByName(master.limit(1).withColumn("image_path", F.lit(f"file:{tmp_path}/raw/bad.png"))).withColumn("n", F.monotonically_increasing_id())
    out = stages.basic(master, files.read_images(spark, f"{tmp_path}/raw"), ["n"], size=(64, 64)).cache()
    rows = out.collect()
    assert len(rows) == 3 and {r.label for r in rows} == {0} and {r.image_view for r in rows} == {"UNKNOWN"} and {r.dataset_split for r in rows} == {"train"}
    assert {r.name for r in rows} == {f"P_1_mass_LEFT_UNKNOWN_r{i}.png" for i in range(3)} and all(len(r.image.data) == 4096 for r in rows)
    sharp = stages.sharpen(stages.contrast(out))
    noisy = stages.add_noise(sharp).cache()
    assert noisy.count() == 15 and noisy.filter("noise_parameters is null").count() == 0
    done = stages.denoise(noisy, ["median", "gaussian"])
    assert done.count() == 30 and done.filter("status <> 'SUCCESS'").count() == 0
    assert {r.hardware_architecture for r in done.select("hardware_architecture").distinct().collect()} == {"CPU", "GPU"}
    assert stages.noise_table(noisy).filter("passed").count() == 3
    assert stages.sample_check(out, sharp).filter("status = 'PASSED'").count() == 3
    wrote = stages.write_stage(sharp, f"file://{tmp_path}/sharp", "sharpened_image_path")
    assert wrote.count() == 3 and files.read_images(spark, f"{tmp_path}/sharp", invalid="drop").count() == 3
    full = stages.full_pipeline(raw.withColumn("standardized_pathology", F.lit("BENIGN")), (32, 32)).collect()
    assert len(full) == 3 and all(len(r.image.data) == 1024 and r.bucket == "benign" and max(r.image.data) <= 1 for r in full)


def test_the_denoising_stage_counts_all_eight_filters(spark):
    import duckdb

    from pelagia.registry import queries, registered_sql

    df = queries()["denoise_stage_status"](spark, "/root/testdata/sf0.001")
    got = sorted(map(tuple, df.collect()))
    assert [m for m, *_ in got] == sorted(im.FILTERS) and len(got) == 8  # non-local means, too
    con = duckdb.connect()
    con.sql("create view embeddings as select * from '/root/testdata/sf0.001/embeddings.parquet'")
    assert got == sorted(con.sql(registered_sql("denoise_stage_status")).fetchall())
    above, _, below = df._jdf.queryExecution().optimizedPlan().toString().partition("Repartition")
    assert "ArrowEvalPython" in above and "transform(" not in below  # images are dealt out before any work on them


def test_each_row_of_the_denoising_stage_is_its_filter_s_image(spark):
    rng = np.random.default_rng(1)
    stack = [rng.random((9, 7)) for _ in range(2)]
    df = frame(spark, *stack).withColumn("clean", F.col("image"))
    rows = stages.denoise(df).collect()
    assert len(rows) == 16
    for r in rows:
        kernel, params = im.FILTERS[r.denoising_method]
        assert np.allclose(np.reshape(r.image.data, (9, 7)), kernel(stack[r.image_id][None], **params)[0])
