"""Shuffled batches, dataset items and augmentations."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagia.functions import augment
from pelagia.operators import batches
from pelagia.operators.images import pack


@pytest.mark.parametrize("n", [1, 2, 3, 16, 37, 100])
def test_places_are_a_permutation(spark, n):
    got = [r.p for r in spark.range(n).select(batches.permuted(F.col("id"), n, 7, 3).alias("p")).collect()]
    assert got == [batches.place(i, n, 7, 3) for i in range(n)] and sorted(got) == list(range(n))


def test_permutations_mix():
    n = 400
    first, second = ([batches.place(i, n, 1, e) for i in range(n)] for e in (0, 1))
    assert sum(a == b for a, b in zip(first, second, strict=True)) < 8
    assert abs(np.corrcoef(first, range(n))[0, 1]) < 0.2 and abs(np.corrcoef(first, second)[0, 1]) < 0.2
    assert sum(abs(a - b) == 1 for a, b in zip(first, first[1:], strict=False)) < 10


def batched(df, **kw):
    return sorted(tuple(r) for r in batches.batches(df, "id", 8, epochs=3, **kw).select("epoch", "batch", "place", "id").collect())


def test_every_row_once_an_epoch_under_any_partitioning(spark):
    df = spark.range(101).withColumn("x", F.col("id") % 3)
    got = batched(df.repartition(7))
    assert got == batched(df.coalesce(1)) == batched(df.repartition(3, "x"))
    for e in range(3):
        assert sorted(i for epoch, *_, i in got if epoch == e) == list(range(101))
        assert Counter(b for epoch, b, *_ in got if epoch == e) == {**dict.fromkeys(range(12), 8), 12: 5}
    orders = [[i for epoch, *_, i in got if epoch == e] for e in range(3)]
    assert orders[0] != orders[1] != orders[2]
    assert batched(df, seed=1) != got
    plain = batched(df, shuffle=False)
    assert [i for e, *_, i in plain if e == 0] == [i for e, *_, i in plain if e == 2]
    assert max(b for _, b, *_ in batched(df, drop_last=True)) == 11


def test_awkward_batches(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (None, "c"), (2, "d")], "id long, other string")
    out = batches.batches(df, "id", 2, ties=("other",)).collect()
    assert sorted((r.batch, r.place) for r in out) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)]
    assert Counter((r.id, r.other) for r in out) == Counter(tuple(r) for r in df.collect())
    assert batches.batches(df.limit(0), "id", 2).collect() == []
    with pytest.raises(ValueError):
        batches.batches(df, "id", 0)
    assert {r.epoch: r.size for r in batches.gathered(batches.batches(df, "id", 9), ["other"]).collect()} == {0: 5}


def test_no_exchange_into_one_partition_holds_rows(spark):
    plan = batches.batches(spark.range(50).repartition(3), "id", 8)._jdf.queryExecution().executedPlan().toString()
    single = [x for x in plan.splitlines() if "SinglePartition" in x]
    assert len(single) == 1  # the counts of the buckets
    assert "rangepartitioning" not in plan


def test_dataset_items(spark):
    paths = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    images = spark.createDataFrame([("a", 1), ("b", 2)], "path string, image int")
    labels = spark.createDataFrame([("a", 1)], "path string, label int")
    assert sorted((tuple(r) for r in batches.dataset(paths, images, labels).collect()), key=repr) == [("a", 1, 1), ("b", 2, 0), ("c", None, 0)]
    assert {r.label for r in batches.dataset(paths, images).collect()} == {0}


def image(spark, x):
    h, w = x.shape
    return spark.createDataFrame([(1, [float(v) for v in x.ravel()])], "k int, d array<double>").select("k", pack(F.col("d"), h, w).alias("image"))


def back(df, made):
    r = df.select(made.alias("m")).first().m
    return np.array(r.data).reshape(r.height, r.width)


def test_flips_and_turns(spark):
    x = np.arange(35.0).reshape(5, 7)
    df = image(spark, x)
    c = F.col("image")
    assert (back(df, augment.flip(c, F.lit(True), F.lit(False))) == x[:, ::-1]).all()
    assert (back(df, augment.flip(c, F.lit(False), F.lit(True))) == x[::-1]).all()
    y = np.arange(25.0).reshape(5, 5)
    df = image(spark, y)
    for bilinear in (False, True):
        assert np.allclose(back(df, augment.rotate(c, F.lit(90.0), bilinear)), np.rot90(y))
        assert np.allclose(back(df, augment.rotate(c, F.lit(0.0), bilinear)), y)
    turned = back(df, augment.rotate(c, F.lit(10.0), True))
    assert turned[2, 2] == pytest.approx(12) and turned[0, 0] < y.max()


def test_draws_depend_on_epoch_and_image_only(spark):
    df = spark.range(2000).select("id", augment.draw(F.col("id"), 1, 0, "across").alias("a"), augment.draw(F.col("id"), 1, 1, "across").alias("b"), augment.draw(F.col("id"), 1, 0, "turn").alias("c"))
    a, b, c = (np.array(x) for x in zip(*[(r.a, r.b, r.c) for r in df.collect()], strict=True))
    assert 0.45 < (a < 0.5).mean() < 0.55 and abs(np.corrcoef(a, b)[0, 1]) < 0.1 and abs(np.corrcoef(a, c)[0, 1]) < 0.1 and a.max() < 1 <= a.max() + 0.01


def test_augmentation_stays_in_the_jvm_and_keeps_null(spark):
    df = image(spark, np.eye(3))
    df = df.unionByName(df.select(F.lit(2).alias("k"), F.lit(None).cast(df.schema["image"].dataType).alias("image")))
    out = df.select("k", augment.train(F.col("image"), F.col("k"), bilinear=True).alias("m"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.k: r.m for r in out.collect()}
    assert got[2] is None and len(got[1].data) == 9 and min(got[1].data) >= -1
