"""The trainer against a plain loop, and its optimiser and losses against finite differences."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagia.operators import batches, evaluation, trainer
from pelagia.operators.images import pack
from pelagia.operators.trainer import AdamW, Loss, Model


def table(spark, n=60, d=5, seed=0, classes=2):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    x = rng.normal(0, 1, (n, d)) + np.eye(classes, d)[y] * 2
    df = spark.createDataFrame([(i, int(y[i]), [float(v) for v in x[i]]) for i in range(n)], "key long, label int, features array<double>")
    return df.repartition(5), x, y


@pytest.mark.parametrize("hidden", [0, 4])
@pytest.mark.parametrize("loss", [Loss("ce"), Loss("weighted_ce", weights=(0.3, 2.0, 1.0)), Loss("focal"), Loss("focal", 0.7, 1.5)])
def test_gradients_are_those_of_the_loss(hidden, loss):
    rng = np.random.default_rng(1)
    x, y = rng.normal(0, 1, (9, 4)), rng.integers(0, 3, 9)
    model = trainer.initial(4, 3, hidden, 2)
    model = model.like(model.flat() + rng.normal(0, 0.3, model.flat().size))
    value, _, grad = trainer.loss_sums(model, x, y, loss)
    flat = model.flat()
    for i in range(flat.size):
        step = np.zeros(flat.size)
        step[i] = 1e-6
        up, down = (trainer.loss_sums(model.like(flat + s), x, y, loss)[0] for s in (step, -step))
        assert grad[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)
    assert value > 0


def test_sums_over_the_cluster_are_those_of_one_task(spark):
    df, x, y = table(spark)
    model = trainer.initial(5, 2, 3)
    for parts in (1, 4, 30):
        value, weight, grad = trainer.gradient(df.repartition(parts), model, Loss())
        want = trainer.loss_sums(model, x, y, Loss())
        assert value == pytest.approx(want[0]) and weight == want[1] and np.allclose(grad, want[2])
    assert trainer.gradient(df.limit(0), model, Loss())[:2] == (0, 0)


@pytest.mark.parametrize("schedule", ["cosine", "plateau"])
def test_fit_is_the_plain_loop(spark, schedule):
    df, x, y = table(spark)
    val, vx, vy = table(spark, 30, seed=3)
    epochs, size, rate, loss = 4, 16, 0.05, Loss("weighted_ce", weights=(1.0, 3.0))
    start = trainer.initial(5)
    got, history = trainer.fit(df, val, start, loss, epochs, size, rate, 1e-2, schedule)

    ranks = {r.key: r._rank for r in batches.ranked(df, "key").collect()}
    w, m, v, t, now = start.flat(), 0.0, 0.0, 0, rate
    best, top, accuracies, losses = start, -1, [], []
    for epoch in range(epochs):
        places = np.array([batches.place(ranks[i], 60, 42, epoch) for i in range(60)])
        total = 0.0
        for step in range(4):
            at = np.flatnonzero(places // size == step)
            value, weight, grad = trainer.loss_sums(start.like(w), x[at], y[at], loss)
            g, t, total = grad / weight, t + 1, total + value
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - now * 1e-2 * w - now * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        p, _ = trainer.scores(start.like(w), vx)
        accuracies.append((p.argmax(1) == vy).mean())
        losses.append(total)
        if accuracies[-1] > top:
            top, best = accuracies[-1], start.like(w)
        now = evaluation.cosine_rate(epoch + 1, epochs, rate) if schedule == "cosine" else evaluation.plateau_rates(accuracies, rate)[-1]
    assert np.allclose(got.flat(), best.flat())
    assert [h["val_accuracy"] for h in history] == pytest.approx(accuracies)
    weights = np.where(y == 1, 3.0, 1.0).sum()
    assert [h["train_loss"] for h in history] == pytest.approx([v / weights for v in losses])


def test_best_model_is_kept_and_comes_back(spark, tmp_path):
    df, _, _ = table(spark, 80)
    val, vx, vy = table(spark, 40, seed=5)
    path = f"{tmp_path}/best_model.json"
    best, history = trainer.fit(df, val, trainer.initial(5), Loss(), 3, 40, 0.1, path=path)
    model, notes = trainer.load(path)
    assert np.allclose(model.flat(), best.flat())
    assert notes["val_accuracy"] == max(h["val_accuracy"] for h in history) > 0.8
    assert notes["val_tp"] + notes["val_fp"] + notes["val_fn"] + notes["val_tn"] == 40
    said = np.array([np.argmax(r.p) for r in val.orderBy("key").select(trainer.probability(model).alias("p")).collect()])
    assert (said == trainer.scores(model, vx)[0].argmax(1)).all() and (said == vy).mean() == pytest.approx(notes["val_accuracy"])


def test_images_are_told_apart(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in np.clip(rng.normal(0.3 + 0.4 * (i % 2), 0.05, 256), 0, 1)], i % 2, "train" if i < 30 else "test") for i in range(40)]
    df = spark.createDataFrame(rows, "image_id long, d array<double>, label int, dataset_split string")
    data = evaluation.features(df.withColumn("image", pack(F.col("d"), 16, 16)), side=2)
    usable = trainer.usable(data).join(data.select(F.col("image_id").alias("key"), "dataset_split"), "key")
    one, two = trainer.split(usable)
    assert (one.count(), two.count()) == (30, 10)
    _, history = trainer.fit(one, two, trainer.initial(4), Loss(), 3, 10, 0.2)
    assert history[-1]["val_accuracy"] == 1.0
    one, two = trainer.split(usable.withColumn("dataset_split", F.lit("train")))
    assert one.count() + two.count() == 40 and 0 < two.count() < 20


def test_awkward_tables(spark):
    df, _, _ = table(spark, 6)
    model = trainer.initial(5)
    best, history = trainer.fit(df.limit(0), df.limit(0), model, epochs=2)
    assert np.allclose(best.flat(), model.flat()) and history[0]["train_loss"] is None and history[0]["val_accuracy"] is None
    best, _ = trainer.fit(df, df.limit(0), model, epochs=1, rate=0.1)
    assert not np.allclose(best.flat(), model.flat())
    mixed = df.withColumn("features", F.when(F.col("key") == 0, F.array(F.lit(1.0))).otherwise(F.col("features"))).coalesce(1)
    with pytest.raises(Exception, match="features"):
        trainer.gradient(mixed, model, Loss())
    nulls = spark.createDataFrame([(1, None, [1.0]), (2, 1, None), (3, 1, [1.0])], "image_id long, label int, features array<double>")
    assert [r.key for r in trainer.usable(nulls).collect()] == [3]
    for bad in (lambda: Loss("other"), lambda: trainer.fit(df, df, model, schedule="none")):
        with pytest.raises(ValueError):
            bad()
    assert Model([(np.ones((2, 1)), np.zeros(2))]).flat().tolist() == [1, 1, 0, 0] and AdamW(1).step(np.ones(1), np.zeros(1), 0.1)[0] < 1
