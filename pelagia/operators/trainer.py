"""Training by mini-batches whose gradients are summed over the cluster.

An epoch's rows are dealt into batches by a keyed permutation (batches.py) and written once in the order of batches, so that
a step reads its own row groups. Every task of a step returns one row, the sums of its loss and gradient; those are added in
two levels, and the driver gets the square root of as many rows as there are tasks. It holds the model, the optimiser and
nothing that grows with the data.

Models: softmax regression, or one hidden layer of rectified units on the features. There are no convolutional networks here.
Losses: cross-entropy, cross-entropy weighted by class (a batch's mean is by weight) and focal. The optimiser is Adam with
decoupled weight decay; the rate falls by a cosine over the epochs or on a plateau of the accuracy. The model of the best
validation accuracy is kept as a JSON file, with its epoch, accuracy, loss and confusion counts.

Defined cases: rows without a label or features are left out; a batch's rows are all of one size of features, else the
task fails and says so; without validation rows the measures are null and the last model is kept; without training rows
the first model is. Repeated rows count again."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.operators.batches import permuted, ranked
from pelagia.operators.catalog import random_split
from pelagia.operators.evaluation import cosine_rate, plateau_rates
from pelagia.sources.sinks import load_json, save_json
from pelagia.sources.work import work_dir


@dataclass
class Loss:
    name: str = "focal"
    alpha: float = 0.25
    gamma: float = 2.0
    weights: tuple[float, ...] | None = None  # of classes, for weighted_ce

    def __post_init__(self) -> None:
        if self.name not in ("ce", "weighted_ce", "focal"):
            raise ValueError(f"{self.name} is none of ce, weighted_ce, focal")


@dataclass
class Model:
    """Weights and biases of each layer."""

    layers: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for layer in self.layers for a in layer])

    def like(self, flat: np.ndarray) -> Model:
        out, at = [], 0
        for w, b in self.layers:
            out.append((flat[at : at + w.size].reshape(w.shape), flat[at + w.size : at + w.size + b.size]))
            at += w.size + b.size
        return Model(out)


def initial(features: int, classes: int = 2, hidden: int = 0, seed: int = 42) -> Model:
    """Softmax regression (hidden = 0), or one hidden layer; normal weights scaled to the layer's inputs, biases 0."""
    rng = np.random.default_rng(seed)
    sizes = [features, *([hidden] if hidden else []), classes]
    return Model([(rng.normal(0, (2 / a) ** 0.5 if hidden else 0.01, (b, a)), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)])


def scores(model: Model, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Class probabilities of rows, and the inputs of each layer."""
    inputs = [x]
    for i, (w, b) in enumerate(model.layers):
        x = x @ w.T + b
        if i + 1 < len(model.layers):
            x = np.maximum(x, 0)
            inputs.append(x)
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True), inputs


def loss_sums(model: Model, x: np.ndarray, y: np.ndarray, loss: Loss) -> tuple[float, float, np.ndarray]:
    """Sum of the losses, of the weights, and the gradient of the first, of rows x with labels y."""
    p, inputs = scores(model, x)
    at = np.arange(len(y))
    true = np.maximum(p[at, y], 1e-12)
    ce, weight = -np.log(true), np.ones(len(y))
    if loss.name == "focal":
        value = loss.alpha * (1 - true) ** loss.gamma * ce
        slope = loss.alpha * ((1 - true) ** loss.gamma + loss.gamma * (1 - true) ** (loss.gamma - 1) * true * ce)
    else:
        weight = np.asarray(loss.weights, float)[y] if loss.name == "weighted_ce" and loss.weights else weight
        value, slope = weight * ce, weight
    d = p.copy()
    d[at, y] -= 1
    d *= slope[:, None]
    grads = []
    for i in range(len(model.layers) - 1, -1, -1):
        grads[:0] = [(d.T @ inputs[i]).ravel(), d.sum(0)]
        if i:
            d = (d @ model.layers[i][0]) * (inputs[i] > 0)
    return float(value.sum()), float(weight.sum()), np.concatenate(grads)


def _matrix(batch: pd.DataFrame) -> np.ndarray:
    sizes = batch["features"].map(len).unique()
    if len(sizes) > 1:
        raise ValueError(f"rows have {sorted(map(int, sizes))} features")
    return np.stack(batch["features"].to_numpy()).astype(float)


def gradient(rows: DataFrame, model: Model, loss: Loss) -> tuple[float, float, np.ndarray]:
    """loss_sums() over all rows (features array<double>, label int) of a table."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(model.flat().size + 2)
        for b in batches:
            if len(b):
                value, weight, grad = loss_sums(model, _matrix(b), b["label"].to_numpy(int), loss)
                total += np.r_[value, weight, grad]
        yield pd.DataFrame({"sums": [total]})

    def added(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"sums": [np.sum(np.stack(g["sums"].to_numpy()), axis=0)]})

    some = rows.select("features", F.col("label").cast("int").alias("label")).mapInPandas(part, "sums array<double>")
    groups = max(1, ceil(rows.rdd.getNumPartitions() ** 0.5))
    if groups > 1:
        some = some.groupBy(F.pmod(F.spark_partition_id(), F.lit(groups)).alias("g")).applyInPandas(added, "sums array<double>")
    total = np.sum([r["sums"] for r in some.collect()] or [np.zeros(model.flat().size + 2)], axis=0)
    return float(total[0]), float(total[1]), total[2:]


class AdamW:
    """Adam with weight decay beside the gradient's step."""

    def __init__(self, size: int, decay: float = 1e-5, betas: tuple[float, float] = (0.9, 0.999), eps: float = 1e-8):
        self.m, self.v, self.t, self.decay, self.betas, self.eps = np.zeros(size), np.zeros(size), 0, decay, betas, eps

    def step(self, weights: np.ndarray, grad: np.ndarray, rate: float) -> np.ndarray:
        self.t += 1
        b1, b2 = self.betas
        self.m, self.v = b1 * self.m + (1 - b1) * grad, b2 * self.v + (1 - b2) * grad * grad
        m, v = self.m / (1 - b1**self.t), self.v / (1 - b2**self.t)
        return weights * (1 - rate * self.decay) - rate * m / (np.sqrt(v) + self.eps)


def probability(model: Model) -> Column:
    """Class probabilities (array<double>) from a column ``features``."""

    def run(features: pd.Series) -> pd.Series:
        out: list = [None] * len(features)
        ok = [i for i, f in enumerate(features) if f is not None]
        if ok:
            for i, p in zip(ok, scores(model, np.stack([features.iloc[i] for i in ok]).astype(float))[0], strict=True):
                out[i] = p
        return pd.Series(out)

    return F.pandas_udf(run, "array<double>")(F.col("features"))


def measured(rows: DataFrame, model: Model, loss: Loss) -> dict:
    """Mean loss, accuracy and confusion counts (of two classes: tp, fp, fn, tn) of a table; nulls without rows."""
    value, weight, _ = gradient(rows, model, loss)
    p = probability(model)
    said = F.array_position("p", F.array_max("p")).cast("int") - 1
    t, g = F.col("label").cast("int"), F.col("said")
    cells = {"tp": (t == 1) & (g == 1), "fp": (t != 1) & (g == 1), "fn": (t == 1) & (g != 1), "tn": (t != 1) & (g != 1)}
    got = rows.select("label", p.alias("p")).select("label", said.alias("said")).agg(F.avg((t == g).cast("double")).alias("accuracy"), *[F.count_if(c).alias(k) for k, c in cells.items()]).first()
    return {"loss": value / weight if weight else None, **got.asDict()}


def usable(df: DataFrame, label: str = "label", features: str = "features", key: str = "image_id") -> DataFrame:
    """key, label and features (array<double>) of the rows that have both."""
    kept = df.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"), F.col(features).cast("array<double>").alias("features"))
    return kept.filter("label is not null and features is not null")


def fit(train: DataFrame, val: DataFrame, model: Model, loss: Loss | None = None, epochs: int = 30, size: int = 16, rate: float = 1e-4, decay: float = 1e-5, schedule: str = "cosine", seed: int = 42, path: str | None = None) -> tuple[Model, list[dict]]:
    """The best model by validation accuracy and the history of epochs. train, val: usable() rows."""
    if schedule not in ("cosine", "plateau"):
        raise ValueError(f"{schedule} is neither cosine nor plateau")
    loss, spark = loss or Loss(), train.sparkSession
    n = train.count()
    steps = ceil(n / size)
    rows = ranked(train, "key")
    adam, weights, best, history = AdamW(model.flat().size, decay), model.flat(), model, []
    top, accuracies, now = -1.0, [], rate
    for epoch in range(epochs):
        total = seen = 0.0
        if n:
            dealt = rows.withColumn("batch", F.floor(permuted(F.col("_rank"), n, seed, epoch) / size)).drop("_rank")
            at = work_dir(spark, f"epoch{epoch}")
            dealt.repartitionByRange("batch").sortWithinPartitions("batch").write.parquet(at)
            batches = spark.read.schema(dealt.schema).parquet(at)
            for step in range(steps):
                value, weight, grad = gradient(batches.filter(F.col("batch") == step), model.like(weights), loss)
                if weight:
                    weights = adam.step(weights, grad / weight, now)
                total, seen = total + value, seen + weight
            _drop(spark, at)
        model = model.like(weights)
        found = measured(val, model, loss)
        accuracies.append(found["accuracy"] or 0.0)
        now = cosine_rate(epoch + 1, epochs, rate) if schedule == "cosine" else plateau_rates(accuracies, rate)[-1]
        history.append({"epoch": epoch, "train_loss": total / seen if seen else None, "rate": now} | {f"val_{k}": v for k, v in found.items()})
        if found["accuracy"] is None or found["accuracy"] > top:
            best, top = model, found["accuracy"] if found["accuracy"] is not None else top
            if path is not None:
                save(best, path, history[-1])
    return best, history


def _drop(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def save(model: Model, path: str, notes: dict | None = None) -> None:
    save_json({"layers": [[w.tolist(), b.tolist()] for w, b in model.layers], "notes": notes or {}}, path)


def load(path: str) -> tuple[Model, dict]:
    got = load_json(path)
    return Model([(np.array(w), np.array(b)) for w, b in got["layers"]]), got["notes"]


def split(df: DataFrame, split_column: str = "dataset_split", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows by the column; by a hash of the key, 80 to 20, where a side is empty. df: usable() rows
    with that column."""
    side = F.lower(F.trim(F.col(split_column).cast("string")))
    one, two = df.filter(side == "train"), df.filter(side.isin("val", "validation", "test"))
    if not one.head(1) or not two.head(1):
        one, two = random_split(df, "key", 0.2, seed)
    return one.drop(split_column), two.drop(split_column)
