"""Classification metrics, curves, losses, rates and features of images; trainer.py fits models."""

from __future__ import annotations

from math import cos, pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    t, p = F.col(truth) == 1, F.col(prediction) == 1
    return df.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))


def rates(c: DataFrame) -> DataFrame:
    """accuracy, sensitivity, specificity, precision, recall and f1; 0 where undefined."""
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("tp", "fp", "fn", "tn", share(tp + tn, tp + tn + fp + fn).alias("accuracy"), share(tp, tp + fn).alias("sensitivity"), share(tn, tn + fp).alias("specificity"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def _running(by: DataFrame, score: str, sums: list[str], descending: bool, buckets: int = 256) -> DataFrame:
    """Add to rows of distinct scores, as ``<sum>_upto``, the sums over their own and all earlier scores; null scores come last
    when descending, else first.

    Approximate quantiles cut the scores into buckets; sums of whole buckets (at most ``buckets`` rows) come before
    those inside a bucket, so no task holds all scores and the result is exact."""
    bounds = by.agg(F.percentile_approx(score, [i / buckets for i in range(1, buckets)], 10000).alias("b")).first()["b"] or []
    cuts = F.array(*[F.lit(float(x)) for x in sorted(set(bounds))]).cast("array<double>")
    placed = by.withColumn("_b", F.coalesce(F.size(F.filter(cuts, lambda x: x <= F.col(score).cast("double"))), F.lit(0)))
    placed = placed.withColumn("_b", F.when(F.col(score).isNull(), -1).otherwise(F.col("_b")))
    turn = F.desc if descending else F.asc
    earlier = Window.orderBy(turn("_b")).rowsBetween(Window.unboundedPreceding, -1)
    whole = placed.groupBy("_b").agg(*[F.sum(c).alias(c) for c in sums]).select("_b", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in sums])
    own = Window.partitionBy("_b").orderBy(turn(score)).rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.withColumns({f"{c}_upto": F.sum(c).over(own) for c in sums}).join(F.broadcast(whole), "_b")  # a row per bucket
    return inside.withColumns({f"{c}_upto": F.col(f"{c}_upto") + F.col(f"_{c}") for c in sums}).drop("_b", *[f"_{c}" for c in sums])


def _by_score(df: DataFrame, truth: str, score: str) -> DataFrame:
    return df.groupBy(F.col(score).alias("threshold")).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) != 1).alias("n"))


def roc_points(df: DataFrame, truth: str, score: str) -> DataFrame:
    """threshold, tpr and fpr at every distinct score."""
    by = _by_score(df, truth, score)
    total = by.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    upto = _running(by, "threshold", ["p", "n"], descending=True).crossJoin(total)  # total is one row
    return upto.select("threshold", (F.col("p_upto") / F.col("all_p")).alias("tpr"), (F.col("n_upto") / F.col("all_n")).alias("fpr"))


def auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Area by trapezoids; null if a class is missing."""
    parts = _running(_by_score(df, truth, score), "threshold", ["n"], descending=False)
    return parts.agg(F.try_divide(F.sum(F.col("p") * (F.col("n_upto") - F.col("n") / 2)), F.sum("p") * F.sum("n")).alias("auc"))


def cross_entropy(truth: Column, probability: Column) -> Column:
    return -F.log(F.greatest(F.when(truth == 1, probability).otherwise(1 - probability), F.lit(1e-12)))


def focal_loss(truth: Column, probability: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    ce = cross_entropy(truth, probability)
    return alpha * F.pow(1 - F.exp(-ce), F.lit(gamma)) * ce


def class_weight(truth: Column, weights: dict[int, float]) -> Column:
    """The weight of a row's class, 1 where it has none."""
    out = F.lit(1.0)
    for label, w in weights.items():
        out = F.when(truth == label, float(w)).otherwise(out)
    return out


def loss(name: str, truth: Column, probability: Column, weights: dict[int, float] | None = None, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    """A row's loss by name: focal, weighted_ce (by class) or, for any other name, cross-entropy."""
    if name == "focal":
        return focal_loss(truth, probability, alpha, gamma)
    ce = cross_entropy(truth, probability)
    return class_weight(truth, weights or {}) * ce if name == "weighted_ce" else ce


def validate(df: DataFrame, truth: str, probability: str, name: str = "ce", weights: dict[int, float] | None = None) -> DataFrame:
    """One row: mean loss (of weighted_ce, by weight) and accuracy at 0.5; nulls for no rows."""
    t, p = F.col(truth), F.col(probability)
    weight = class_weight(t, weights or {}) if name == "weighted_ce" else F.lit(1.0)
    rows = df.select(loss(name, t, p, weights).alias("loss"), weight.alias("weight"), ((p >= 0.5) == (t == 1)).cast("double").alias("right"))
    return rows.agg(F.try_divide(F.sum("loss"), F.sum("weight")).alias("loss"), F.avg("right").alias("accuracy"))


def plateau_rates(values: list[float], top: float = 1e-4, factor: float = 0.5, patience: int = 5, threshold: float = 1e-4) -> list[float]:
    """The rate after each value of a measure that should grow: cut by ``factor`` after more than ``patience`` values in a row
    without a relative gain of ``threshold``."""
    rate, best, waited, out = top, float("-inf"), 0, []
    for v in values:
        best, waited = (v, 0) if v > best * (1 + threshold) else (best, waited + 1)
        if waited > patience:
            rate, waited = rate * factor, 0
        out.append(rate)
    return out


def cosine_rate(step: int, steps: int, top: float = 1e-4, low: float = 1e-6) -> float:
    return low + (top - low) * (1 + cos(pi * step / steps)) / 2


def features(df: DataFrame, image: str = "image", side: int = 8) -> DataFrame:
    """Add ``features``: the pixels of the image resized to side x side, scaled to [-1, 1]."""
    from pelagia.operators.images import apply_named

    small = apply_named(F.col(image), "resize", width=side, height=side)
    return df.withColumn("features", F.transform(small["data"], lambda v: (v - 0.5) / 0.5))
