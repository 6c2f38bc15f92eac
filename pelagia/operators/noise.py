"""Five noise models on packed images.

Uniform numbers are a function of seed, image and pixel (an md5 counter), so a result does not depend on partitions,
retries or engine. Gaussian, impulse and speckle noise are built-in expressions; Poisson counts invert the distribution at
such numbers.
"""

from __future__ import annotations

from math import pi

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pelagia.functions.points import let
from pelagia.operators.images import IMAGE, _table, stacks

MODELS = {
    "gaussian": {"mean": 0.0, "var": 0.01},
    "salt_pepper": {"amount": 0.04, "salt_vs_pepper": 0.5},
    "speckle": {"var": 0.04},
    "poisson": {"scale": 255.0},
    "mixed_poisson_gaussian": {"poisson_scale": 255.0, "gaussian_var": 0.005},
}


def uniform(image_id: Column, pos: Column, seed: int, stream: str = "") -> Column:
    """In [0, 1): the first 32 bits of md5(seed-image-position[stream])."""
    text = F.concat(F.lit(f"{seed}-"), image_id.cast("string"), F.lit("-"), pos.cast("string"), F.lit(stream))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def normal(image_id: Column, pos: Column, seed: int) -> Column:
    """Standard normal by Box and Muller."""
    u, v = uniform(image_id, pos, seed, "a"), uniform(image_id, pos, seed, "b")
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * pi * v)


def _each(image: Column, f) -> Column:
    clip = lambda v: F.greatest(F.least(v, F.lit(1.0)), F.lit(0.0))
    return F.struct(image["height"].alias("height"), image["width"].alias("width"), F.transform(image["data"], lambda v, i: clip(f(v, i))).alias("data"))


def _draw(draws: Column | None, image_id: Column, i: Column, seed: int, of) -> Column:
    return of(image_id, i, seed) if draws is None else F.get(draws, i)


def add_gaussian_noise(image: Column, image_id: Column, mean: float = 0.0, var: float = 0.01, seed: int = 42, draws: Column | None = None) -> Column:
    """draws: the pixels' normal numbers (salt and pepper: uniform ones), where they have been made already."""
    return _each(image, lambda v, i: v + mean + max(var, 0.0) ** 0.5 * _draw(draws, image_id, i, seed, normal))


def add_salt_pepper_noise(image: Column, image_id: Column, amount: float = 0.04, salt_vs_pepper: float = 0.5, seed: int = 42, draws: Column | None = None) -> Column:
    def one(v: Column, i: Column) -> Column:
        u = _draw(draws, image_id, i, seed, uniform)
        return F.when(u < amount * salt_vs_pepper, 1.0).when(u > 1 - amount * (1 - salt_vs_pepper), 0.0).otherwise(v)

    return _each(image, one)


def add_speckle_noise(image: Column, image_id: Column, var: float = 0.04, seed: int = 42, draws: Column | None = None) -> Column:
    return _each(image, lambda v, i: v + v * var**0.5 * _draw(draws, image_id, i, seed, normal))


#: Largest mean whose distribution is inverted from 0 on: e ** -700 is still a normal number.
INVERTED = 700


def poisson_counts(mean: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The smallest count of each pixel whose cumulative probability is above u: work for as many counts as there are."""
    counts = np.zeros(mean.size)
    left = np.arange(mean.size)
    m, u = mean.ravel(), u.ravel()
    p = np.exp(-m)
    total, k = p.copy(), 0
    while True:
        on = (u[left] >= total) & (p > 0)
        left, p, total = left[on], p[on], total[on]
        if not len(left):
            return counts.reshape(mean.shape)
        k += 1
        p = p * m[left] / k
        total = total + p
        counts[left] = k


def add_poisson_noise(image: Column, image_id: Column, scale: float = 255.0, seed: int = 42) -> Column:
    """Counts of mean value * scale, over scale. Up to a scale of INVERTED they come from the distribution and the counter's
    uniform numbers, so that any engine can make them; above, from a generator keyed by seed and image."""

    def inverted(images: pd.DataFrame, uniforms: pd.Series) -> pd.DataFrame:
        out: list = [None] * len(images)
        for at, x in stacks(images):
            u = np.stack([np.asarray(uniforms.iloc[i], float) for i in at]).reshape(x.shape)
            for i, y in zip(at, np.clip(poisson_counts(np.maximum(x * scale, 0), u) / scale, 0, 1), strict=True):
                out[i] = y
        return _table(out)

    def drawn(images: pd.DataFrame, ids: pd.Series) -> pd.DataFrame:
        out: list = [None] * len(images)
        for at, x in stacks(images):
            for i, y in zip(at, x, strict=True):
                r = np.random.Generator(np.random.Philox(key=[seed, int(ids.iloc[i]) & (2**64 - 1)]))
                out[i] = np.clip(r.poisson(np.maximum(y * scale, 0)) / scale, 0, 1)
        return _table(out)

    if scale > INVERTED:
        return F.pandas_udf(drawn, IMAGE)(image, F.xxhash64(image_id))
    return F.pandas_udf(inverted, IMAGE)(image, F.transform(image["data"], lambda _, i: uniform(image_id, i, seed, "p")))


def add_mixed_noise(image: Column, image_id: Column, poisson_scale: float = 255.0, gaussian_var: float = 0.005, seed: int = 42) -> Column:
    return add_gaussian_noise(add_poisson_noise(image, image_id, poisson_scale, seed), image_id, 0.0, gaussian_var, seed)


ADD = {
    "gaussian": add_gaussian_noise,
    "salt_pepper": add_salt_pepper_noise,
    "speckle": add_speckle_noise,
    "poisson": add_poisson_noise,
    "mixed_poisson_gaussian": add_mixed_noise,
}


def all_models(image: Column, image_id: Column, seed: int = 42, models: list[str] | None = None) -> Column:
    """array<struct<noise_type, image>> of the five models (or those named), all with the same seed.

    Models share their random numbers and their Poisson counts, so each is made once for an image and not for each model."""
    models = list(models or MODELS)
    over = lambda of: F.transform(image["data"], lambda _, i: of(image_id, i, seed))
    draws = {"gaussian": "normals", "speckle": "normals", "salt_pepper": "uniforms"}
    scales = {k: MODELS[k][p] for k, p in (("poisson", "scale"), ("mixed_poisson_gaussian", "poisson_scale")) if k in models}
    once = {"image": image} | {f"counts_{s}": add_poisson_noise(image, image_id, s, seed) for s in dict.fromkeys(scales.values())}
    if {"gaussian", "speckle", "mixed_poisson_gaussian"} & set(models):
        once["normals"] = over(normal)
    if "salt_pepper" in models:
        once["uniforms"] = over(uniform)

    def made(p: Column) -> Column:
        def one(k: str) -> Column:
            if k in draws:
                return ADD[k](p["image"], image_id, **MODELS[k], seed=seed, draws=p[draws[k]])
            counts = p[f"counts_{scales[k]}"]
            return counts if k == "poisson" else add_gaussian_noise(counts, image_id, 0.0, MODELS[k]["gaussian_var"], seed, p["normals"])

        return F.array(*[F.struct(F.lit(k).alias("noise_type"), one(k).alias("image")) for k in models])

    return let(made, **once)


def realism(clean: Column, noisy: Column, noise_type: Column) -> Column:
    """struct<no_nan, in_range, changed, impulses, passed>: whether a noisy image is what its model should give."""
    d, c = noisy["data"], clean["data"]
    n = F.size(d)
    no_nan = F.forall(d, lambda v: ~F.isnan(v))
    in_range = (F.array_min(d) >= 0) & (F.array_max(d) <= 1)
    changed = F.aggregate(F.zip_with(c, d, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x) / n >= 1e-6
    impulses = (noise_type != "salt_pepper") | F.exists(d, lambda v: (v == 0) | (v == 1))
    return F.struct(no_nan.alias("no_nan"), in_range.alias("in_range"), changed.alias("changed"), impulses.alias("impulses"), (no_nan & in_range & changed & impulses & (n == F.size(c))).alias("passed"))
