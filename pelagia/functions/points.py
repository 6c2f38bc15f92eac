"""Point operators and pair metrics of packed images in built-in functions: nothing goes to Python.

Each gives the values of the kernel of the same name in ``pixels``. Values that belong to a whole image (its range, its
percentiles) are evaluated once, by ``let``, and not for every pixel.

Defined cases: a null image gives null; NaN and -inf count as 0 and +inf as 1 where a kernel cleans; an image without range
becomes what the kernel says; images of a pair with different numbers of pixels have null metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-7


def let(body, **values: Column) -> Column:
    """body of a struct of the values, each of which is evaluated once and not for every pixel."""
    return F.element_at(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), 1)


def with_data(image: Column, data: Column) -> Column:
    """The image with other pixels of the same shape; null for a null image."""
    return F.when(image["data"].isNotNull(), F.struct(image["height"].alias("height"), image["width"].alias("width"), data.alias("data")))


def finite(v: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """NaN as 0, -inf as low, +inf as high."""
    return F.when(F.isnan(v), 0.0).when(v == float("inf"), high).when(v == float("-inf"), low).otherwise(v)


def clipped(v: Column, low: Column | float = 0.0, high: Column | float = 1.0) -> Column:
    as_col = lambda c: F.lit(c) if isinstance(c, float) else c
    return F.least(F.greatest(v, as_col(low)), as_col(high))


def clean(data: Column) -> Column:
    return F.transform(data, lambda v: clipped(finite(v)))


def total(data: Column) -> Column:
    return F.aggregate(data, F.lit(0.0), lambda a, v: a + v)


def percentile(ordered: Column, p: float) -> Column:
    """Of an ascending array, linear between two values."""
    at = (F.size(ordered) - 1) * (p / 100)
    low = F.floor(at).cast("int")
    a, b = F.element_at(ordered, low + 1), F.element_at(ordered, F.least(low + 2, F.size(ordered)))
    return a + (b - a) * (at - low)


# --- point operators -----------------------------------------------------------------------------------------------


def _scaled(image: Column, data: Column, low, high, flat, target_min: float, target_max: float, when_flat) -> Column:
    """(v - low) / (high - low) to the target range; low and high are of the image's pixels and of them in order."""

    def within(p: Column) -> Column:
        one = lambda v: target_min + (clipped(v, p["lo"], p["hi"]) - p["lo"]) / (p["hi"] - p["lo"]) * (target_max - target_min)
        return F.transform(p["d"], lambda v: F.when(flat(p["lo"], p["hi"]), when_flat(v)).otherwise(one(v)))

    ranged = lambda p: let(within, d=p["d"], lo=low(p["d"]), hi=high(p["d"]))
    return with_data(image, let(ranged, d=data))


def normalize_image(image: Column, target_min: float = 0.0, target_max: float = 1.0) -> Column:
    data = F.transform(image["data"], lambda v: finite(v, target_min, target_max))
    return _scaled(image, data, F.array_min, F.array_max, lambda lo, hi: hi - lo <= EPS, target_min, target_max, lambda v: F.lit(target_min))


def min_max_normalize(image: Column, target_min: float = 0.0, target_max: float = 1.0) -> Column:
    return _scaled(image, image["data"], F.array_min, F.array_max, lambda lo, hi: hi == lo, target_min, target_max, lambda v: F.lit(0.0))


def robust_min_max_normalize(image: Column, p_low: float = 1.0, p_high: float = 99.0, target_min: float = 0.0, target_max: float = 1.0) -> Column:
    low, high = (lambda d, p=p: let(lambda o: percentile(o["o"], p), o=F.array_sort(d)) for p in (p_low, p_high))
    return _scaled(image, image["data"], low, high, lambda lo, hi: hi == lo, target_min, target_max, lambda v: F.lit(0.0))


def stretch_contrast(image: Column, lower: float = 2.0, upper: float = 98.0) -> Column:
    if not 0 <= lower < upper <= 100:
        raise ValueError("percentiles must satisfy 0 <= lower < upper <= 100")
    low, high = (lambda d, p=p: let(lambda o: percentile(o["o"], p), o=F.array_sort(d)) for p in (lower, upper))
    return _scaled(image, clean(image["data"]), low, high, lambda lo, hi: hi - lo <= EPS, 0.0, 1.0, lambda v: v)


def z_score_normalize(image: Column) -> Column:
    def centred(p: Column) -> Column:
        var = F.aggregate(p["d"], F.lit(0.0), lambda a, v: a + (v - p["m"]) * (v - p["m"])) / F.size(p["d"])
        return let(lambda q: F.transform(q["d"], lambda v: F.when(q["s"] == 0, 0.0).otherwise((v - q["m"]) / q["s"])), d=p["d"], m=p["m"], s=F.sqrt(var))

    return with_data(image, let(centred, d=image["data"], m=F.try_divide(total(image["data"]), F.size(image["data"]))))


def quantize(image: Column) -> Column:
    """8 bits, half to even."""
    return with_data(image, F.transform(image["data"], lambda v: F.rint(clipped(finite(v)) * 255)))


def truncate(image: Column) -> Column:
    """8 bits, cut off."""
    return with_data(image, F.transform(image["data"], lambda v: F.floor(clipped(finite(v)) * 255).cast("double")))


def suppress_corner(image: Column, fraction: float = 0.4) -> Column:
    """0 in the upper left triangle of that share of the height and the width."""

    def cut(p: Column) -> Column:
        mh, mw = F.floor(p["h"] * fraction), F.floor(p["w"] * fraction)
        return F.transform(p["d"], lambda v, i: F.when(i % p["w"] * mh + F.floor(i / p["w"]) * mw <= mw * mh, 0.0).otherwise(v))

    return with_data(image, let(cut, d=image["data"], h=image["height"], w=image["width"]))


def anscombe(image: Column, scale: float = 1.0) -> Column:
    return with_data(image, F.transform(image["data"], lambda v: 2 * F.sqrt(F.greatest(v * scale, F.lit(0.0)) + 0.375)))


def inverse_anscombe(image: Column, scale: float = 1.0) -> Column:
    return with_data(image, F.transform(image["data"], lambda v: F.greatest((v / 2) * (v / 2) - 0.375, F.lit(0.0)) / scale))


# --- metrics of a pair ---------------------------------------------------------------------------------------------


def _sum(a: Column, b: Column, f) -> Column:
    """Of f over the pixels of two images; null if their shapes differ."""
    same = (a["height"] == b["height"]) & (a["width"] == b["width"]) & (F.size(a["data"]) == F.size(b["data"]))
    return F.when(same, total(F.zip_with(a["data"], b["data"], lambda x, y: f(finite(x), finite(y)))))


def mse(a: Column, b: Column) -> Column:
    return F.try_divide(_sum(a, b, lambda x, y: (x - y) * (x - y)), F.size(a["data"]))


def mae(a: Column, b: Column) -> Column:
    return F.try_divide(_sum(a, b, lambda x, y: F.abs(x - y)), F.size(a["data"]))


def psnr(a: Column, b: Column, data_range: float | None = None) -> Column:
    """Without a range: 1 for an image within [-.05, 1.05], else the larger of 1 and its range."""
    if data_range is not None and data_range <= 0:
        raise ValueError("the data range must be positive")

    def ratio(p: Column) -> Column:
        usual = (p["lo"] >= -0.05) & (p["hi"] <= 1.05)
        r = F.lit(data_range) if data_range is not None else F.when(usual, 1.0).otherwise(F.greatest(p["hi"] - p["lo"], F.lit(1.0)))
        return F.when(p["e"] == 0, float("inf")).otherwise(10 * F.log10(r * r / p["e"]))

    values = F.transform(a["data"], lambda v: finite(v))
    return let(ratio, e=mse(a, b), lo=F.array_min(values), hi=F.array_max(values))


def snr(a: Column, b: Column) -> Column:
    """Signal to error in dB: infinite without an error, 0 without a signal."""
    power, error = _sum(a, b, lambda x, y: x * x), _sum(a, b, lambda x, y: (x - y) * (x - y))
    return let(lambda p: F.when(p["e"] == 0, float("inf")).when(p["s"] == 0, 0.0).otherwise(10 * F.log10(p["s"] / p["e"])), s=power, e=error)
