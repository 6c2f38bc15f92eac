"""Images as packed columns struct<height, width, data>, and kernels applied to them.

An image is one row, so every kernel is local: no shuffle at any size. Kernels see stacks of images of one shape.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.functions import pixels

IMAGE = "struct<height: int, width: int, data: array<double>>"
#: Pixels of a stack, if it has more than one image: a 9 x 9 neighbourhood of each, in doubles, takes 10 MB.
PIXELS = 1 << 14

#: Partitions for each core: a table of images with fewer is dealt out evenly before costly work.
SPREAD = 4

#: name -> (kernel, default parameters): point and neighbourhood operators on one image.
KERNELS: dict[str, tuple[Callable, dict]] = {
    "normalize_minmax": (pixels.normalize_image, {}),
    "min_max": (pixels.min_max_normalize, {}),
    "normalize_robust": (pixels.robust_min_max_normalize, {}),
    "normalize_zscore": (pixels.z_score_normalize, {}),
    "stretch_contrast": (pixels.stretch_contrast, {}),
    "hist_equalize": (pixels.histogram_equalize, {}),
    "clahe": (pixels.clahe, {}),
    "quantize_u8": (pixels.quantize, {}),
    "truncate_u8": (pixels.truncate, {}),
    "resize": (pixels.resize, {"width": 512, "height": 512}),
    "corner_suppress": (pixels.suppress_corner, {}),
    "segment_breast": (pixels.segment_breast, {}),
    "unsharp_mask": (pixels.unsharp_mask, {}),
    "laplacian_sharpen": (pixels.laplacian_sharpen, {}),
}

#: The eight filters of the experiment with the parameters that its configuration gives them.
FILTERS: dict[str, tuple[Callable, dict]] = {
    "median": (pixels.denoise_median, {"kernel_size": 5}),
    "gaussian": (pixels.denoise_gaussian, {"kernel_size": (5, 5), "sigma": 1.0}),
    "wiener": (pixels.denoise_wiener, {"size": (5, 5), "noise": None}),
    "bilateral": (pixels.denoise_bilateral, {"d": 9, "sigma_color": 75.0, "sigma_space": 75.0}),
    "non_local_means": (pixels.denoise_nlm, {"h": 0.1, "template": 7, "search": 21}),
    "anscombe_wiener": (pixels.denoise_anscombe_wiener, {"sigma": 1.0, "compat": False}),
    "adaptive_median": (pixels.denoise_adaptive_median, {"max_window_size": 7}),
    "kuan": (pixels.denoise_kuan, {"window_size": 7, "noise_var": 0.04, "damping": 1.0}),
}

#: Labels of the hardware each filter's reference run used; others are CPU.
HARDWARE = {"gaussian": "GPU", "kuan": "GPU"}


def pack(data: Column, height: Column | int, width: Column | int) -> Column:
    as_int = lambda x: (F.lit(x) if isinstance(x, int) else x).cast("int")
    return F.struct(as_int(height).alias("height"), as_int(width).alias("width"), data.cast("array<double>").alias("data"))


def spread(df: DataFrame) -> DataFrame:
    """df in at least SPREAD partitions for each core: its files and their row groups need not be even, or many."""
    least = SPREAD * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(least) if df.rdd.getNumPartitions() < least else df


def stacks(images: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, stack) for each shape in a batch, of about PIXELS pixels; rows without pixels are left out."""
    ok = np.array([d is not None and len(d) > 0 for d in images["data"]], bool)
    shape = pd.Series(list(zip(images["height"], images["width"], strict=True)))
    for (h, w), rows in shape[ok].groupby(shape[ok]).groups.items():
        each = max(1, PIXELS // max(1, int(h) * int(w)))
        for a in range(0, len(rows), each):
            at = np.asarray(rows[a : a + each])
            yield at, np.stack([np.asarray(images["data"].iloc[i], float) for i in at]).reshape(len(at), int(h), int(w))


def _table(out: list) -> pd.DataFrame:
    none = (None, None, None)
    rows = [none if x is None else (x.shape[0], x.shape[1], x.ravel()) for x in out]
    return pd.DataFrame(rows, columns=["height", "width", "data"]).astype({"height": "Int32", "width": "Int32"})


def apply(image: Column, kernel: Callable, **params) -> Column:
    """A kernel on a packed image column; a null image gives nulls."""

    def run(images: pd.DataFrame) -> pd.DataFrame:
        out: list = [None] * len(images)
        for at, x in stacks(images):
            for i, y in zip(at, kernel(x, **params), strict=True):
                out[i] = y
        return _table(out)

    return F.pandas_udf(run, IMAGE)(image)


def apply_named(image: Column, name: str, **params) -> Column:
    kernel, defaults = (KERNELS | FILTERS)[name]
    return apply(image, kernel, **(defaults | params))


def apply_filters(image: Column, filters: list[str] | None = None) -> Column:
    """array<struct<method, image>>: several filters in one pass over the image."""
    names = filters or list(FILTERS)

    def run(images: pd.DataFrame) -> pd.Series:
        out: list = [[] for _ in range(len(images))]
        for at, x in stacks(images):
            for name in names:
                kernel, params = FILTERS[name]
                for i, y in zip(at, kernel(x, **params), strict=True):
                    out[i].append({"method": name, "image": {"height": y.shape[0], "width": y.shape[1], "data": y.ravel()}})
        return pd.Series(out)

    return F.pandas_udf(run, f"array<struct<method: string, image: {IMAGE}>>")(image)


def crop(image: Column, mask: Column, margin: int = 10) -> Column:
    """The image within the mask's bounding box and a margin; unchanged for an empty mask."""

    def run(images: pd.DataFrame, masks: pd.DataFrame) -> pd.DataFrame:
        out: list = [None] * len(images)
        for at, x in stacks(images):
            for i, y in zip(at, x, strict=True):
                t, b, left, right = pixels.bounding_box(np.asarray(masks["data"].iloc[i], float).reshape(y.shape) > 0, margin)
                out[i] = y[t:b, left:right]
        return _table(out)

    return F.pandas_udf(run, IMAGE)(image, mask)


METRICS = ["MSE", "PSNR", "SSIM", "SNR", "CNR", "CII", "Entropy"]


def metric_values(x: np.ndarray, y: np.ndarray, names: list[str], masks: list[np.ndarray | None] | None = None, radius: int = 15, known: dict | None = None) -> dict[str, np.ndarray]:
    """The named metrics of two stacks of images, no others.

    Regions of CNR and CII are each image's own, by Otsu; with masks (one or None for each pair) they are the same pixels
    of both images, fixed by the clean one: the lesion and the tissue in a ring around it, or the clean image's own
    regions where a mask is missing or empty. known: what is found out about x and its masks is kept there, for the next y."""
    made = {"MSE": lambda: pixels.mse(x, y), "PSNR": lambda: pixels.psnr(x, y), "SSIM": lambda: pixels.ssim(x, y), "SNR": lambda: pixels.snr(x, y), "Entropy": lambda: pixels.entropy(y), "MAE": lambda: pixels.mae(x, y)}
    found: dict = {k: made[k]() for k in names if k in made}
    if "CNR" in names or "CII" in names:
        known = {} if known is None else known
        if "regions" not in known and (masks is not None or "CII" in names):
            known["regions"] = _clean_regions(x, masks, radius)
        regions = pixels.otsu_regions(y) if masks is None else known["regions"]
        if "CNR" in names:
            found["CNR"] = pixels.stack_cnr(y, *regions)
        if "CII" in names:
            if "contrast" not in known:
                known["contrast"] = pixels.stack_contrast(x, *known["regions"])
            found["CII"] = pixels.stack_cii(pixels.stack_contrast(y, *regions), known["contrast"])
    return found


def _clean_regions(x: np.ndarray, masks: list[np.ndarray | None] | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    roi, bg = pixels.otsu_regions(x)
    for i, m in enumerate(masks or []):
        if m is not None and m.any():
            roi[i], bg[i] = pixels.ring_regions(x[i], m, radius=radius)
    return roi, bg


def metrics(clean: Column, other: Column, names: list[str] | None = None, mask: Column | None = None, radius: int = 15) -> Column:
    """struct of METRICS and MAE (or of those named) for a pair of images; regions as metric_values says. mask: packed images
    of the clean image's shape, a lesion's pixels above 0; null where there is none."""
    names = names or [*METRICS, "MAE"]

    def run(a: pd.DataFrame, b: pd.DataFrame, m: pd.DataFrame | None = None) -> pd.DataFrame:
        out = pd.DataFrame(np.nan, index=range(len(a)), columns=names)
        for at, x in stacks(a):
            y = np.stack([np.asarray(b["data"].iloc[i], float) for i in at])
            if y[0].size != x[0].size:
                raise ValueError("images differ in shape")
            masks = None if m is None else [_mask(m.iloc[i], x.shape[1:]) for i in at]
            for k, v in metric_values(x, y.reshape(x.shape), names, masks, radius).items():
                out.loc[at, k] = v
        return out

    schema = ", ".join(f"{n} double" for n in names)
    if mask is None:

        def two(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            return run(a, b)

        return F.pandas_udf(two, schema)(clean, other)

    def three(a: pd.DataFrame, b: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        return run(a, b, m)

    return F.pandas_udf(three, schema)(clean, other, mask)


class Packed:
    """A batch of packed images as Arrow gives them: shapes, and all pixels one after the other."""

    def __init__(self, images: pa.StructArray):
        fields = dict(zip((f.name for f in images.type), images.flatten(), strict=True))
        self.shapes = np.stack([fields[k].fill_null(0).to_numpy(zero_copy_only=False) for k in ("height", "width")], 1).astype(int)
        self.begin, end = (o.to_numpy() for o in (fields["data"].offsets[:-1], fields["data"].offsets[1:]))
        self.sizes = np.where(fields["data"].is_valid().to_numpy(zero_copy_only=False), end - self.begin, 0)
        self.flat = fields["data"].values.to_numpy(zero_copy_only=False).astype(float, copy=False)

    def stack(self, rows: np.ndarray, height: int, width: int) -> np.ndarray:
        """Images of one shape."""
        if (self.sizes[rows] != height * width).any():
            raise ValueError("images differ in shape")
        return self.flat[self.begin[rows][:, None] + np.arange(height * width)].reshape(len(rows), height, width)

    def stacks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """As stacks()."""
        ok = np.flatnonzero(self.sizes > 0)
        shapes, which = np.unique(self.shapes[ok], axis=0, return_inverse=True)
        for k, (h, w) in enumerate(shapes.tolist()):
            rows, each = ok[which.ravel() == k], max(1, PIXELS // max(1, h * w))
            for a in range(0, len(rows), each):
                yield rows[a : a + each], self.stack(rows[a : a + each], h, w)

    def mask(self, i: int, shape: tuple[int, int]) -> np.ndarray | None:
        return _mask({"height": self.shapes[i][0], "width": self.shapes[i][1], "data": self.flat[self.begin[i] : self.begin[i] + self.sizes[i]] if self.sizes[i] else None}, shape)


def filter_metrics(clean: Column, noisy: Column, filters: list[str] | None = None, mask: Column | None = None, radius: int = 15) -> Column:
    """array<struct<method, error, METRICS>>: filters on a noisy image and the metrics of each result against the clean one,
    in one pass; no filtered image leaves the worker. What raises on a stack is tried image by image; an image on which a
    filter or its metrics raise has the reason as that method's error, and null metrics. A metric that is NaN is null."""
    names = filters or list(FILTERS)

    def run(a: pa.Array, b: pa.Array, m: pa.Array | None) -> pa.Array:
        ours, theirs, given = Packed(a), Packed(b), None if m is None else Packed(m)
        values, errors = np.full((len(METRICS), len(a), len(names)), np.nan), np.full((len(a), len(names)), None, object)

        def tried(method: int, at: np.ndarray, x: np.ndarray, y: np.ndarray, known: dict) -> None:
            kernel, params = FILTERS[names[method]]
            try:
                masks = None if given is None else [given.mask(i, x.shape[1:]) for i in at]
                found = metric_values(x, kernel(y, **params), METRICS, masks, radius, known)
                for k, metric in enumerate(METRICS):
                    values[k, at, method] = found[metric]
            except Exception as e:  # whatever a kernel raises is an image's reason
                if len(at) > 1:
                    for j in range(len(at)):
                        tried(method, at[j : j + 1], x[j : j + 1], y[j : j + 1], {})
                    return
                values[:, at, method] = np.nan
                errors[at, method] = f"{type(e).__name__}: {e}"[:200]

        for at, x in ours.stacks():
            y, known = theirs.stack(at, *x.shape[1:]), {}
            for method in range(len(names)):
                tried(method, at, x, y, known)
        some = ours.sizes > 0
        ends = np.concatenate([[0], np.cumsum(some * len(names))]).astype(np.int32)
        columns = [pa.array(names * int(some.sum()), pa.string()), pa.array(errors[some].ravel(), pa.string())]
        columns += [pa.array(v[some].ravel(), mask=np.isnan(v[some].ravel())) for v in values]
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, ["method", "error", *METRICS]))

    schema = f"array<struct<method: string, error: string, {', '.join(f'{k}: double' for k in METRICS)}>>"
    if mask is None:

        def two(a: pa.Array, b: pa.Array) -> pa.Array:
            return run(a, b, None)

        return F.arrow_udf(two, schema)(clean, noisy)

    def three(a: pa.Array, b: pa.Array, m: pa.Array) -> pa.Array:
        return run(a, b, m)

    return F.arrow_udf(three, schema)(clean, noisy, mask)


def _mask(row: pd.Series | dict, shape: tuple[int, int]) -> np.ndarray | None:
    if row["data"] is None:
        return None
    if (row["height"], row["width"]) != shape:
        raise ValueError(f"a mask of {row['height']} x {row['width']} for an image of {shape[0]} x {shape[1]}")
    return np.asarray(row["data"], float).reshape(shape) > 0


def with_masks(df: DataFrame, masks: DataFrame, path: str = "resolved_roi_mask_path", out: str = "mask") -> DataFrame:
    """df with the decoded mask of each record's path; null where there is none. masks: path, image; of a repeated path one."""
    one = masks.groupBy(F.col("path").alias(path)).agg(F.any_value("image").alias(out))
    return df.join(one, path, "left")


def statistics(image: Column) -> Column:
    """struct<width, height, channels, min, max, mean, std> in built-in functions."""
    d = image["data"]
    n = F.size(d)
    mean = F.aggregate(d, F.lit(0.0), lambda a, x: a + x) / n
    var = F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x) / n - mean * mean
    return F.struct(image["width"].alias("width"), image["height"].alias("height"), F.lit(1).alias("channels"), F.array_min(d).alias("min"), F.array_max(d).alias("max"), mean.alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("std"))


def validity(image: Column) -> Column:
    """struct of flags and ``is_valid``: not empty, no NaN or infinity, not constant."""
    d = image["data"]
    filled = F.coalesce(F.size(d) > 0, F.lit(False))
    finite = F.coalesce(F.forall(d, lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    varied = F.coalesce(F.array_min(d) < F.array_max(d), F.lit(False))
    return F.struct(filled.alias("filled"), finite.alias("finite"), varied.alias("varied"), (filled & finite & varied).alias("is_valid"))


def long(df: DataFrame, image: str = "image", keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """A row per pixel: keys, pos, v; none for an image that is null or has no pixels.

    Outer, and then without the empty ones: before a plain posexplode Spark filters by the array's size, at the scan and in
    terms of the scan's columns, so that a computed image is made twice, the first time before it is dealt out."""
    return df.select(*keys, F.posexplode_outer(f"{image}.data").alias("pos", "v")).filter("pos is not null")
