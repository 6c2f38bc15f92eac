"""The filters, metrics and pixels as functions for spark.sql, by name and parameters.

    register(spark)
    spark.sql("select image_id, p.* from images, lateral pixels(denoise(noisy, 'median', '{\\"kernel_size\\": 3}')) p")

denoise(image, method, parameters)     a filter by name; parameters is a JSON object or null (the experiment's own)
transform_image(image, name, params)   a point or neighbourhood operator by name
image_metric(clean, other, name)       a metric by name (METRICS and MAE)
image_mse, image_mae, image_psnr, image_snr (clean, other)   the same in built-in functions, planned with the query
                                       (a ratio to no error is null)
pixels(image)                          a table function: pos, y, x, v of each pixel

Method and name may be columns. An unknown name fails and lists those there are. A null image or name gives null, and pixels
of it no row."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pelagia.operators.images import FILTERS, IMAGE, KERNELS, METRICS, _table, metric_values, stacks

#: Pair metrics as SQL: what a query that uses them is planned with.
_DIFFERENCE = "aggregate(zip_with(a.data, b.data, (x, y) -> {}), 0D, (s, v) -> s + v)"
_SQUARES = _DIFFERENCE.format("(x - y) * (x - y)")
BUILT_IN = {
    "image_mse": f"try_divide({_SQUARES}, size(a.data))",
    "image_mae": f"try_divide({_DIFFERENCE.format('abs(x - y)')}, size(a.data))",
    "image_psnr": f"10 * log10(try_divide(size(a.data), {_SQUARES}))",
    "image_snr": f"10 * log10(try_divide(aggregate(a.data, 0D, (s, v) -> s + v * v), {_SQUARES}))",
}


def _named(table: dict):
    def run(images: pd.DataFrame, names: pd.Series, params: pd.Series) -> pd.DataFrame:
        out: list = [None] * len(images)
        ask = pd.DataFrame({"name": names, "params": params.fillna("{}")}).reset_index(drop=True)
        for (name, text), rows in ask[ask["name"].notna()].groupby(["name", "params"]).groups.items():
            if name not in table:
                raise ValueError(f"{name} is none of {', '.join(sorted(table))}")
            kernel, defaults = table[name]
            given = {k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(text).items()}
            part = images.iloc[rows].reset_index(drop=True)
            for at, x in stacks(part):
                for i, y in zip(at, kernel(x, **(defaults | given)), strict=True):
                    out[rows[i]] = y
        return _table(out)

    return F.pandas_udf(run, IMAGE)


def _metric(a: pd.DataFrame, b: pd.DataFrame, names: pd.Series) -> pd.Series:
    out = pd.Series(np.nan, index=range(len(a)))
    names = names.reset_index(drop=True)
    for name, rows in names[names.notna()].groupby(names).groups.items():
        if name not in (*METRICS, "MAE"):
            raise ValueError(f"{name} is none of {', '.join([*METRICS, 'MAE'])}")
        for at, x in stacks(a.iloc[rows].reset_index(drop=True)):
            y = np.stack([np.asarray(b["data"].iloc[rows[i]], float) for i in at]).reshape(x.shape)
            out.iloc[rows[at]] = metric_values(x, y, [name])[name]
    return out


class Pixels:
    def eval(self, image) -> Iterator[tuple]:
        if image is not None and image["data"] is not None:
            for pos, v in enumerate(image["data"]):
                yield pos, pos // image["width"], pos % image["width"], v


def register(spark: SparkSession) -> list[str]:
    """Register all of them with the session; their names."""
    metric = F.pandas_udf(_metric, "double")
    for name, f in (("denoise", _named(FILTERS)), ("transform_image", _named(KERNELS)), ("image_metric", metric)):
        spark.udf.register(name, f)
    spark.udtf.register("pixels", F.udtf(Pixels, returnType="pos int, y int, x int, v double"))
    for name, body in BUILT_IN.items():
        spark.sql(f"create or replace temporary function {name}(a {IMAGE.replace(': ', ':')}, b {IMAGE.replace(': ', ':')}) returns double return {body}")
    return ["denoise", "transform_image", "image_metric", "pixels", *BUILT_IN]
