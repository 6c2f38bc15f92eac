"""The error channel: a bad row is set aside with its reason, and the rows beside it go on.

A kernel under ``attempt`` returns struct<ok, error, value>. If it fails on a stack of images, its rows are tried one by one,
so that only those fail that must. A table with a column ``error`` is on the channel: ``step`` runs a kernel on the rows
without an error and notes the first one of each row, with the stage's name. ``settle`` writes such a table once, with the
good rows and the quarantine in partitions of their own, and counts both by an Observation.

Defined cases: a null image is an error ("no image"), not a crash; a row keeps its first error; an empty table settles
into two empty ones; reasons are cut at 200 characters."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.observation import Observation

from pelagia.operators.images import FILTERS, IMAGE, KERNELS, PIXELS

RESULT = f"struct<ok: boolean, error: string, value: {IMAGE}>"


def reason(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"[:200]


def _outcomes(images: pd.DataFrame, kernel: Callable, params: dict) -> list[tuple[str | None, np.ndarray | None]]:
    """(error, result) of each row."""
    out: list = [("no image", None)] * len(images)
    shapes: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
    for i, (h, w, d) in enumerate(zip(images["height"], images["width"], images["data"], strict=True)):
        if d is None or len(d) == 0:
            continue
        if len(d) != h * w:
            out[i] = (f"{len(d)} values for {int(h)} x {int(w)} pixels", None)
        else:
            shapes.setdefault((int(h), int(w)), []).append((i, np.asarray(d, float).reshape(int(h), int(w))))

    def tried(rows: list[tuple[int, np.ndarray]]) -> None:
        try:
            for (i, _), y in zip(rows, kernel(np.stack([x for _, x in rows]), **params), strict=True):
                out[i] = (None, y)
        except Exception as e:  # whatever a kernel raises is a row's reason
            if len(rows) == 1:
                out[rows[0][0]] = (reason(e), None)
            else:
                for row in rows:
                    tried([row])

    for (h, w), rows in shapes.items():
        each = max(1, PIXELS // (h * w))
        for a in range(0, len(rows), each):
            tried(rows[a : a + each])
    return out


def attempt(image: Column, kernel: Callable, **params) -> Column:
    """struct<ok, error, value> of a kernel on a packed image column."""

    def run(images: pd.DataFrame) -> pd.DataFrame:
        got = _outcomes(images, kernel, params)
        value = [None if y is None else {"height": y.shape[0], "width": y.shape[1], "data": y.ravel()} for _, y in got]
        return pd.DataFrame({"ok": [e is None for e, _ in got], "error": [e for e, _ in got], "value": value})

    return F.pandas_udf(run, RESULT)(image)


def attempt_filters(image: Column, filters: list[str] | None = None) -> Column:
    """array<struct<method, error, image>>: a filter that fails on an image leaves the others' results."""
    names = filters or list(FILTERS)

    def run(images: pd.DataFrame) -> pd.Series:
        each = {name: _outcomes(images, *FILTERS[name]) for name in names}
        item = lambda name, e, y: {"method": name, "error": e, "image": None if y is None else {"height": y.shape[0], "width": y.shape[1], "data": y.ravel()}}
        return pd.Series([[item(name, *each[name][i]) for name in names] for i in range(len(images))])

    return F.pandas_udf(run, f"array<struct<method: string, error: string, image: {IMAGE}>>")(image)


def channel(df: DataFrame) -> DataFrame:
    """df on the error channel."""
    return df.withColumn("error", F.lit(None).cast("string"))


def on_channel(df: DataFrame) -> bool:
    return "error" in df.columns


def step(df: DataFrame, stage: str, kernel: Callable | str, image: str = "image", **params) -> DataFrame:
    """The kernel (or that of this name) on the rows without an error."""
    if isinstance(kernel, str):
        kernel, defaults = (KERNELS | FILTERS)[kernel]
        params = defaults | params
    tried = df.withColumn("_r", attempt(F.when(F.col("error").isNull(), F.col(image)), kernel, **params))
    new = F.coalesce("error", F.when(~F.col("_r.ok"), F.concat(F.lit(f"{stage}: "), F.col("_r.error"))))
    return tried.withColumns({image: F.col("_r.value"), "error": new}).drop("_r")


def settle(df: DataFrame, path: str, image: str | None = "image") -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Write a table on the channel at path: its good rows, its quarantine (without images) and how many rows each has."""
    seen, spark = Observation(), df.sparkSession
    bad = F.col("error").isNotNull()
    cleared = {image: F.when(~bad, F.col(image))} if image else {}
    rows = df.withColumns(cleared | {"_ok": ~bad})
    rows = rows.observe(seen, F.count_if(~bad).alias("succeeded"), F.count_if(bad).alias("failed"))
    rows.write.mode("overwrite").partitionBy("_ok").parquet(path)
    written = spark.read.schema(rows.schema).parquet(path)
    return written.filter("_ok").drop("_ok", "error"), written.filter("not _ok").drop("_ok", *[c for c in (image,) if c]), seen.get
