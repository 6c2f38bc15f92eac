"""Sinks: tables, images, reports."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pelagia.sources.files import encode_png

RAW = "/data/raw/"


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def guarded(path: str) -> str:
    if RAW in path.replace("\\", "/"):
        raise PermissionError(f"raw data is read-only: {path}")
    return path


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """single gathers a small table into one file."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(guarded(path))


def write_text(text: str, path: str) -> None:
    store, at = _store(guarded(path))
    store.create_dir(at.rpartition("/")[0], recursive=True)
    with store.open_output_stream(at) as f:
        f.write(text.encode())


def save_json(value: object, path: str) -> None:
    write_text(json.dumps(value, indent=2), path)


def load_json(path: str) -> object:
    store, at = _store(path)
    with store.open_input_stream(at) as f:
        return json.loads(f.read())


def write_images(df: DataFrame, folder: str, name: str = "name", image: str = "image", scaled: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Write packed images as PNG files named by a column, by the executors; (name, path) of what was written, and the columns to keep.

    Values in [0, 1] (scaled) are rounded half to even to 8 bits, others clipped. A file gets its name when it is whole."""
    guarded(folder + "/")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done, at_row = [], []
            for row, (n, h, w, d) in enumerate(zip(b["name"], b["_h"], b["_w"], b["_d"], strict=True)):
                if d is None:
                    continue
                x = np.nan_to_num(np.asarray(d, float)).reshape(int(h), int(w))
                x = np.rint(np.clip(x, 0, 1) * 255) if scaled else np.clip(x, 0, 255)
                path = guarded(f"{folder}/{n}")
                store, at = _store(path)
                store.create_dir(at.rpartition("/")[0], recursive=True)
                with store.open_output_stream(at + ".part") as f:
                    f.write(encode_png(x))
                store.move(at + ".part", at)
                done.append((n, path))
                at_row.append(row)
            out = b[rest].iloc[at_row].reset_index(drop=True)
            yield pd.concat([pd.DataFrame(done, columns=["name", "path"], dtype=object), out], axis=1)

    rest = list(keep or [])
    rows = df.select(F.col(name).alias("name"), *[F.col(f"{image}.{c}").alias(f"_{c[0]}") for c in ("height", "width", "data")], *rest)
    schema = StructType([StructField("name", StringType()), StructField("path", StringType()), *[rows.schema[c] for c in rest]])
    return rows.mapInPandas(run, schema)


def class_folder(pathology: str = "standardized_pathology"):
    """benign or malignant; null (not written) for others."""
    return F.when(F.col(pathology) == "BENIGN", "benign").when(F.col(pathology) == "MALIGNANT", "malignant")
