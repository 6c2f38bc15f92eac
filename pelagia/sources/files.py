"""Sources: case tables, file inventories, images, configuration."""

from __future__ import annotations

import struct
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pelagia.operators.images import IMAGE, _table

#: File names of the six-table bundle.
BUNDLE = {
    "mass_train": "mass_case_description_train_set.csv",
    "mass_test": "mass_case_description_test_set.csv",
    "calc_train": "calc_case_description_train_set.csv",
    "calc_test": "calc_case_description_test_set.csv",
    "dicom_info": "dicom_info.csv",
    "meta": "meta.csv",
}
IMAGES = "*.{jpg,jpeg,png,JPG,JPEG,PNG}"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def read_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


#: The columns of a row's place in its files.
PLACE = "_place"


def placed(df: DataFrame, table: int = 0) -> DataFrame:
    """df, as read from files, with where each row stands: PLACE, a struct that sorts in the order of the table's number, the
    files' names, the blocks and the rows. Only the order of its last field has a meaning: within a block rows are
    counted by the task that reads the block, so that partitions of other sizes give the same order.

    Must be called on a table straight from its files, before any shuffle."""
    m = F.col("_metadata")
    return df.withColumn(PLACE, F.struct(F.lit(table).alias("table"), m["file_path"].alias("file"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("row")))


def head(df: DataFrame, n: int) -> DataFrame:
    """The first n rows of a placed() table in the order of its files: each task keeps n."""
    return df.orderBy(PLACE).limit(n)


#: Rows of a run, of which each is ranked on its own, are at most 2 ** RUN.
RUN = 16


def numbered(df: DataFrame, out: str = "ordinal") -> DataFrame:
    """A placed() table with each row's number, from 0, in the order of its files. Blocks are cut into runs of rows; runs are
    counted and added up (a number for each run meets in one task), and rows are ranked within their run, however large a block is."""
    run = [*[F.col(f"{PLACE}.{c}").alias(c) for c in ("table", "file", "block")], F.shiftright(F.col(f"{PLACE}.row"), RUN).alias("run")]
    rows = df.withColumn("_run", F.struct(*run))
    counts = rows.groupBy("_run").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_run").orderBy(F.col(f"{PLACE}.row"))
    found = rows.withColumn("_in", F.row_number().over(within)).join(offsets, "_run")
    return found.withColumn(out, F.col("_before") + F.col("_in") - 1).drop("_run", "_in", "_before")


def first_of_each(df: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key of a placed() table, in the order of its files; tasks reduce before rows move."""
    rest = [c for c in df.columns if c not in (*keys, PLACE)]
    firsts = df.groupBy(*keys).agg(F.min_by(F.struct(PLACE, *rest), PLACE).alias("_f"))
    return firsts.select(*keys, F.col(f"_f.{PLACE}").alias(PLACE), *[F.col("_f")[c].alias(c) for c in rest])


def find_csv_dir(spark: SparkSession, target: str, others: tuple[str, ...] = ()) -> str:
    """The first of target, its csv folder and others that holds the first table of the bundle, else target."""
    for d in (target, f"{target}/csv", *others):
        if exists(spark, f"{d}/{BUNDLE['mass_train']}"):
            return d
    return target


def read_bundle(spark: SparkSession, target: str) -> dict[str, DataFrame]:
    """The six tables, each row with its PLACE."""
    d = find_csv_dir(spark, target)
    missing = [f for f in BUNDLE.values() if not exists(spark, f"{d}/{f}")]
    if missing:
        raise FileNotFoundError(f"{d} lacks {', '.join(missing)}")
    return {k: placed(read_csv(spark, f"{d}/{f}"), i) for i, (k, f) in enumerate(BUNDLE.items())}


def inventory(spark: SparkSession, root: str, pattern: str = IMAGES) -> DataFrame:
    """path, name, folder, length of all files below root; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    parts = F.split("path", "/")
    return found.select("path", F.element_at(parts, -1).alias("name"), F.element_at(parts, -2).alias("folder"), "length")


def recursive_index(files: DataFrame) -> DataFrame:
    """key, path: by name and by folder; later paths replace earlier ones."""
    keys = F.explode(F.array("name", "folder")).alias("key")
    return files.select("path", keys).groupBy("key").agg(F.max("path").alias("path"))


def patient_from_name(name: Column) -> Column:
    return F.element_at(F.split(name, "_"), 1)


def listing(files: DataFrame, n: int) -> DataFrame:
    """The first n files by path, as records, where there is no catalogue."""
    return files.orderBy("path").limit(n).select(patient_from_name(F.col("name")).alias("patient_id"), "path")


# --- images --------------------------------------------------------------------------------------------------------


def encode_png(x: np.ndarray) -> bytes:
    """8-bit grayscale PNG."""
    h, w = x.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = np.hstack([np.zeros((h, 1), np.uint8), x.astype(np.uint8)]).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


#: First column and row, and steps, of the seven passes of an interlaced PNG: fixed values of the format.
PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


def _lines(raw: np.ndarray, h: int, size: int, step: int) -> np.ndarray:
    """h lines of size bytes without their filters; step is the distance of a byte's left neighbour."""
    raw = raw[: h * (size + 1)].reshape(h, size + 1)
    out, above = np.zeros((h, size), np.uint8), np.zeros(size, np.int64)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        if kind == 1:
            padded = np.zeros(-(-size // step) * step, np.int64)
            padded[:size] = line
            line = np.cumsum(padded.reshape(-1, step), 0).ravel()[:size]
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):
            done = np.zeros_like(line)
            for i in range(size):
                left = done[i - step] if i >= step else 0
                if kind == 3:
                    guess = (left + above[i]) // 2
                else:
                    up, corner = above[i], above[i - step] if i >= step else 0
                    p = left + up - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                done[i] = (line[i] + guess) & 255
            line = done
        elif kind:
            raise ValueError("unknown filter")
        above = line & 255
        out[y] = above
    return out


def _samples(lines: np.ndarray, w: int, channels: int, depth: int) -> np.ndarray:
    """(h, w, channels) values of depth bits; of 16, the upper 8."""
    if depth >= 8:
        return lines.reshape(len(lines), w, channels, depth // 8)[..., 0]
    bits = np.unpackbits(lines, axis=1).reshape(len(lines), -1, depth)
    return (bits @ (1 << np.arange(depth)[::-1]))[:, : w * channels].reshape(len(lines), w, channels).astype(np.uint8)


def decode_png(data: bytes) -> np.ndarray | None:
    """8-bit gray values of a PNG (any colour type, 1 to 16 bits, interlaced or not); None if it is damaged. Of 16 bits the
    upper 8 count, and fewer than 8 are scaled to 255; alpha is left out."""
    try:
        if data[:8] != b"\x89PNG\r\n\x1a\n":
            return None
        at, body, palette, head = 8, [], None, None
        while at < len(data):
            n, kind = struct.unpack(">I4s", data[at : at + 8])
            part = data[at + 8 : at + 8 + n]
            if zlib.crc32(kind + part) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
                return None
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", part)
            elif kind == b"PLTE":
                palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
            elif kind == b"IDAT":
                body.append(part)
            at += 12 + n
        w, h, depth, color, _, _, interlaced = head
        channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
        if depth not in (1, 2, 4, 8, 16) or not w or not h:
            return None
        raw, at = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8), 0
        x = np.zeros((h, w, channels), np.uint8)
        for x0, y0, dx, dy in PASSES if interlaced else [(0, 0, 1, 1)]:
            pw, ph = max(0, -(-(w - x0) // dx)), max(0, -(-(h - y0) // dy))
            if pw and ph:
                size = -(-pw * channels * depth // 8)
                x[y0::dy, x0::dx] = _samples(_lines(raw[at:], ph, size, max(1, channels * depth // 8)), pw, channels, depth)
                at += ph * (size + 1)
        if color == 3:
            x = palette[x[..., 0]]
        elif depth < 8:
            x = (x.astype(int) * 255 // ((1 << depth) - 1)).astype(np.uint8)
        if x.shape[2] >= 3:  # luma weights of ITU-R BT.601
            return np.rint(x[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)
        return x[..., 0]
    except (KeyError, ValueError, TypeError, IndexError, struct.error, zlib.error):
        return None


def decode(content: Column) -> Column:
    """A packed image of 8-bit values; null if it cannot be decoded."""

    def run(contents: pd.Series) -> pd.DataFrame:
        got = [None if c is None else decode_png(bytes(c)) for c in contents]
        return _table([None if x is None else x.astype(float) for x in got])

    return F.pandas_udf(run, IMAGE)(content)


def read_images(spark: SparkSession, path: str, pattern: str = "*.png", invalid: str = "keep") -> DataFrame:
    """path, image. invalid: keep (null image), drop, or fail."""
    return _judged(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", decode(F.col("content")).alias("image")), invalid)


def _judged(out: DataFrame, invalid: str) -> DataFrame:
    if invalid == "drop":
        return out.filter("image.data is not null")
    if invalid == "fail":
        return out.withColumn("image", F.when(F.col("image.data").isNotNull(), F.col("image")).otherwise(F.raise_error(F.concat(F.lit("cannot decode "), F.col("path")))))
    return out


def read_image_source(spark: SparkSession, path: str, pattern: str = IMAGES) -> DataFrame:
    """path, image by Spark's image source (PNG and JPEG); colour becomes gray."""
    i = F.col("image")
    found = spark.read.format("image").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)

    def gray(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.DataFrame:
        out = []
        for h, w, c, d in zip(height, width, channels, data, strict=True):
            x = np.frombuffer(d, np.uint8).reshape(h, w, c) if h > 0 else None
            out.append(None if x is None else x[..., 0].astype(float) if c == 1 else np.rint(x[..., :3] @ np.array([0.114, 0.587, 0.299])))
        return _table(out)

    return found.select(i["origin"].alias("path"), F.pandas_udf(gray, IMAGE)(i["height"], i["width"], i["nChannels"], i["data"]).alias("image"))


def read_folder(spark: SparkSession, path: str, invalid: str = "keep") -> DataFrame:
    """path, image of all PNG and JPEG files below path, each by the reader that knows it; invalid as in read_images.
    Files of no bytes are left out, as Spark's own readers do."""
    png = read_images(spark, path, "*.{png,PNG}", invalid)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{jpg,jpeg,JPG,JPEG}").load(path).select("path")
    if not files.head(1):
        return png
    found = read_image_source(spark, path, "*.{jpg,jpeg,JPG,JPEG}")
    name = lambda c: F.regexp_replace(c, "^file:/+", "/")  # noqa: E731  the two readers write local paths in two ways
    jpeg = files.withColumn("_at", name("path")).join(found.select(name("path").alias("_at"), "image"), "_at", "left").select("path", "image")
    return png.unionByName(_judged(jpeg, invalid))


def load_config(path: str, missing_ok: bool = False) -> dict:
    if not Path(path).exists():
        if missing_ok:
            return {}
        raise FileNotFoundError(path)
    import yaml

    return yaml.safe_load(Path(path).read_text()) or {}
