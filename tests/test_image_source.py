"""The data source of image folders, and PNG of all kinds."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagia.sources import image_source
from pelagia.sources.files import PASSES, decode_png, encode_png, read_folder


def png(x, depth=8, color=0, palette=None, interlaced=False, kind=0):
    """x: (h, w) or (h, w, channels) of samples. kind: a filter type for every line (0, 1 or 2)."""
    x = x if x.ndim == 3 else x[..., None]
    h, w, c = x.shape

    def packed(part):
        if depth == 16:
            rows = part.astype(">u2").view(np.uint8).reshape(len(part), -1)
        elif depth == 8:
            rows = part.astype(np.uint8).reshape(len(part), -1)
        else:
            bits = (part.reshape(len(part), -1)[..., None] >> np.arange(depth)[::-1] & 1).reshape(len(part), -1)
            rows = np.packbits(bits.astype(np.uint8), axis=1)
        step, out = max(1, c * depth // 8), []
        for y, line in enumerate(rows.astype(int)):
            left = np.r_[np.zeros(step, int), line[:-step]] if kind == 1 else rows[y - 1].astype(int) if kind == 2 and y else 0
            out.append(bytes([kind]) + ((line - left) % 256).astype(np.uint8).tobytes())
        return b"".join(out)

    raw = b"".join(packed(x[y0::dy, x0::dx]) for x0, y0, dx, dy in (PASSES if interlaced else [(0, 0, 1, 1)]) if x[y0::dy, x0::dx].size)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    extra = chunk(b"PLTE", palette.astype(np.uint8).tobytes()) if palette is not None else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, color, 0, 0, int(interlaced))) + extra + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize("kind", [0, 1, 2])
@pytest.mark.parametrize("shape", [(1, 1), (5, 3), (9, 17)])
def test_png_of_all_depths(interlaced, kind, shape):
    rng = np.random.default_rng(sum(shape))
    for depth in (1, 2, 4, 8, 16):
        x = rng.integers(0, 1 << depth, shape)
        want = x >> 8 if depth == 16 else x * 255 // ((1 << depth) - 1) if depth < 8 else x
        assert (decode_png(png(x, depth, 0, None, interlaced, kind)) == want).all()
    rgb = rng.integers(0, 256, (*shape, 3))
    gray = np.rint(rgb @ np.array([0.299, 0.587, 0.114]))
    assert (decode_png(png(rgb, 8, 2, None, interlaced, kind)) == gray).all()
    assert (decode_png(png(np.concatenate([rgb, rgb[..., :1]], 2), 8, 6, None, interlaced, kind)) == gray).all()
    colours = rng.integers(0, 256, (4, 3))
    at = rng.integers(0, 4, shape)
    assert (decode_png(png(at, 2, 3, colours, interlaced, kind)) == np.rint(colours[at] @ np.array([0.299, 0.587, 0.114]))).all()


def test_damaged_png_is_none():
    good = png(np.arange(64).reshape(8, 8))
    assert decode_png(good) is not None
    for bad in (b"", b"\xff\xd8\xff", good[:40], good[:-20], good[:60] + b"\x00" + good[61:], png(np.arange(4).reshape(2, 2), 8, 3)):
        assert decode_png(bad) is None


@pytest.fixture
def folder(tmp_path, spark):
    image_source.register(spark)
    rng = np.random.default_rng(4)
    kept = {}
    for i in range(9):
        (tmp_path / f"d{i % 3}").mkdir(exist_ok=True)
        x = rng.integers(0, 256, (4 + i, 6))
        (tmp_path / f"d{i % 3}" / f"im {i}.v1.png").write_bytes(encode_png(x))
        kept[f"im {i}.v1.png"] = x
    (tmp_path / "d0" / "bad.png").write_bytes(b"\x89PNG\r\n\x1a\nnothing")
    (tmp_path / "d0" / "empty.PNG").write_bytes(b"")
    (tmp_path / "d0" / "notes.txt").write_text("no image")
    return tmp_path, kept


def load(spark, root, **options):
    return spark.read.format(image_source.NAME).options(**options).load(str(root))


def test_images_come_back_and_bad_files_are_kept(spark, folder):
    root, kept = folder
    got = {r.name: r for r in load(spark, root).collect()}
    assert set(got) == {*kept, "bad.png", "empty.PNG"}
    for name, x in kept.items():
        r = got[name]
        assert (np.array(r.image.data).reshape(r.image.height, r.image.width) == x).all() and r.error is None
        assert r.path.endswith(f"/{r.folder}/{name}") and r.length > 0
    assert got["bad.png"].image is None and got["bad.png"].error == "cannot decode" and got["empty.PNG"].length == 0
    assert load(spark, root, invalid="drop").count() == 9
    with pytest.raises(Exception, match="cannot decode: .*/(bad.png|empty.PNG)"):
        load(spark, root, invalid="fail").collect()
    with pytest.raises(Exception, match="keep, drop or fail"):
        load(spark, root, invalid="x").collect()


def test_partitions_are_planned_from_sizes(spark, folder):
    root, _ = folder
    assert load(spark, root).rdd.getNumPartitions() == 1
    assert load(spark, root, bytes="1000", open="500").rdd.getNumPartitions() > 3
    parts = image_source.pack([(f"f{i}", n) for i, n in enumerate([900, 10, 10, 10, 880, 5])], 1000, 0)
    assert sorted(sum(n for _, n in p) for p in parts) == [905, 910]
    assert sorted(f for p in parts for f, _ in p) == [f"f{i}" for i in range(6)]
    assert image_source.pack([], 1000, 0) == []


def test_filters_leave_files_unopened(spark, folder):
    root, kept = folder
    df = load(spark, root, invalid="fail")  # would fail on the damaged files, were they opened
    assert df.filter(F.col("name").startswith("im ")).count() == 9
    assert {r.name for r in df.filter((F.col("folder") == "d1") & (F.col("length") > 0)).collect()} == {f"im {i}.v1.png" for i in (1, 4, 7)}
    assert df.filter(F.col("path").contains("/d2/")).count() == 3
    assert df.filter(~F.col("path").contains("/d0/")).count() == 6
    one = f"{root}/d1/im 1.v1.png"
    assert df.filter(F.col("path").isin(one, "other")).select("path").collect()[0].path == one
    # what cannot be pushed is still true
    assert df.filter(F.col("name").startswith("im ") & (F.col("image.height") > 9)).count() == sum(len(x) > 9 for x in kept.values())


def test_listing_opens_nothing(spark, folder):
    root, _ = folder
    out = load(spark, root, images="false", invalid="fail", pattern="*").select("name", "image", "error").collect()
    assert len(out) == 12 and all(r.image is None and r.error is None for r in out)


def test_empty_and_missing_folders(spark, tmp_path):
    image_source.register(spark)
    assert load(spark, tmp_path).collect() == []
    with pytest.raises(Exception, match="(?i)not|no such"):
        load(spark, tmp_path / "gone").collect()


def test_png_and_jpeg_of_one_folder(spark, folder):
    root, kept = folder
    java = spark._jvm
    image = java.java.awt.image.BufferedImage(6, 4, java.java.awt.image.BufferedImage.TYPE_BYTE_GRAY)
    for y in range(4):
        for x in range(6):
            v = 40 * y
            image.setRGB(x, y, (255 << 24 | v << 16 | v << 8 | v) - (1 << 32))
    java.javax.imageio.ImageIO.write(image, "jpg", java.java.io.File(f"{root}/d1/photo.jpg"))
    (root / "d2" / "broken.jpeg").write_bytes(b"\xff\xd8\xff\xe0 nothing")
    got = {r.path.rpartition("/")[2].replace("%20", " "): r.image for r in read_folder(spark, str(root)).collect()}
    assert set(got) == {*kept, "bad.png", "photo.jpg", "broken.jpeg"}  # Spark's readers leave out files of no bytes
    assert got["broken.jpeg"] is None or got["broken.jpeg"].data is None
    assert (got["photo.jpg"].height, got["photo.jpg"].width) == (4, 6)
    assert read_folder(spark, str(root), "drop").count() == 10
