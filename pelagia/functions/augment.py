"""Augmentation of packed images as array expressions: flips, a rotation, normalisation.

A training image is flipped left to right, then upside down, with half a chance each, and rotated about its middle by up
to so many degrees; what comes from outside is 0. Every result pixel is taken from where the inverse map leads, from the
closest pixel or from the four around it (bilinear). Random numbers are an md5 counter of seed, epoch and image, so
they depend on nothing else. All is built-in: an image stays in its row, and nothing goes to Python. Each step evaluates
the image that it is given once (let), however many of its parts it uses.

Defined cases: a null image gives null; an image of one pixel is its own flip and rotation; NaN stays NaN."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from pelagia.functions.points import let
from pelagia.functions.points import with_data as _with


def draw(key: Column, seed: int, epoch: Column | int, stream: str) -> Column:
    """In [0, 1): the first 32 bits of md5(seed-epoch-key-stream)."""
    epoch = F.lit(epoch) if isinstance(epoch, int) else epoch
    text = F.concat(F.lit(f"{seed}-"), epoch.cast("string"), F.lit("-"), key.cast("string"), F.lit(f"-{stream}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def flip(image: Column, across: Column, down: Column) -> Column:
    """across: left to right; down: upside down."""

    def made(p: Column) -> Column:
        d, h, w = p["image"]["data"], p["image"]["height"], p["image"]["width"]

        def one(_: Column, i: Column) -> Column:
            y, x = F.floor(i / w), i % w
            return F.element_at(d, (F.when(p["down"], h - 1 - y).otherwise(y) * w + F.when(p["across"], w - 1 - x).otherwise(x) + 1).cast("int"))

        return _with(p["image"], F.transform(d, one))

    return let(made, image=image, across=across, down=down)


def rotate(image: Column, degrees: Column, bilinear: bool = False) -> Column:
    """Counter-clockwise about the middle, on the same canvas."""

    def made(p: Column) -> Column:
        d, h, w = p["image"]["data"], p["image"]["height"], p["image"]["width"]

        def at(y: Column, x: Column) -> Column:
            inside = (y >= 0) & (y < h) & (x >= 0) & (x < w)
            return F.when(inside, F.element_at(d, F.when(inside, y * w + x + 1).otherwise(1).cast("int"))).otherwise(0.0)

        def one(_: Column, i: Column) -> Column:
            dy, dx = F.floor(i / w) - (h - 1) / 2.0, i % w - (w - 1) / 2.0
            # what is at (dy, dx) comes from there, turned back; rows grow downwards
            y, x = (h - 1) / 2.0 + dx * p["sin"] + dy * p["cos"], (w - 1) / 2.0 + dx * p["cos"] - dy * p["sin"]
            if not bilinear:
                return let(lambda q: at(q["y"], q["x"]), y=F.floor(y + 0.5), x=F.floor(x + 0.5))

            def mixed(q: Column) -> Column:
                y0, x0, fy, fx = q["y0"], q["x0"], q["y"] - q["y0"], q["x"] - q["x0"]
                return (1 - fy) * ((1 - fx) * at(y0, x0) + fx * at(y0, x0 + 1)) + fy * ((1 - fx) * at(y0 + 1, x0) + fx * at(y0 + 1, x0 + 1))

            return let(mixed, y=y, x=x, y0=F.floor(y), x0=F.floor(x))

        return _with(p["image"], F.transform(d, one))

    turn = degrees * pi / 180
    return let(made, image=image, cos=F.cos(turn), sin=F.sin(turn))


def normalize(image: Column, mean: float = 0.5, std: float = 0.5) -> Column:
    return let(lambda p: _with(p["image"], F.transform(p["image"]["data"], lambda v: (v - mean) / std)), image=image)


def repeated(image: Column, channels: int = 3) -> Column:
    """struct<height, width, channels, data>: the image once for each channel, one after the other."""
    data = F.flatten(F.array_repeat(image["data"], channels))
    return F.when(image["data"].isNotNull(), F.struct(image["height"].alias("height"), image["width"].alias("width"), F.lit(channels).alias("channels"), data.alias("data")))


def train(image: Column, key: Column, seed: int = 42, epoch: Column | int = 0, degrees: float = 15.0, bilinear: bool = False) -> Column:
    """Flips, rotation and normalisation of an image in [0, 1], drawn for its key and the epoch."""
    flipped = flip(image, draw(key, seed, epoch, "across") < 0.5, draw(key, seed, epoch, "down") < 0.5)
    return normalize(rotate(flipped, (2 * draw(key, seed, epoch, "turn") - 1) * degrees, bilinear))


def val(image: Column) -> Column:
    """Normalisation alone."""
    return normalize(image)
