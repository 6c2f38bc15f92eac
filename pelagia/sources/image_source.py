"""A data source of PNG folders: ``spark.read.format("pelagia_images").load(folder)``.

Files are listed once, at planning, and packed into partitions of about ``bytes`` bytes (a file also counts ``open`` bytes for
being opened), largest first, so that tasks are even and a folder of many small files does not make as many tasks. Filters
on path and length that Spark pushes down leave files out before anything is opened. Executors open files themselves; the
driver sees names and sizes only, as for Spark's own file sources.

Columns: path, name, folder, length, image (packed, 8-bit values; null if the file is damaged) and error (why).
Options: path; pattern (a shell pattern on names, "*.png"); bytes, open; images ("false" lists files without opening them);
invalid: "keep" damaged files with their error, "drop" them, or "fail". Paths are those of pyarrow's file systems (local, s3,
hdfs, gs); others are read by files.read_images. Pushdown needs spark.sql.python.filterPushdown.enabled, which register() sets.

Defined cases: an empty folder gives no row and a missing one an error; an empty file is damaged; names with blanks, several
dots or no letters are names like others; a file that vanishes after planning is damaged."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith

NAME = "pelagia_images"
SCHEMA = "path string, name string, folder string, length long, image struct<height: int, width: int, data: array<double>>, error string"

#: What can be told of a file before it is opened.
_TESTS = {
    EqualTo: lambda v, w: v == w,
    In: lambda v, w: v in w,
    StringStartsWith: lambda v, w: v.startswith(w),
    StringEndsWith: lambda v, w: v.endswith(w),
    StringContains: lambda v, w: w in v,
    GreaterThan: lambda v, w: v > w,
    GreaterThanOrEqual: lambda v, w: v >= w,
    LessThan: lambda v, w: v < w,
    LessThanOrEqual: lambda v, w: v <= w,
}


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]


def pack(files: list[tuple[str, int]], target: int, open_cost: int) -> list[list[tuple[str, int]]]:
    """Files dealt, largest first, to the emptiest of as few parts as hold target bytes each."""
    total = sum(n + open_cost for _, n in files)
    parts: list[tuple[int, int, list[tuple[str, int]]]] = [(0, i, []) for i in range(min(len(files), max(1, -(-total // target))))]
    for path, n in sorted(files, key=lambda f: (-f[1], f[0])):
        held, i, part = heapq.heappop(parts)
        part.append((path, n))
        heapq.heappush(parts, (held + n + open_cost, i, part))
    return [part for _, _, part in sorted(parts, key=lambda p: p[1])]


class ImageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options.get("path") or ""
        self.pattern = options.get("pattern", "*.png")
        self.bytes, self.open_cost = int(options.get("bytes", 64 << 20)), int(options.get("open", 1 << 20))
        self.decode = options.get("images", "true").lower() != "false"
        self.invalid = options.get("invalid", "keep")
        if self.invalid not in ("keep", "drop", "fail"):
            raise ValueError(f"invalid is keep, drop or fail, not {self.invalid}")
        if not self.root:
            raise ValueError("no path")
        self.tests: list[tuple[str, type, object, bool]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            inner, negated = (f.child, True) if isinstance(f, Not) else (f, False)
            column = inner.attribute[0] if getattr(inner, "attribute", None) and len(inner.attribute) == 1 else None
            if column in ("path", "name", "folder", "length") and type(inner) in _TESTS:
                self.tests.append((column, type(inner), inner.value, negated))
            elif not (isinstance(inner, IsNotNull) and not negated and column in ("path", "name", "folder", "length")):
                yield f

    def _wanted(self, path: str, length: int) -> bool:
        parts = path.rsplit("/", 2)
        known = {"path": path, "name": parts[-1], "folder": parts[-2] if len(parts) > 1 else "", "length": length}
        return fnmatch(known["name"].lower(), self.pattern.lower()) and all(_TESTS[kind](known[c], v) is not negated for c, kind, v, negated in self.tests)

    def _store(self):
        from pyarrow import fs

        root = "file://" + self.root.removeprefix("file:") if self.root.startswith("file:/") and not self.root.startswith("file://") else self.root
        return fs.FileSystem.from_uri(root if "://" in root else "file://" + root)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = self._store()
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        files = [(f.path, f.size) for f in found if f.type == fs.FileType.File and self._wanted(f.path, f.size)]
        return [Files(p) for p in pack(files, self.bytes, self.open_cost)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        from pelagia.sources.files import decode_png

        store, _ = self._store()
        for path, length in partition.files:
            head, error, image = path.rsplit("/", 2), None, None
            if self.decode:
                try:
                    with store.open_input_stream(path) as f:
                        x = decode_png(f.read())
                except OSError as e:
                    x, error = None, f"cannot open: {type(e).__name__}"
                if x is None:
                    error = error or "cannot decode"
                    if self.invalid == "fail":
                        raise ValueError(f"{error}: {path}")
                    if self.invalid == "drop":
                        continue
                else:
                    image = (int(x.shape[0]), int(x.shape[1]), x.ravel().astype(float).tolist())
            yield path, head[-1], head[-2] if len(head) > 1 else "", length, image, error


class ImageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ImageReader:
        return ImageReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with pushdown of filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ImageSource)
