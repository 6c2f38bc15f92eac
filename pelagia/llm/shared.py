"""Helpers of the corpus operators: the folder all executors share, and tables cut out of a lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.session import BATCH_BYTES as BATCH_BYTES
from pelagia.session import bounded as bounded

#: Words of every contract: runs of anything but space, tab, \n, \v, \f and \r. ``bytes.split()`` cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of a text whose words are held at once.
SEGMENT = 1 << 20
_BREAK = re.compile(rb"[\x20\x09-\x0D]")

_own: dict[str, str] = {}


def segments(raw: bytes, size: int = SEGMENT) -> Iterator[bytes]:
    """Parts of about ``size`` bytes that no word spans, so that a long text's words need not be held together."""
    at = 0
    while at < len(raw):
        cut = _BREAK.search(raw, at + size) if len(raw) - at > size else None
        stop = cut.start() if cut else len(raw)
        yield raw[at:stop]
        at = stop


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset: beside the warehouse's tables on a cluster, a temporary
    folder in local mode (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_pelagia"
    return _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="pelagia-"))


def materialise(df: DataFrame, tag: str, partition_by: list[str] | None = None) -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder and read it back: later stages do not depend on lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    return back, path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables that no returned DataFrame reads."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the value as text, modulo n; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def row_key(*cols: str) -> Column:
    """128 bits that identify equal rows of these columns. Hashes skip nulls, so where they are is hashed too."""
    nulls = F.concat(*[F.isnull(c).cast("string") for c in cols])
    return F.struct(F.xxhash64(*cols, nulls).alias("a"), F.xxhash64(F.lit(2), nulls, *cols).alias("b"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(spark).read.parquet(f"{sf_dir}/{name}.parquet")
