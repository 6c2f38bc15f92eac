"""Shuffled batches without a global sort.

Every row gets a rank from 0 to n - 1, by the md5 of its key: rows are dealt into buckets by the first hex digits, ranked
within their bucket, and the counts of the buckets (a bounded number) are added up. A keyed permutation of 0 to n - 1 then
gives each row its place in an epoch; the place divided by the batch size is its batch. The permutation is swap-or-not: in
each round a place may trade with its mirror about a secret number, as a hash of the larger of the two says. It is a
permutation for every n, with no table and no sort, and any row's place can be computed alone.

So each row comes once an epoch, epochs differ, and the result depends on the keys, the seed and the epoch only, not on
partitions, retries or engine. Places are far from each other's ranks: a batch is a random set of rows.

Defined cases: rows of equal keys are told apart by the columns of ``ties`` (if rows are equal in these too, either may
come first); a null key is hashed as empty text and keeps its row; an empty table has no batches; the last batch may be
smaller, or is left out with drop_last; other columns are kept, and must not be called _rank, epoch, batch or place."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of the buckets' number; rounds of the permutation.
DIGITS, ROUNDS = 3, 24


def ranked(df: DataFrame, key: str, ties: tuple[str, ...] = (), out: str = "_rank", digits: int = DIGITS) -> DataFrame:
    """Add the rank of each row by (md5 of the key, key, ties): one exchange, by bucket; at most 16 ** digits counts meet."""
    h = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    rows = df.withColumns({"_h": h, "_bucket": F.substring(h, 1, digits)})
    counts = rows.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # over the counts of the buckets
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_bucket").orderBy("_h", key, *ties)
    found = rows.withColumn("_in", F.row_number().over(within)).join(F.broadcast(offsets), "_bucket")
    return found.withColumn(out, F.col("_before") + F.col("_in") - 1).drop("_h", "_bucket", "_in", "_before")


def permuted(rank: Column, n: int, seed: int, epoch: Column | int, rounds: int = ROUNDS) -> Column:
    """The place of a rank in an epoch's order of 0 to n - 1."""
    epoch = F.lit(epoch) if isinstance(epoch, int) else epoch
    size = F.lit(max(n, 1)).cast("long")
    tag = F.concat(F.lit(f"{seed}-"), epoch.cast("string"), F.lit("-"))

    def number(text: Column) -> Column:
        return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")

    def step(x: Column, i: Column) -> Column:
        named = F.concat(tag, i.cast("string"))
        mirror = F.pmod(F.pmod(number(named), size) - x, size)
        return F.when(F.substring(F.md5(F.concat(named, F.lit("-"), F.greatest(x, mirror).cast("string"))), 1, 1) >= "8", mirror).otherwise(x)

    return F.aggregate(F.array(*[F.lit(i) for i in range(rounds)]), rank.cast("long"), step)


def place(rank: int, n: int, seed: int, epoch: int, rounds: int = ROUNDS) -> int:
    """permuted() of one rank, in Python."""
    x = rank
    for i in range(rounds):
        tag = f"{seed}-{epoch}-{i}"
        mirror = (int(hashlib.md5(tag.encode()).hexdigest()[:15], 16) - x) % n
        if hashlib.md5(f"{tag}-{max(x, mirror)}".encode()).hexdigest()[0] >= "8":
            x = mirror
    return x


def batches(df: DataFrame, key: str, size: int, seed: int = 42, epochs: int = 1, shuffle: bool = True, drop_last: bool = False, ties: tuple[str, ...] = ()) -> DataFrame:
    """df for every epoch, with epoch, batch and place (in the batch). Without shuffle, in the order of ranks each time."""
    if size < 1:
        raise ValueError("a batch has at least one row")
    n = df.count()
    rows = ranked(df, key, ties).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    at = permuted(F.col("_rank"), n, seed, F.col("epoch")) if shuffle else F.col("_rank")
    rows = rows.withColumn("_at", at).withColumns({"batch": F.floor(F.col("_at") / size), "place": (F.col("_at") % size).cast("int")})
    if drop_last:
        rows = rows.filter(F.col("batch") < n // size)
    return rows.drop("_at", "_rank")


def gathered(rows: DataFrame, values: list[str]) -> DataFrame:
    """A row for each batch: epoch, batch and the list of each value in the order of places; a batch is of a bounded size."""
    sorted_ = F.array_sort(F.collect_list(F.struct("place", *values)))
    one = rows.groupBy("epoch", "batch").agg(sorted_.alias("_rows"))
    return one.select("epoch", "batch", F.size("_rows").alias("size"), *[F.col(f"_rows.{v}").alias(v) for v in values])


def dataset(paths: DataFrame, images: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """path, image and label for a table of paths, its images and, where there are any, labels (0 without one)."""
    out = paths.select("path").join(images.select("path", "image"), "path", "left")
    if labels is None:
        return out.withColumn("label", F.lit(0))
    return out.join(labels.groupBy("path").agg(F.max("label").alias("label")), "path", "left").withColumn("label", F.coalesce("label", F.lit(0)))
