"""Centroid clustering of integer vectors: Lloyd's rounds whose nearest-centroid step is an annulus search.

A centroid at distance d from a vector has a norm that differs from the vector's by at most d. So the centroids are sorted
by norm; a few whose norms are closest give every vector an upper bound of its least distance; a binary search finds the
centroids in the annulus of that width, and only those are compared, in exact integers. The annulus is widened by what
rounding of norms can hide, so a centroid on its edge (a tie) is always inside.

A round reads the integer vectors once. Each task returns one row of exact sums for each centroid, Spark adds them up, and
the driver sees k rows: nothing that reaches it grows with the data, and no vector moves. Centroids go to the tasks with
the code (k * dims numbers).

Defined cases: vectors that are null, of another length, or hold null or non-finite components take no part and have no row;
repeated rows are vectors of their own with a row each (equal hashes: the smaller vector comes first, equal vectors fill
several centroids); a null id is hashed as empty text; ties of distance go to the smaller centroid number; fewer vectors
than k make fewer centroids; an empty table gives an empty result; other columns are not read. Components of more than
2 ** 27 after scaling would take squared distances out of 64 bits: the run fails and says so.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.llm.shared import bounded, drop, materialise, table

K, ROUNDS, DIMS, SCALE, SALT = 40, 5, 64, 256, "2:"
LIMIT = 1 << 27
#: Centroids around a vector's place in the order of norms that give it its upper bound.
PROBES = (-2, -1, 0, 1)


class Annuli:
    """k centroids (k x dims integers), ready to be searched."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids.astype(np.int64)
        norms = np.sqrt((self.centroids.astype(np.float64) ** 2).sum(1))
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]

    def ranges(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each vector the first and the last + 1 place, in the order of norms, of the centroids in its annulus."""
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        place = np.searchsorted(self.norms, norm)
        bound = np.full(len(x), np.inf)
        for probe in PROBES:
            near = self.centroids[self.order[np.clip(place + probe, 0, len(self.norms) - 1)]]
            bound = np.minimum(bound, np.sqrt(((x - near) ** 2).sum(1).astype(np.float64)))
        width = bound + 1e-9 * (bound + norm + self.norms[-1]) + 1e-9
        return np.searchsorted(self.norms, norm - width, "left"), np.searchsorted(self.norms, norm + width, "right")

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each vector's nearest centroid, ties to the smaller number."""
        low, high = self.ranges(x)
        best, far = np.full(len(x), -1, np.int64), np.full(len(x), np.iinfo(np.int64).max)
        for place, number in enumerate(self.order):
            rows = np.flatnonzero((low <= place) & (place < high))
            d = ((x[rows] - self.centroids[number]) ** 2).sum(1)
            wins = (d < far[rows]) | ((d == far[rows]) & (number < best[rows]))
            best[rows[wins]], far[rows[wins]] = number, d[wins]
        return best, far


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    x = batch.column("e").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    if len(x) and np.abs(x).max() > LIMIT:
        raise ValueError(f"a scaled component is beyond {LIMIT}; squared distances would not fit 64 bits")
    return x


def integers(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and e (array<long>) of the vectors that take part."""
    e = F.col(f"`{embedding}`").cast("array<double>")
    some = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), e.alias("e"))
    finite = F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return some.filter((F.size("e") == dims) & finite).select("vec_id", F.transform("e", lambda v: F.floor(v * scale).cast("long")).alias("e"))


def initial(whole: DataFrame, k: int = K, salt: str = SALT) -> np.ndarray:
    """The k vectors whose hashes are smallest, in that order: each task keeps k rows, the driver k."""
    h = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = whole.select(h.alias("h"), "e").orderBy("h", "e").limit(k).collect()
    return np.array([r["e"] for r in first], np.int64).reshape(len(first), -1 if first else 0)


def moved(whole: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of the exact means; those without a vector stay."""
    k, dims = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # int64 holds the sums of 2 ** 36 vectors of one task
        annuli, total, n = Annuli(centroids), np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for b in batches:
            x = _matrix(b, dims)
            at, _ = annuli.nearest(x)
            n += np.bincount(at, minlength=k)
            for c in np.unique(at):
                total[c] += x[at == c].sum(0)
        some = np.flatnonzero(n)
        columns = [pa.array(some.astype(np.int32)), pa.array(n[some])] + [pa.array(total[some, i]) for i in range(dims)]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", *(f"s{i}" for i in range(dims))])

    parts = whole.select("e").mapInArrow(sums, "cluster int, n long, " + ", ".join(f"s{i} long" for i in range(dims)))
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)  # noqa: E731  of all tasks, sums may leave 64 bits
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(exact("n"), *[exact(f"s{i}") for i in range(dims)]).collect():
        out[r["cluster"]] = [int(r[f"s{i}"]) // int(r["n"]) for i in range(dims)]
    return out


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, vec_id: str = "vec_id", embedding: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every vector that takes part."""
    spark = bounded(vectors.sparkSession)
    whole, whole_at = materialise(integers(vectors, vec_id, embedding, dims, scale), "vectors")
    centroids = initial(whole, k)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(whole, centroids)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = Annuli(centroids)
        for b in batches:
            if not b.num_rows:
                continue
            at, d = annuli.nearest(_matrix(b, dims))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(at.astype(np.int32)), pa.array(d)], names=["vec_id", "cluster", "distance"])

    kind = whole.schema["vec_id"].dataType.simpleString()
    assigned, _ = materialise(whole.mapInArrow(last, f"vec_id {kind}, cluster int, distance long"), "assigned")
    drop(spark, whole_at)
    # k rows at most
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(c, s, sum(sums.values()), digest[c]) for c, s in sums.items()]
    of = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12(spark, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """Every round is a table of (number, vector); distances by list functions."""
    at = """(select v.rid, v.vec_id, v.e, arg_min(c.k, (d.d, c.k)) as cluster, min(d.d) as distance from v cross join {c} c,
             lateral (select list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - c.e[i]) * (v.e[i] - c.e[i])))::bigint as d) d group by all)"""
    out = """with v as materialized (select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
c0 as materialized (select row_number() over (order by sha256('2:' || vec_id), e) - 1 as k, e from v qualify k < 40)"""
    for i in range(ROUNDS):
        assigned = at.format(c=f"c{i}")
        out += f""",
u{i} as materialized (select cluster as k, list(floor_mean order by j) as e from (select cluster, j, floor(sum(x)::decimal(38,0) / count(*))::bigint as floor_mean
  from (select cluster, unnest(range(1, 65)) as j, unnest(e) as x from {assigned} a) group by cluster, j) group by cluster),
c{i + 1} as materialized (select c.k, coalesce(u.e, c.e) as e from c{i} c left join u{i} u using (k))"""
    return out + f""",
a as materialized (select vec_id, cluster, distance from {at.format(c=f"c{ROUNDS}")} a)
select vec_id, cluster::int as cluster, distance, sum(distance) over (partition by cluster)::bigint as cluster_inertia, sum(distance) over ()::bigint as inertia,
  sha256(array_to_string(c.e, ',')) as centroid_sha256
from a join c{ROUNDS} c on c.k = a.cluster"""


OP12_SQL = _sql()
