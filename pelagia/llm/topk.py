"""Exact top-k inner products by no-random-access aggregation.

Every dimension is a list of candidates sorted by their component. A query reads each list in the order of its
contributions (from the top for a positive weight, from the bottom for a negative one), a step of rows at a time. What it
has read adds to a candidate's score; what it has not is worth at most the list's frontier and at least its far end. So
every candidate has a lower and an upper bound, and after each step those whose upper bound is below the k-th best lower
bound are out. Reading stops when so few are left that no outsider can qualify, or when the lists end; the scores of
those left are then resolved. Queries of a block read together, and each stops by itself. But for the two ends of each list, whose values bound what is not read, no component is
looked at before its list shows it.

Queries and candidates are cut into blocks; each pair of blocks is a task of its own, whose lists are sorted once for all
its queries. Candidates move once for every block of queries, so those are large. reading() reports how far lists are read.

Scores are integers: components become floor(scale * x), below 2 ** 53 in sum, so float64 sums are exact.

Defined cases: vectors that are null or hold null or non-finite components take no part, as query or candidate; vectors of
different lengths are searched apart, each among its own; a query is not its own candidate (rows of its id are not);
repeated rows of a query (id and vector) are one query, different vectors of one id are queries of their own, ranked apart
under that id; repeated candidate rows are candidates each; ties go to the smaller id; fewer candidates than k give all; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagia.llm.shared import bounded, materialise, table

K, SCALE, QUERY_MOD = 5, 256, 50
QUERIES, CANDIDATES = 8192, 4096  # rows of a block
STEPS, FEW = 24, 8  # parts of a list that are read between tests; candidates for each of k that are few enough to resolve
TOGETHER = 512  # queries of a block whose bounds are kept at once


def depths(n: int, steps: int = STEPS) -> list[int]:
    """How far lists of n rows are read before each test: more often towards the end, where most queries stop."""
    step = max(1, -(-n // steps))
    at = {1, steps // 6, steps // 2, 3 * steps // 4, *range(5 * steps // 6, steps + 1)}
    return sorted({min(n, step * m) for m in at if m} | {n})


def bounds(depth: int, rank: np.ndarray, lists: np.ndarray, x: np.ndarray, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of every candidate (row) for every query (column), after depth rows of each list.

    up and down: the queries' positive weights, whose lists are read from the top, and negative ones, from the bottom (dims
    x queries, 0 elsewhere). What is not read counts as the list's far end below, and as its frontier above."""
    n = len(x)
    top, bottom = rank >= n - depth, rank < depth
    lower = np.where(top, x, lists[0]) @ up + np.where(bottom, x, lists[-1]) @ down
    upper = np.where(top, x, lists[n - depth]) @ up + np.where(bottom, x, lists[depth - 1]) @ down
    return lower, upper


def nra(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int = K, steps: int = STEPS, few: int = FEW) -> list[tuple[int, int, int, int]]:
    """(query id, candidate id, score, depth read): per query its k best among x, by score and then smaller id.

    Bounds are of 32 bits, widened by what rounding can hide; the scores of those they leave are exact."""
    out: list[tuple[int, int, int, int]] = []
    if not len(x):
        return out
    order = np.argsort(x, axis=0, kind="stable")
    rank = np.empty(x.shape, np.int32)
    np.put_along_axis(rank, order, np.arange(len(x), dtype=np.int32)[:, None], 0)
    x32 = x.astype(np.float32)
    lists = np.take_along_axis(x32, order, 0)
    for a in range(0, len(q), TOGETHER):
        _together(q[a : a + TOGETHER], q_ids[a : a + TOGETHER], x, x_ids, rank, lists, x32, k, steps, few, out)
    return out


def _together(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, rank: np.ndarray, lists: np.ndarray, x32: np.ndarray, k: int, steps: int, few: int, out: list) -> None:
    n, dims = x.shape
    active = np.arange(len(q))
    slack = 4.0 * dims * np.finfo(np.float32).eps * (np.abs(x).max(initial=0) * np.abs(q).sum(1)).astype(np.float32)
    for depth in depths(n, steps):
        w = q[active].T.astype(np.float32)
        if dims:
            lower, upper = bounds(depth, rank, lists, x32, np.maximum(w, 0), np.minimum(w, 0))
        else:
            lower = upper = np.zeros((n, len(active)), np.float32)
        own = x_ids[:, None] == q_ids[active][None]
        lower[own] = upper[own] = -np.inf
        least = np.partition(lower, max(0, n - k), axis=0)[max(0, n - k)] - 2 * slack[active]
        inside = (upper >= least) & ~own
        ended = (inside.sum(0) <= few * k) | (depth == n)
        for j in np.flatnonzero(ended):
            at = np.flatnonzero(inside[:, j])
            scores = x[at] @ q[active[j]]
            best = np.lexsort((x_ids[at], -scores))[:k]
            out += [(int(q_ids[active[j]]), int(x_ids[at[i]]), int(scores[i]), depth) for i in best]
        active = active[~ended]
        if not len(active):
            return


def _found(vectors: DataFrame, is_query: Column, vec_id: str, embedding: str, k: int, scale: int) -> DataFrame:
    """query_id, version, vec_id, score, depth and n (candidates) of each pair of blocks."""
    bounded(vectors.sparkSession)
    e = F.col(f"`{embedding}`").cast("array<double>")
    usable = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), is_query.alias("q"), e.alias("e"))
    finite = F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = usable.filter(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & finite)
    usable, _ = materialise(usable.select("vec_id", "q", F.transform("e", lambda v: F.floor(v * scale).cast("double")).alias("e"), F.size("e").alias("dims")), "vectors")
    n_q, n = usable.agg(F.count_if("q"), F.count("*")).first()
    rows, cols = max(1, ceil(n_q / QUERIES)), max(1, ceil(n / CANDIDATES))
    h = F.xxhash64("vec_id", "e")
    numbers = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<long>"))
    # repeated query rows are one query; different vectors of one id are queries of their own
    asked = usable.filter("q").select("dims", "vec_id", "e").distinct().withColumn("version", F.row_number().over(Window.partitionBy("vec_id").orderBy("dims", "e")))
    asked = asked.select("dims", "version", F.pmod(h, F.lit(rows)).alias("row"), numbers(cols).alias("col"), "vec_id", "e", F.lit(True).alias("q"))
    given = usable.select("dims", F.lit(None).cast("int").alias("version"), numbers(rows).alias("row"), F.pmod(h, F.lit(cols)).alias("col"), "vec_id", "e", F.lit(False).alias("q"))

    def block(g: pd.DataFrame) -> pd.DataFrame:
        q, x = g[g["q"]], g[~g["q"]]
        out = [pd.DataFrame([], columns=["query_id", "vec_id", "score", "depth", "version"])]
        for version, some in q.groupby("version") if len(x) else ():
            got = nra(np.stack(some["e"].to_numpy()), some["vec_id"].to_numpy(), np.stack(x["e"].to_numpy()), x["vec_id"].to_numpy(), k)
            out.append(pd.DataFrame(got, columns=["query_id", "vec_id", "score", "depth"]).assign(version=int(version)))
        return pd.concat(out).astype("int64").assign(n=len(x))

    return asked.unionByName(given).groupBy("dims", "row", "col").applyInPandas(block, "query_id long, vec_id long, score long, depth long, version long, n long")


def top_k(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score."""
    order = Window.partitionBy("query_id", "version").orderBy(F.desc("score"), "vec_id")
    found = _found(vectors, is_query, vec_id, embedding, k, scale).select("query_id", "version", "vec_id", "score")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def reading(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, n and depth: how long its lists are in each block of candidates, and how far they were read."""
    return _found(vectors, is_query, vec_id, embedding, k, scale).select("query_id", "n", "depth").distinct()


def op5(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_MOD == 0)


OP5_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
q as (select distinct vec_id, e from v where vec_id % 50 = 0),
s as (select q.vec_id as query_id, q.e as e, c.vec_id as vec_id,
             list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::bigint as score
      from q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e)),
r as (select query_id, row_number() over (partition by query_id, e order by score desc, vec_id)::int as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
