"""Connected components of a link table that no single task or the driver has to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.llm.shared import drop, materialise


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of links (a, b), root being the smallest node it reaches; nodes without a link are absent.

    Alternating large-star and small-star steps: each sends every neighbour to the smallest one, by an aggregation
    and an equi-join, and is written to the shared folder. Ends when a round changes nothing; raises after ``rounds``.
    Links with a null end and links of a node to itself are left out, repeated ones count once, no links give no rows.
    """
    spark = links.sparkSession
    a, b = F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")
    edges, at = materialise(links.filter("a <> b").select(a, b).distinct(), "edges")

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())

    before = state(edges)
    for _ in range(rounds):
        # large star: a node's larger neighbours go to the smallest of its neighbourhood
        both = edges.select(F.col("lo").alias("n"), F.col("hi").alias("m")).unionByName(edges.select(F.col("hi").alias("n"), F.col("lo").alias("m")))
        least = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("r"))
        large = both.filter("m > n").join(least, "n").select(F.col("r").alias("lo"), F.col("m").alias("hi")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("hi").agg(F.min("lo").alias("r"))
        joined = large.join(low, "hi")
        small = joined.select(F.col("r").alias("lo"), "hi").unionByName(joined.filter("lo <> r").select(F.col("r").alias("lo"), F.col("lo").alias("hi"))).distinct()
        new, new_at = materialise(small, "edges")
        drop(spark, at)
        edges, at = new, new_at
        now = state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots)
