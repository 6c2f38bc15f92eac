"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position gets a vector of ``radius + 1`` bits; for each non-zero vector v a mask keeps the positions whose
vector has an odd product with v. The differing positions of a pair within the radius span too few dimensions to meet
every v, so some mask keeps none of them: that pair collides in that table. No pair is missed.

Equal fingerprints are one node. A bucket is cut into blocks; pairs of blocks are compared in tasks of their own and
give a spanning forest of their links, never all pairs, so a bucket may be of any size.

Defined cases: null or blank text has the fingerprint zero, which links like any other; fewer words than a shingle
make one shingle; repeated rows share a component; null ids get a fingerprint and the smallest non-null id reachable
(null if there is none); of texts of any length a segment's words and eight bytes for each shingle are held; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import random
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.llm import setjoin
from pelagia.llm.components import components
from pelagia.llm.shared import bounded, drop, materialise, row_key, segments, table

SHINGLE, RADIUS, BITS, SEED = 3, 3, 64, 42  # the contract of op6
STAGE_SHINGLE, SIMILARITY = 5, 0.8  # the rule of the pipeline's stage
#: Fingerprints of a bucket that are compared as one block.
BLOCK = 1024
#: Rows of the pairs of blocks that a task gathers.
TASK = 50_000


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the text's shingles in order, as unsigned numbers; none without a word. Words are held a segment at a time."""
    import xxhash

    h, out, carried, any_ = xxhash.xxh64_intdigest, [], [], False
    for part in segments((text or "").encode("utf-8", "surrogatepass").lower()):
        words = carried + part.split()
        if len(words) < shingle:
            carried = words
            continue
        any_, carried = True, words[len(words) - shingle + 1 :] if shingle > 1 else []
        line = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(lengths)
        starts, stops = (ends - lengths).tolist(), (ends - 1).tolist()[shingle - 1 :]
        out.append(np.fromiter((h(line[a:b], SEED) for a, b in zip(starts, stops, strict=False)), np.uint64, len(stops)))
    if not any_:
        return np.array([h(b" ".join(carried), SEED)] if carried else [], np.uint64)
    return np.concatenate(out)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits, each set if over half of the shingles' hashes have it; as a signed integer."""
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        some = np.unpackbits(hashes[a : a + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += some.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def masks(radius: int = RADIUS, bits: int = BITS, seed: int = 7) -> list[int]:
    """2 ** (radius + 1) - 1 covering masks, as signed 64-bit integers."""
    rng = random.Random(seed)
    vectors = [(i % (2 ** (radius + 1) - 1)) + 1 for i in range(bits)]  # as even as can be: all masks keep about half
    rng.shuffle(vectors)
    out = []
    for v in range(1, 2 ** (radius + 1)):
        m = sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def _linked(left: np.ndarray, right: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two blocks (or within one)."""
    parent = np.arange(len(left) + (0 if same else len(right)))
    shift = 0 if same else len(left)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i in range(len(left)):
        near = np.flatnonzero(np.bitwise_count(left[i] ^ right) <= radius)
        if same:
            near = near[near > i]
        for j in near[parent[near + shift] != parent[i]]:
            a, b = find(i), find(int(j) + shift)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, j))
    i, j = np.array(out, np.int64).reshape(-1, 2).T
    return left[i], right[j]


def links(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column ``fp``) within the radius, transitively."""
    table = F.explode(F.array(*[F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks(radius))]))
    rows = prints.select("fp", table.alias("t")).select("fp", "t.table", "t.key")
    sizes = rows.groupBy("table", "key").count().filter("count > 1")
    # a bucket of n prints has ceil(n / block) blocks; each row goes to every pair of blocks that has its own
    sizes, sizes_at = materialise(sizes.withColumn("blocks", F.ceil(F.col("count") / block).cast("int")), "sizes")
    moved = sizes.agg(F.sum(F.col("count") * F.col("blocks"))).first()[0] or 0
    rows = rows.join(sizes, ["table", "key"])
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("table", "key", "fp", "mine", other).select("table", "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") <= F.col("other")).alias("left"), "fp")

    # small buckets are gathered into one group per task, so that most groups are not a call each; a group holds about TASK rows
    rows = rows.withColumn("task", F.pmod(F.xxhash64("table", "key", "i", "j"), F.lit(max(1, ceil(moved / TASK)))).cast("int"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for (_, _, i, j), g in group.groupby(["table", "key", "i", "j"], sort=False):
            fp, left = g["fp"].to_numpy(np.int64).view(np.uint64), g["left"].to_numpy()  # bits of signed numbers are counted without their sign
            x, y = _linked(fp, fp, radius, True) if i == j else _linked(fp[left], fp[~left], radius, False)
            a.append(x)
            b.append(y)
        return pd.DataFrame({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})

    found, _ = materialise(rows.groupBy("task").applyInPandas(compare, "a long, b long").distinct(), "found")
    drop(prints.sparkSession, sizes_at)
    return found


def _rooted(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(fp, component_id, root) of nodes (fp, id), from the links found."""
    roots = components(found)
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    return rooted.select("fp", "root").join(least, "root").select("fp", "component_id", "root")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """keep columns of docs under ``row``, ``fp`` and ``component_id``, the smallest id of the component."""
    bounded(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)])
    made = F.pandas_udf(lambda x: pd.Series([fingerprint(t, shingle) for t in x], dtype="int64"), "long")(F.col(f"`{text}`"))
    prints, _ = materialise(docs.select(row.alias("row"), F.col(f"`{doc_id}`").alias("id"), made.alias("fp")), "prints")
    nodes, _ = materialise(prints.groupBy("fp").agg(F.min("id").alias("id")), "nodes")
    return prints.join(_rooted(nodes, links(nodes.select("fp"), radius)), "fp").select("row", "fp", "component_id")


def near_sets(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): pairs of sets (column ``fp``) whose fingerprints (column ``sim``) link: every set with the first one of its
    fingerprint, and the first ones of fingerprints that the covering LSH links. Rows grow with the sets, not with their pairs."""
    held, held_at = materialise(prints.filter("n > 0").select("sim", "fp").distinct(), "held")
    first, first_at = materialise(held.groupBy("sim").agg(F.min("fp").alias("first")), "first")
    same = held.join(first, "sim").select(F.col("fp").alias("a"), F.col("first").alias("b"))
    of = lambda c: first.select(F.col("sim").alias(c), F.col("first").alias(f"{c}_set"))
    found = links(first.select(F.col("sim").alias("fp")), radius)
    across = found.join(of("a"), "a").join(of("b"), "b").select(F.col("a_set").alias("a"), F.col("b_set").alias("b"))
    pairs, _ = materialise(same.unionByName(across).filter("a <> b").distinct(), "near")
    drop(prints.sparkSession, held_at, first_at)
    return pairs


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = STAGE_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each component of documents whose shingle sets have a Jaccard similarity of at least ``similarity``: that
    with the smallest id (null last), of several rows with it the one with the smallest key.

    Fingerprints come first: sets whose fingerprints the covering LSH finds within the radius are compared exactly. What has
    a fingerprint further off is left to the exact join, which looks at no group that the fingerprints have connected.

    Rows are chosen by a 128-bit key of all their columns; texts move once, to meet the chosen keys, and once more if they
    share much with another. Null and blank texts are the empty set, and empty sets are equal."""
    bounded(docs.sparkSession)
    key = row_key(*[f"`{c}`" for c in docs.columns])
    rows = docs.withColumns({"_key_a": key["a"], "_key_b": key["b"]})  # plain numbers: the join and the grouping share one exchange
    keyed = rows.select(F.struct("_key_a", "_key_b").alias("key"), F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    sim = F.pandas_udf(lambda x: pd.Series([fingerprint(t, shingle) for t in x], dtype="int64"), "long")(F.col("text"))
    prints, prints_at = materialise(setjoin.sets_of(keyed.withColumn("sim", sim), shingle, str(similarity)), "prints")
    texts = keyed.select("key", "text")
    near = setjoin.confirmed(near_sets(prints), prints, texts, shingle, str(similarity))
    known, known_at = materialise(components(near).withColumnRenamed("node", "fp"), "known")
    rest = setjoin.links(prints, texts, shingle, str(similarity), known=known)
    found = rest.unionByName(known.select(F.col("fp").alias("a"), F.col("root").alias("b"), F.lit(0).cast("long").alias("links")))
    roots = setjoin.classes(prints.select("fp", "n", "id"), found).select("fp", "root")
    # rows of one set are reduced before they move; empty sets are equal
    least = F.min(F.struct(F.col("id").isNull(), "id", "key"))
    chosen = prints.groupBy("fp").agg(least.alias("m")).join(roots, "fp").groupBy("root").agg(F.min("m").alias("m")).select("m.key.*")
    chosen, _ = materialise(chosen, "chosen")
    drop(docs.sparkSession, prints_at, known_at)
    # rows equal in every column share a key; the join has dealt them by it already
    return rows.join(chosen, ["_key_a", "_key_b"], "left_semi").dropDuplicates(["_key_a", "_key_b"]).drop("_key_a", "_key_b")


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op6(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("row.doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard similarity 0.8 or more): that with the smallest id."""
    return deduplicated(docs)
