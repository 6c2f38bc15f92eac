"""Exact Jaccard join of documents' word n-grams, with set relations used to skip work.

Equal sets are one node. Shingles have one order for all documents: by how often a sample of the documents holds them, then
by hash, so that what many share comes last (the sample decides the work, never the result). Of a set of n, the first
n - ceil(t * n) + 1 are its prefix; two sets with a similarity of t or more share a shingle of both prefixes.

1. Lists. Every prefix shingle has an index list of (node, size, position). A node takes as its leader the node it most
   often meets at the head of its lists, if their odd sketches allow it; nodes of one leader are a group. Nodes that are
   alone in all lists are done. An odd sketch has one bit, of at least two for each shingle, for an odd number of shingles
   with that hash: two sketches differ in no more bits than the sets differ in shingles.
2. Skipping. Lists are sorted by size and position and cut into blocks; pairs of blocks whose sizes or positions leave too
   few shingles for a similar pair, or that hold one group only, are skipped. What remains gives visits: a node of the
   smaller group visits the larger one. No list gives a row for each of its pairs. A visitor whose sketch is too far from
   the leader's for any member (differing bits obey the triangle inequality) is dropped.
3. Relations. Only now sets are made again, of groups and visitors. Each is kept as its difference from the reference, the
   set of the group's leader: the intersection of two sets follows from the reference's size, what the two lack of it and what
   their differences share.
4. Answers. A group's members and visitors are compared in blocks by their differences: each answer of the reference is
   corrected by the few shingles in which a set differs. Tasks return for each node how many documents it links to there
   and one node it is connected with: never all pairs.

Rows grow with nodes and visits, not with the square of a group; the count of links of a group costs its square in memory,
a block of a bounded number of rows and bytes at a time. A list above ``HOT`` nodes is dealt out by pairs of its blocks.

Defined cases: null or blank text is the empty set, which links with nothing (equals() sets apart what callers make of
it); fewer words than a shingle make one shingle; repeated rows are documents of their own, linked with each other; null ids take
part, and a component's id is its smallest non-null one (null if it has none); texts of any length are cut by segments that
no word spans; an empty table gives an empty result; other columns are not read. Shingles and sets are told apart by
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import chain
from math import ceil, log, log2

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.llm.components import components
from pelagia.llm.shared import bounded, drop, materialise, segments, table

SHINGLE, SIMILARITY = 4, "0.85"  # the contract of op13
SAMPLE, OFTEN, MOST = 16, 4, 500_000  # one document in SAMPLE is sampled; shingles of OFTEN of them are ordered, MOST at most
#: Nodes of a list that are compared in one task; nodes of a block of a list, within it.
HOT, RUN = 8192, 64
#: Rows and bytes of a block of a group; bytes of a task of blocks.
ROWS, BYTES, TASK = 1024, 8 << 20, 16 << 20
#: Keys that are broadcast to fetch texts (16 bytes each); more are joined.
FETCH = 200_000
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _Words(dict):
    """Hashes of short words; a bounded number of them is kept."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, 11)
        if len(word) <= 32:
            if len(self) >= 1 << 17:
                self.clear()
            self[word] = h
        return h


_words = _Words()


def _windows(h: np.ndarray, k: int) -> np.ndarray:
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = out * _P + h[i : len(h) - k + 1 + i]
    out ^= out >> np.uint64(29)
    out *= _Q
    return (out ^ (out >> np.uint64(32))).view(np.int64)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Different hashes of the text's shingles, ascending as signed numbers."""
    carried, out = np.empty(0, np.uint64), []
    for part in segments((text or "").encode("utf-8", "surrogatepass").lower()):
        words = part.split()
        h = np.concatenate([carried, np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))])
        if len(h) >= shingle:
            out.append(np.unique(_windows(h, shingle)))
            h = h[len(h) - shingle + 1 :]
        carried = h
    if not out:
        return _windows(carried, len(carried)) if len(carried) else np.empty(0, np.int64)
    return out[0] if len(out) == 1 else np.unique(np.concatenate(out))


def digest(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), 7)).view(np.int64))


def sketch(s: np.ndarray) -> bytes:
    """The odd sketch of a set: a power of two of bits, at least two for each element."""
    bits = max(64, 1 << (2 * len(s) - 1).bit_length()) if len(s) else 64
    return np.packbits(np.bincount(s & (bits - 1), minlength=bits) & 1, bitorder="little").tobytes()


def differing_bits(x: bytes, of: bytes, t: Fraction) -> int:
    """Bits in which a sketch differs from a leader's, both folded to a size that every set has that may be similar to a
    member of the leader's group, so that all distances of a group obey the triangle inequality."""
    size = max(1, 8 * len(of) >> ceil(2 * log2(1 / t)))
    differ = 0
    for raw in (x, of):
        v, bits = int.from_bytes(raw, "little"), 8 * len(raw)
        while bits > size:
            bits //= 2
            v = (v >> bits) ^ (v & ((1 << bits) - 1))
        differ ^= v
    return differ.bit_count()


def prefix(s: np.ndarray, t: Fraction, often: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """often: the sample's frequent shingles, ascending; counts: of each."""
    n = len(s)
    p = n - -(-n * t.numerator // t.denominator) + 1 if n else 0
    if len(often):
        at = np.minimum(np.searchsorted(often, s), len(often) - 1)
        count = np.where(often[at] == s, counts[at], 0)
        rare = np.flatnonzero(count == 0)
        s = s[rare[:p]] if len(rare) >= p else s[np.argsort(count, kind="stable")]
    return s[:p]


def _frequent(docs: DataFrame, text: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    sets = F.pandas_udf(lambda x: pd.Series([shingle_set(v, shingle) for v in x]), "array<long>")
    some = docs.filter(F.pmod(F.xxhash64(text), F.lit(SAMPLE)) == 0).select(F.explode(sets(F.col(text))).alias("s"))
    got = some.groupBy("s").count().filter(F.col("count") >= OFTEN).orderBy(F.desc("count"), "s").limit(MOST).toPandas().sort_values("s")
    return got["s"].to_numpy(np.int64), got["count"].to_numpy(np.int64)


def sets_of(rows: DataFrame, shingle: int, similarity: str) -> DataFrame:
    """rows with a column ``text`` in place of which come fp (of the set), n (its size), prefix (array<long>) and sketch."""
    t = Fraction(similarity)
    sent = rows.sparkSession.sparkContext.broadcast(_frequent(rows, "text", shingle))

    def made(x: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(v, shingle) for v in x]
        return pd.DataFrame({"fp": np.array([digest(s) for s in sets], np.int64), "n": np.array([len(s) for s in sets], np.int32), "prefix": [prefix(s, t, *sent.value) for s in sets], "sketch": [sketch(s) for s in sets]})

    made.__annotations__ = {"x": pd.Series, "return": pd.DataFrame}
    found = F.pandas_udf(made, "fp long, n int, prefix array<long>, sketch binary")
    return rows.withColumn("_p", found(F.col("text"))).select(*[c for c in rows.columns if c != "text"], "_p.*")


def _heads(t: Fraction, hot: int):
    """From rows (s, n, fp, pos), sorted so: those with another node of fitting size in their list, with the list's head of
    their band of sizes as leader; and for each list above hot a row without fp, whose leader is the list's length."""
    width = -log(t)
    names = ["s", "n", "pos", "fp", "leader"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last row, not yet decided, and the length of its list so far
        s, n, fp, pos, lead, mate, length = (*(np.empty(0, np.int64) for _ in range(5)), np.empty(0, bool), 0)
        for b in chain(batches, [None]):
            kept = len(s)
            if b is not None:
                if not b.num_rows:
                    continue
                s, n, fp, pos = (np.concatenate([old, b.column(c).to_numpy(zero_copy_only=False).astype(np.int64)]) for old, c in ((s, "s"), (n, "n"), (fp, "fp"), (pos, "pos")))
                band = np.floor(np.log(n) / width)
                start = np.r_[True, (s[1:] != s[:-1]) | (band[1:] != band[:-1])]
                at = np.maximum.accumulate(np.where(start, np.arange(len(s)), 0))
                lead = np.where(at < kept, lead[0], fp[at]) if kept else fp[at]
                fits = (s[1:] == s[:-1]) & (n[:-1] * t.denominator >= n[1:] * t.numerator)
                mate = np.r_[mate if kept else [False], fits] | np.r_[fits, False]
                begin = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
                lengths = np.diff(np.r_[begin, len(s)])
                lengths[0] += length - kept
                length = int(lengths[-1])
                ended, lengths = s[begin[:-1]], lengths[:-1]
                last = slice(len(s) - 1, len(s))
            else:
                ended, lengths = s, np.full(kept, length)
                last = slice(kept, kept)
            some, long_ = np.flatnonzero(mate[: last.start]), np.flatnonzero(lengths > hot)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(s[some]), pa.array(n[some].astype(np.int32)), pa.array(pos[some].astype(np.int32)), pa.array(fp[some]), pa.array(lead[some])], names=names)
            if len(long_):
                none = lambda kind, k=len(long_): pa.nulls(k, kind)
                yield pa.RecordBatch.from_arrays([pa.array(ended[long_]), none(pa.int32()), none(pa.int32()), none(pa.int64()), pa.array(lengths[long_])], names=names)
            s, n, fp, pos, lead, mate = s[last], n[last], fp[last], pos[last], lead[last], mate[last]

    return run


def _fit(n: np.ndarray, pos: np.ndarray, g: np.ndarray, a: np.ndarray, b: np.ndarray, t: Fraction) -> np.ndarray:
    """Whether the rows a and b of a list can be similar, this being their first common shingle, and are of different groups."""
    least = -(-(n[a] + n[b]) * t.numerator // (t.denominator + t.numerator))
    sizes = np.minimum(n[a], n[b]) * t.denominator >= np.maximum(n[a], n[b]) * t.numerator
    return (g[a] != g[b]) & sizes & (np.minimum(n[a] - pos[a], n[b] - pos[b]) >= least)


def _list_pairs(n: np.ndarray, pos: np.ndarray, g: np.ndarray, side: np.ndarray, t: Fraction, size: int = RUN) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of rows of a long list (sorted by size and position) that may be similar. side: 0, or 1 and 2 for the two
    blocks of a list that was dealt out, of which only pairs across are wanted."""
    blocks = [np.arange(i, min(i + size, len(n))) for i in range(0, len(n), size)]
    least, most = [int(n[b].min()) for b in blocks], [int(n[b].max()) for b in blocks]
    left = [int((n[b] - pos[b]).max()) for b in blocks]
    only = [int(g[b[0]]) if (g[b] == g[b[0]]).all() else None for b in blocks]
    for i, a in enumerate(blocks):
        for j in range(i, len(blocks)):
            if most[i] * t.denominator < least[j] * t.numerator:
                break  # all further ones are larger
            if min(left[i], left[j]) * (t.denominator + t.numerator) < (least[i] + least[j]) * t.numerator or (only[i] is not None and only[i] == only[j]):
                continue
            x, y = np.repeat(a, len(blocks[j])), np.tile(blocks[j], len(a))
            ok = _fit(n, pos, g, x, y, t) & (x < y) & ((side[x] == 0) | (side[x] != side[y]))
            yield x[ok], y[ok]


def _visits(t: Fraction):
    """From rows (s, i, j, side, n, pos, fp, g, size), sorted so: (host, visitor) of the pairs of nodes that may be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["s", "i", "j", "side", "n", "pos", "fp", "g", "size"]
        old = [np.empty(0, np.int64) for _ in names]
        for b in chain(batches, [None]):
            x = old if b is None else [np.concatenate([o, b.column(c).to_numpy(zero_copy_only=False).astype(np.int64)]) for o, c in zip(old, names, strict=True)]
            if not len(x[0]):
                continue
            change = np.flatnonzero((x[0][1:] != x[0][:-1]) | (x[1][1:] != x[1][:-1]) | (x[2][1:] != x[2][:-1])) + 1
            end = len(x[0]) if b is None else (change[-1] if len(change) else 0)  # the last list may go on
            starts = np.r_[0, change[change < end]]
            old = [c[end:] for c in x]
            if not end:
                continue
            _, _, _, side, n, pos, fp, g, size = (c[:end] for c in x)
            lengths = np.diff(np.r_[starts, end])
            of = np.repeat(np.arange(len(starts)), lengths)
            short = lengths[of] <= 16
            ps, qs = [], []
            for k in range(1, min(16, end)):
                p = np.flatnonzero(short[:-k] & (of[:-k] == of[k:]))
                if not len(p):
                    break
                ok = _fit(n, pos, g, p, p + k, t) & ((side[p] == 0) | (side[p] != side[p + k]))
                ps.append(p[ok])
                qs.append(p[ok] + k)
            for r in np.flatnonzero(lengths > 16):
                at = np.arange(starts[r], starts[r] + lengths[r])
                at = at[np.lexsort((pos[at], n[at]))]
                for p, q in _list_pairs(n[at], pos[at], g[at], side[at], t):
                    ps.append(at[p])
                    qs.append(at[q])
            p, q = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (ps, qs))
            hosts = (size[p] > size[q]) | ((size[p] == size[q]) & (g[p] > g[q]))
            rows = np.unique(np.stack([np.where(hosts, g[p], g[q]), np.where(hosts, fp[q], fp[p])]), axis=1)
            if rows.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1])], names=["g", "fp"])

    return run


def shared_counts(diffs: list[np.ndarray], often: int = 128) -> np.ndarray:
    """How many elements every two of the sets share."""
    k = len(diffs)
    common = np.zeros((k, k), np.int32)
    row = np.repeat(np.arange(k), [len(d) for d in diffs])
    _, token, count = np.unique(np.concatenate(diffs) if k else np.empty(0, np.int64), return_inverse=True, return_counts=True)
    many = np.flatnonzero(count >= often)
    for a in range(0, len(many), 1024):
        column = np.full(len(count), -1)
        column[many[a : a + 1024]] = np.arange(len(many[a : a + 1024]))
        held = column[token] >= 0
        m = np.zeros((k, len(many[a : a + 1024])), np.float32)
        m[row[held], column[token[held]]] = 1
        common += (m @ m.T).astype(np.int32)
    some = np.flatnonzero((count[token] >= 2) & (count[token] < often))
    some = some[np.argsort(token[some], kind="stable")]
    r, c = row[some], token[some]
    for shift in range(1, often):
        same = np.flatnonzero(c[:-shift] == c[shift:]) if shift < len(c) else ()
        if not len(same):
            break
        np.add.at(common, (r[same], r[same + shift]), 1)
        np.add.at(common, (r[same + shift], r[same]), 1)
    np.fill_diagonal(common, [len(d) for d in diffs])
    return common


def answers(x: pd.DataFrame, t: Fraction) -> pd.DataFrame:
    """(a, b, links) of the nodes of two blocks of a group (or of one): fp, n, gone, ref (sizes), diff, copies, member, left."""
    x = x.sort_values("fp", ignore_index=True)  # of those connected, all name the smallest
    fp, n, gone, ref, copies = (x[c].to_numpy(np.int64) for c in ("fp", "n", "gone", "ref", "copies"))
    member, left = x["member"].to_numpy(bool), x["left"].to_numpy(bool)
    both = ref[:, None] - gone[:, None] - gone[None] + shared_counts([np.asarray(d, np.int64) for d in x["diff"]])
    linked = both * (t.denominator + t.numerator) >= (n[:, None] + n[None]) * t.numerator
    linked &= member[:, None] | member[None]
    if not (x["i"].iloc[0] == x["j"].iloc[0]):
        linked &= left[:, None] != left[None]
    np.fill_diagonal(linked, False)
    label = np.arange(len(fp))
    while True:
        new = np.minimum(label, np.where(linked, label[None], len(fp)).min(1, initial=len(fp)))
        if (new == label).all():
            break
        label = new
    some = np.flatnonzero(linked.any(1))
    return pd.DataFrame({"a": fp[some], "b": fp[label[some]], "links": (linked[some] @ copies).astype(np.int64)})


def equals(prints: DataFrame) -> DataFrame:
    """fp, n, id (the smallest), copies of the nodes of prints (fp, n, id)."""
    return prints.groupBy("fp").agg(F.any_value("n").alias("n"), F.min("id").alias("id"), F.count("*").alias("copies"))


def fetched(wanted: DataFrame, texts: DataFrame, shingle: int, *more: str) -> DataFrame:
    """fp, more and the set of every row of wanted (fp, key, more), from texts (key, text)."""
    found = texts.join(F.broadcast(wanted) if wanted.count() <= FETCH else wanted, "key").dropDuplicates(["fp"])
    udf = F.pandas_udf(lambda x: pd.Series([shingle_set(v, shingle) for v in x]), "array<long>")
    return found.select("fp", *more, udf(F.col("text")).alias("set"))


def confirmed(pairs: DataFrame, prints: DataFrame, texts: DataFrame, shingle: int, similarity: str, rows: int = ROWS) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose sets are similar. A set b of many pairs is there once for each ``rows`` of them."""
    t, spark = Fraction(similarity), prints.sparkSession
    needed = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    wanted, wanted_at = materialise(prints.groupBy("fp").agg(F.min("key").alias("key")).join(needed, "fp"), "wanted")
    sets, sets_at = materialise(fetched(wanted, texts, shingle), "sets")
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / rows).cast("int").alias("parts"))
    dealt = pairs.join(parts, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    refs = sets.select(F.col("fp").alias("b"), F.col("set").alias("y")).join(parts, "b").select("b", "y", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    met = dealt.join(sets.select(F.col("fp").alias("a"), F.col("set").alias("x")), "a").join(refs, ["b", "part"])
    both = F.size(F.array_intersect("x", "y"))
    good = met.filter(both * (t.denominator + t.numerator) >= (F.size("x") + F.size("y")) * t.numerator).select("a", "b")
    good, _ = materialise(good, "confirmed")
    drop(spark, wanted_at, sets_at)
    return good


def links(prints: DataFrame, texts: DataFrame, shingle: int, similarity: str, hot: int = HOT, rows: int = ROWS, *, known: DataFrame | None = None) -> DataFrame:
    """(a, b, links): rows that connect all similar sets, transitively; the sum of a node's links is the number of documents
    of other sets that it links to. prints: (key, fp, n, prefix, sketch), a row for each document; texts: (key, text).

    known: (fp, root) of nodes that are connected already. A group that lies in one root with all its visitors is left out:
    its rows could connect nothing more. The counts of links are then incomplete, the components are not."""
    t, spark = Fraction(similarity), prints.sparkSession
    any_ = [F.any_value(c).alias(c) for c in ("n", "prefix", "sketch")]
    nodes = prints.filter("n > 0").groupBy("fp").agg(*any_, F.min("key").alias("key"), F.count("*").alias("copies"))
    nodes, nodes_at = materialise(nodes, "nodes")
    bits = F.pandas_udf(lambda x, of: pd.Series([differing_bits(bytes(a), bytes(b), t) for a, b in zip(x, of, strict=True)], dtype="int64"), "long")

    def allowed(n: Column, m: Column) -> Column:
        """The shingles in which two similar sets of these sizes can differ."""
        return F.floor((n + m) * (t.denominator - t.numerator) / (t.denominator + t.numerator) + 1e-9)

    def sketched(df: DataFrame, fp: str, suffix: str) -> DataFrame:
        return df.join(nodes.select(F.col("fp").alias(fp), F.col("n").alias(f"n{suffix}"), F.col("sketch").alias(f"sketch{suffix}")), fp)

    # 1: leaders, from the heads of the lists; only rows that meet another go on
    listed = nodes.select("n", "fp", F.posexplode("prefix").alias("pos", "s")).repartition("s").sortWithinPartitions("s", "n", "fp")
    mates, mates_at = materialise(listed.select("s", "n", "fp", "pos").mapInArrow(_heads(t, hot), "s long, n int, pos int, fp long, leader long"), "mates")
    large, mates = mates.filter("fp is null").select("s", F.col("leader").alias("many")), mates.filter("fp is not null")
    met, met_at = materialise(mates.groupBy("fp", "leader").agg(F.count("*").alias("count"), F.max("n").alias("n")), "met")
    pairs = sketched(sketched(met.filter("fp <> leader"), "fp", "x"), "leader", "y").withColumn("away", bits("sketchx", "sketchy"))
    fit = pairs.filter(F.col("away") <= 2 * allowed(F.col("nx"), F.col("ny"))).select("fp", "leader", "count", "n", "away")
    own = met.select("fp", F.col("fp").alias("leader"), F.when(F.col("leader") == F.col("fp"), F.col("count")).otherwise(0).alias("count"), "n", F.lit(0).cast("long").alias("away"))
    best = fit.unionByName(own).groupBy("fp").agg(F.max(F.struct("count", "leader", "away")).alias("m"), F.max("n").alias("n"))
    best, best_at = materialise(best.select("fp", "n", F.col("m.leader").alias("g"), F.col("m.away").alias("away")), "leaders")
    # a node that is alone with another's leader is its own
    alone = best.groupBy("g").agg(F.count("*").alias("size")).filter("size = 1").select("g", F.lit(True).alias("alone"))
    best = best.join(alone, "g", "left").select("fp", "n", F.when(F.col("alone"), F.col("fp")).otherwise(F.col("g")).alias("g"), F.when(F.col("alone"), 0).otherwise(F.col("away")).alias("away"))
    best, grouped_at = materialise(best, "grouped")
    sizes, sizes_at = materialise(best.groupBy("g").agg(F.count("*").alias("size"), F.max("away").alias("away"), F.max("n").alias("most")), "groups")

    # 2: visits, from the lists in blocks
    grouped = best.select("fp", "n", "g").join(sizes.select("g", "size"), "g")
    listed = mates.select("s", "n", "pos", "fp").join(grouped.select("fp", "g", "size"), "fp")
    one = {"i": F.lit(0), "j": F.lit(0), "side": F.lit(0)}
    if large.head(1):
        cut = listed.join(large, "s").withColumn("blocks", F.ceil(2 * F.col("many") / hot).cast("int"))
        cut = cut.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        low, high = F.least("mine", "other"), F.greatest("mine", "other")
        cut = cut.withColumns({"i": low, "j": high, "side": F.when(low == high, 0).when(F.col("mine") == low, 1).otherwise(2)})
        listed = listed.join(large.select("s"), "s", "left_anti").withColumns(one).unionByName(cut.drop("many", "blocks", "mine", "other"))
    else:
        listed = listed.withColumns(one)
    order = ["s", "i", "j", "side", "n", "pos", "fp", "g", "size"]
    visits = listed.select(*order).repartition("s", "i", "j").sortWithinPartitions("s", "i", "j", "n", "pos")
    visits = visits.mapInArrow(_visits(t), "g long, fp long").distinct().join(sizes, "g")
    near = bits("sketchx", "sketchy") <= F.col("away") + allowed(F.col("nx"), F.col("most"))
    visits = sketched(sketched(visits, "fp", "x"), "g", "y").filter(near).select("fp", F.col("nx").alias("n"), "g", "size", F.lit(False).alias("member"))
    visits, visits_at = materialise(visits, "visits")

    # 3: sets of groups and visitors, as differences from the group's reference, which is there once for each of its blocks
    several, several_at = materialise(grouped.filter("size > 1").select("fp", "n", "g", "size", F.lit(True).alias("member")).unionByName(visits), "several")
    if known is not None:
        placed_in = several.select("g", "fp").unionByName(several.select("g", F.col("g").alias("fp")).distinct()).join(known, "fp", "left")
        root = F.coalesce("root", "fp")
        unsettled = placed_in.groupBy("g").agg(F.min(root).alias("least"), F.max(root).alias("most")).filter("least <> most").select("g")
        several, open_at = materialise(several.join(unsettled, "g", "left_semi"), "open")
        drop(spark, several_at)
        several_at = open_at
    needed = several.select("fp").unionByName(several.select(F.col("g").alias("fp"))).distinct()
    wanted, wanted_at = materialise(nodes.select("fp", "n", "copies", "key").join(needed, "fp"), "wanted")
    sets, sets_at = materialise(fetched(wanted, texts, shingle, "copies"), "sets")
    blocks = several.groupBy("g").agg(F.greatest(F.ceil(F.count("*") / rows), F.ceil(F.sum(4 * F.col("n") + 64) / BYTES)).cast("int").alias("blocks"))
    meets = several.join(blocks, "g").withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).join(sets, "fp")
    refs = sets.select(F.col("fp").alias("g"), F.col("set").alias("reference")).join(blocks, "g").select("g", "reference", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("mine"))
    gone, new = F.array_except("reference", "set"), F.array_except("set", "reference")
    placed = meets.join(refs, ["g", "mine"]).withColumns({"gone": F.size(gone), "diff": F.concat(gone, new), "ref": F.size("reference")})
    placed, placed_at = materialise(placed.drop("reference", "set"), "placed")

    # 4: answers; a group of one node is its reference, so a visitor's difference is the answer
    single = placed.filter("size = 1").filter((F.col("ref") - F.col("gone")) * (t.denominator + t.numerator) >= (F.col("ref") + F.col("n")) * t.numerator)
    single = single.select(F.col("fp").alias("a"), F.col("g").alias("b"), "copies").join(nodes.select(F.col("fp").alias("b"), F.col("copies").alias("theirs")), "b")
    direct = F.inline(F.array(F.struct(F.col("a"), F.col("b"), F.col("theirs").alias("links")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("copies").alias("links"))))
    cut = placed.filter("size > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other"), "left": F.col("mine") <= F.col("other")})
    total = cut.agg(F.sum(8 * F.size("diff") + 64), F.count("*")).first()
    tasks = max(1, ceil((total[0] or 0) / TASK), ceil(total[1] / (4 * rows)))

    def answer(task: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": [], "b": [], "links": []}, dtype="int64")
        return pd.concat([none, *(answers(x, t) for _, x in task.groupby(["g", "i", "j"], sort=False) if len(x) > 1)])

    cut = cut.select("g", "i", "j", "left", "member", "fp", "n", "gone", "ref", "copies", "diff", F.pmod(F.xxhash64("g", "i", "j"), F.lit(tasks)).alias("task"))
    found = cut.groupBy("task").applyInPandas(answer, "a long, b long, links long").unionByName(single.select(direct))
    found, _ = materialise(found, "links")
    drop(spark, nodes_at, mates_at, met_at, best_at, grouped_at, sizes_at, visits_at, several_at, wanted_at, sets_at, placed_at)
    return found


def classes(prints: DataFrame, found: DataFrame) -> DataFrame:
    """fp, n, copies, component_id and links of every node, from prints (fp, n, id) and links()."""
    nodes = equals(prints)
    roots = components(found.select("a", "b")).withColumnRenamed("node", "fp")
    total = found.groupBy(F.col("a").alias("fp")).agg(F.sum("links").alias("links"))
    rooted = nodes.join(roots, "fp", "left").join(total, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "n", "copies", "component_id", F.coalesce("links", F.lit(0)).alias("links"), "root")


def joined(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, similarity: str = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (documents it links with) of every document."""
    bounded(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    keyed = rows.withColumn("key", F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(2), "text").alias("b")))
    prints, _ = materialise(sets_of(keyed, shingle, similarity), "prints")
    of, _ = materialise(classes(prints.filter("n > 0").select("fp", "n", "id"), links(prints, keyed.select("key", "text"), shingle, similarity)), "classes")
    linked = prints.select("id", "fp", "n").join(of.select("fp", "copies", "component_id", "links"), "fp", "left")
    component: Column = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    number = F.when(F.col("n") > 0, F.col("copies") - 1 + F.col("links")).otherwise(0)
    return linked.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), number.cast("long").alias("n_links"))


def op13(spark, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"))


OP13_SQL = """
with recursive docs as materialized (select row_number() over () as r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
shingles as materialized (select distinct r, unnest(case when len(w) > 3 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from docs),
sizes as materialized (select r, count(*) as n from shingles group by r),
common as (select a.r as x, b.r as y, count(*) as c from shingles a join shingles b on a.s = b.s and a.r < b.r group by all),
links as materialized (select x, y from common join sizes a on a.r = x join sizes b on b.r = y where 100 * c >= 85 * (a.n + b.n - c)),
both_ways as materialized (select x, y from links union all select y, x from links),
reach as (select r, r as to_r from docs union select reach.r, l.y from reach join both_ways l on l.x = reach.to_r),
least as (select reach.r, min(d.doc_id) as component_id from reach join docs d on d.r = reach.to_r group by reach.r),
degree as (select x as r, count(*) as n_links from both_ways group by x)
select doc_id, coalesce(n, 0) as n_shingles, component_id, coalesce(n_links, 0) as n_links
from docs join least using (r) left join sizes using (r) left join degree using (r)
"""
