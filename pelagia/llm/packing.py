"""Best-fit packing of token sequences with a swap-based local search.

Documents are cut into pieces of at most ``size`` tokens, the first piece being the shorter one. How many pieces there
are of each length (at most ``size`` numbers, whatever the corpus) decides the packing: best-fit decreasing places all
pieces of a length at once into bins of equal content, then a local search moves pieces or exchanges one for one and
two for one between underfull bins, each time increasing the squared fill, until bins empty. The result is at most a
few thousand kinds of bins with a multiplicity; pieces find their places by their rank among pieces of their length.

Defined cases: null text is empty and packs as its end token alone; added tokens of the vocabulary's file that stand in a
text are tokens, as in ``tokenizers``; repeated rows are packed once each; null ids are
kept; an empty table gives an empty result; the ids of a text of any length are held in one task; columns other than the id and
the text are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelagia.llm.bpe import encode_added
from pelagia.llm.shared import bounded, materialise, table

SIZE = 2048
#: Pieces of one length that are numbered in one task.
RANKED = 200_000
#: Bins that the local search fails to empty, one after the other, before it ends.
PATIENCE = 200
#: Kinds of bins with the same room that it looks at for an exchange.
PARTNERS = 64

Bin = tuple[tuple[int, int], ...]  # (length, how many), longest first


def fill(b: Bin) -> int:
    return sum(x * n for x, n in b)


def _add(b: Bin, length: int, n: int) -> Bin:
    c = Counter(dict(b))
    c[length] += n
    return tuple(sorted(((x, k) for x, k in c.items() if k), reverse=True))


def best_fit(counts: dict[int, int], size: int = SIZE) -> dict[Bin, int]:
    """Best-fit decreasing on counts: bins of equal content with their number. At most two kinds are added per length."""
    by_room: list[dict[Bin, int]] = [defaultdict(int) for _ in range(size + 1)]
    used = 0  # bit r: there are bins with room r

    def put(b: Bin, n: int, room: int) -> None:
        nonlocal used
        if n:
            by_room[room][b] += n
            used |= 1 << room

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            above = used >> length
            if not above:
                each = size // length
                put(((length, each),), left // each, size - each * length)
                if left % each:
                    put(((length, left % each),), 1, size - left % each * length)
                break
            room = length + (above & -above).bit_length() - 1
            kind, there = next(iter(by_room[room].items()))
            each = min(room // length, left)
            n = min(there, left // each)
            if n == there:
                del by_room[room][kind]
                if not by_room[room]:
                    used &= ~(1 << room)
            else:
                by_room[room][kind] = there - n
            put(_add(kind, length, each), n, room - each * length)
            left -= n * each
    out: Counter = Counter()
    for kinds in by_room:
        out.update(kinds)
    return dict(out)


def _exchange(a: Bin, b: Bin, room: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
    """What goes from a to b and back, so that b gets fuller by as much as its room allows: moves, 1-1, 2-1 and 1-2."""
    best, found = 0, None
    xs, ys = [x for x, _ in a], [y for y, _ in b]
    pairs = lambda c: [*combinations([x for x, _ in c], 2), *((x, x) for x, n in c if n > 1)]
    ways = [((x,), ()) for x in xs] + [((x,), (y,)) for x in xs for y in ys] + [(p, (y,)) for p in pairs(a) for y in ys] + [((x,), p) for x in xs for p in pairs(b)]
    for give, take in ways:
        gain = sum(give) - sum(take)
        if best < gain <= room:
            best, found = gain, (give, take)
            if gain == room:
                break
    return found


def local_search(bins: dict[Bin, int], size: int = SIZE, patience: int = PATIENCE) -> dict[Bin, int]:
    """Empty the emptiest bins into others at least as full, by the largest exchanges there are. Every exchange increases
    the sum of squared fills. Ends at the least number of bins there can be, when no bin is left to try, or when
    ``patience`` bins one after the other could not be emptied."""
    bins = Counter(bins)
    least = -(-sum(fill(b) * n for b, n in bins.items()) // size)
    total = sum(bins.values())
    by_room: dict[int, dict[Bin, None]] = defaultdict(dict)
    for b in sorted(bins):
        by_room[size - fill(b)][b] = None
    tried: set[Bin] = set()

    def put(b: Bin, n: int) -> None:
        bins[b] += n
        if bins[b]:
            by_room[size - fill(b)][b] = None
        else:
            del bins[b], by_room[size - fill(b)][b]

    def exchange(a: Bin) -> tuple[Bin, tuple[int, ...], tuple[int, ...]] | None:
        best, found = 0, None
        for room in range(size - fill(a), 0, -1):
            if best >= room:
                break
            for b in islice(by_room.get(room, ()), PARTNERS):
                if (b != a or bins[a] > 1) and (got := _exchange(a, b, room)) and sum(got[0]) - sum(got[1]) > best:
                    best, found = sum(got[0]) - sum(got[1]), (b, *got)
                    if best == room:
                        break
        return found

    failed, moved = 0, False
    while total > least and failed < patience:
        a = next((b for r in range(size - 1, 0, -1) for b in by_room.get(r, ()) if b not in tried), None)
        if a is None:
            if not moved:
                break
            moved = False
            tried.clear()
            continue
        tried.add(a)
        at, n = a, bins[a]
        while at and (found := exchange(at)):
            moved = True
            b, give, take = found
            n = min(n, bins[at] // 2) if at == b else min(n, bins[b])
            new_a, new_b = at, b
            for x in give:
                new_a, new_b = _add(new_a, x, -1), _add(new_b, x, 1)
            for y in take:
                new_a, new_b = _add(new_a, y, 1), _add(new_b, y, -1)
            put(at, -n)
            put(b, -n)
            put(new_b, n)
            if new_a:
                put(new_a, n)
                tried.add(new_a)
            at = new_a
        failed += 1
        if not at:
            total -= n
            failed = 0
            tried.discard(a)
    return dict(bins)


def places(bins: dict[Bin, int]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, number of bins, first sequence, offset) in the order of ranks."""
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    ranks: Counter = Counter()
    sequence = 0
    for kind, n in sorted(bins.items()):
        at = 0
        for length, each in kind:
            rows[length].append((ranks[length], n, sequence, at))
            ranks[length] += n * each
            at += length * each
        sequence += n
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def cut(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    first = n % size or min(n, size)
    return [(0, first), *((s, size) for s in range(first, n, size))]


def pack(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", size: int = SIZE, end: int = 0) -> DataFrame:
    """A row per piece with its sequence and offset."""
    bounded(docs.sparkSession)
    id_type = docs.schema[doc_id].dataType
    rows = docs.select(F.col(f"`{doc_id}`").cast("string").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, t in zip(b["doc_id"], b["text"], strict=True):
                ids = np.array([*encode_added(path, t), end], "<u4")
                out += [(d, i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(cut(len(ids), size))]
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    made = rows.mapInPandas(pieces, "doc_id string, piece int, start long, length long, ids_crc32 long")
    # equal rows differ in the hash, which is written with them
    made, _ = materialise(made.withColumn("hash", F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())), "pieces")
    totals = {r["length"]: r["count"] for r in made.groupBy("length").count().collect()}  # at most ``size`` rows
    where = places(local_search(best_fit(totals, size), size))
    salts = max(16, -(-sum(totals.values()) // RANKED))
    salted = made.withColumn("salt", F.pmod("hash", F.lit(salts))).drop("hash")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    ranked = salted.join(offsets, ["length", "salt"]).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)

    def find(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"sequence_id": np.zeros(len(length), np.int64), "offset": np.zeros(len(length), np.int64)})
        n, r = length.to_numpy(), rank.to_numpy()
        for x in np.unique(n):
            mine, rows = n == x, where[int(x)]
            hit = rows[np.searchsorted(rows[:, 0], r[mine], side="right") - 1]
            turn, index = np.divmod(r[mine] - hit[:, 0], hit[:, 1])
            out.loc[mine, "sequence_id"] = hit[:, 2] + index
            out.loc[mine, "offset"] = hit[:, 3] + turn * x
        return out

    found = F.pandas_udf(find, "sequence_id long, offset long")(F.col("length"), F.col("rank"))
    return ranked.withColumn("place", found).select(F.col("doc_id").cast(id_type).alias("doc_id"), "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset")


def op7(spark, sf_dir: str) -> DataFrame:
    return stage(spark, table(spark, sf_dir, "documents"), sf_dir)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: where every piece of every document goes."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
