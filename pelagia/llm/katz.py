"""Katz backoff bigram scoring over a corpus of any size.

    P(w | h) = d(c(h,w)) c(h,w) / c(h)      if c(h,w) > 0
             = alpha(h) P(w)                otherwise, alpha making the sum over all words exactly 1,
    P(w)     = d(c(w)) c(w) / N             for training words; one unknown word has the rest.

d are Good-Turing discounts d(r) = r* / r in Katz's form for r <= 5 and 1 above; where the counts of counts do not give values in
(0, 1), counts are lowered by one half instead. A history whose followers all have counts above 5 lowers each by one
half, so that something is left for other words. A text's first word follows the end token, and
its last token is the end token, so the end token is a history too. A history not seen in training has P(w).

Work moves as sorted, compressed arrays, not as a row per token:
  A  tokenise once into blocks of texts (hashes of their distinct words, tokens as indices);
  B  by word: add the blocks' training counts, number the words, answer every block that asked;
  C  by block: sort the block's distinct bigrams, ask about them;
  D  by history: add counts, sum what backoff weights need, answer the blocks (very frequent histories are dealt out
     by their followers too and their sums added afterwards);
  F  by block: evaluate every token and add up each text.
What B and D write are word and bigram counts in tables partitioned by kind. train() makes of them a model of plain tables
(words, bigrams, backoff weights), by which score_stored() judges any other texts.

Words are told apart by 64-bit hashes. Defined cases: null text is empty (one end token); null ids train and are kept; repeated
rows count and return once each; of a text its tokens' hashes are held, and a block is at least one text; without training texts all tokens are unknown and score 0; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.llm.shared import bounded, crc_mod, materialise

K = 5
#: Folders of each table of a stored model.
PARTITIONS = 64
BLOCK, PART = 2_000_000, 2_000_000  # tokens of a block; tokens for each part of the word and history space


def pack(a: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    import zstandard

    a = np.ascontiguousarray(a)
    width = a.dtype.itemsize
    if a.dtype.kind in "iu" and len(a):
        top = int(a.max())
        width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
        if int(a.min()) < 0:
            width = 8
        a = a.astype(f"<{'i' if width == 8 and a.dtype.kind == 'i' else 'u'}{width}")
    planes = a.view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b""
    return f"{a.dtype.str},".encode() + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(b: bytes, dtype: str = "i8") -> np.ndarray:
    import zstandard

    kind, _, data = bytes(b).partition(b",")
    raw = zstandard.ZstdDecompressor().decompress(data)
    d = np.dtype(kind.decode())
    if not raw:
        return np.empty(0, dtype)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(d.itemsize, -1).T).view(d).ravel().astype(dtype, copy=False)


def discounts(n_r: list[float], k: int = K) -> np.ndarray:
    """d[r] for r = 0 .. k; n_r[r] is the number of types with count r, for r up to k + 1."""
    d = np.ones(k + 1)
    tail = (k + 1) * n_r[k + 1] / n_r[1] if n_r[1] else 1.0
    for r in range(1, k + 1):
        d[r] = ((r + 1) * n_r[r + 1] / (r * n_r[r]) - tail) / (1 - tail) if n_r[r] and tail < 1 else 0.0
    if not ((d[1:] > 0) & (d[1:] < 1)).all():
        r = np.arange(1, k + 1)
        d[1:] = (r - 0.5) / r
    return d


class Words:
    """Unigram probabilities by training count."""

    def __init__(self, n: int, types: int, n_r: list[float]) -> None:
        self.n, self.types, self.d = n, types, discounts(n_r)
        r = np.arange(1, K + 1)
        self.unknown = float(((1 - self.d[1:]) * r * np.array(n_r[1 : K + 1])).sum() / n) if n else 1.0
        if self.unknown <= 0:  # every count is above K: each is lowered by one half
            self.unknown = 0.5 * types / n
            self.half = True
        else:
            self.half = False

    def p(self, c: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.ones(len(c))
        p = (c - 0.5) / self.n if self.half else np.where(c <= K, self.d[np.minimum(c, K)], 1.0) * c / self.n
        return np.where(c > 0, p, self.unknown)


def _blocks(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        h = xxhash.xxh3_64_intdigest
        end = h(b" ")  # no word holds a space
        docs, words, n = [], [], 0

        def flush() -> pd.DataFrame:
            vocab, inverse, count = np.unique(np.concatenate([w for w in words]), return_inverse=True, return_counts=True)
            lengths = np.array([len(w) for w in words])
            train = np.repeat(np.array([not x[1] for x in docs]), lengths)
            rank = np.empty(len(vocab), np.int64)
            rank[np.argsort(-count, kind="stable")] = np.arange(len(vocab))  # frequent words get small numbers, which pack better
            return pd.DataFrame({
                "block": [uuid.uuid4().hex], "n": [int(lengths.sum())], "ids": [[x[0] for x in docs]], "held": [[bool(x[1]) for x in docs]], "lengths": [lengths.tolist()],
                "vocab": [vocab.astype("<u8").tobytes()], "ranks": [pack(rank)], "train": [pack(np.bincount(inverse[train], minlength=len(vocab)))], "tokens": [pack(rank[inverse])],
            })

        for b in batches:
            for i, text, held in zip(b["id"], b["text"], b["held"], strict=True):
                found = text.encode("utf-8", "surrogatepass").lower().split()
                found_h = np.fromiter(map(h, found), np.uint64, len(found))
                docs.append((i if isinstance(i, str) else None, held))
                words.append(np.append(found_h, np.uint64(end)))
                n += len(found) + 1
                if n >= size:
                    yield flush()
                    docs, words, n = [], [], 0
        if docs:
            yield flush()

    return run


def _word_part(vocab: np.ndarray, parts: int) -> np.ndarray:
    return ((vocab >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)  # grows with the hash: parts are slices


def _ask_words(parts: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for block, vocab, train in zip(b["block"], b["vocab"], b["train"], strict=True):
                v, t = np.frombuffer(vocab, "<u8"), unpack(train)
                cuts = np.searchsorted(_word_part(v, parts), np.arange(parts + 1))
                got = [(p, block, v[a:z].tobytes(), pack(t[a:z])) for p, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)) if z > a]
                yield pd.DataFrame(got, columns=["part", "block", "vocab", "train"])

    return run


ANSWER = "part int, block string, ids binary, counts binary, vocab binary, stats array<long>, kind string"


def _answer_words(parts: int):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        part = int(g["part"].iloc[0])
        asked = [np.frombuffer(v, "<u8") for v in g["vocab"]]
        vocab, inverse = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([unpack(t) for t in g["train"]]), len(vocab)).astype(np.int64)
        ids = np.full(len(vocab), -1, np.int64)
        seen = np.flatnonzero(total)
        ids[seen[np.argsort(-total[seen], kind="stable")]] = np.arange(len(seen)) * parts + part
        rows, at = [], 0
        for block, a in zip(g["block"], asked, strict=True):
            mine = inverse[at : at + len(a)]
            at += len(a)
            rows.append((part, block, pack(ids[mine] + 1), pack(total[mine]), None, None, "answer"))
        stats = [int(total.sum()), len(seen), *np.bincount(np.minimum(total[seen], K + 2), minlength=K + 3)[1 : K + 2].tolist()]
        rows.append((part, None, pack(ids[seen] + 1), pack(total[seen]), vocab[seen].astype("<u8").tobytes(), stats, "model"))
        return pd.DataFrame(rows, columns=["part", "block", "ids", "counts", "vocab", "stats", "kind"])

    return run


class Pairs:
    """The distinct known bigrams of a block in the order in which it asks: by part, history and word."""

    def __init__(self, block: pd.Series, words: pd.DataFrame, parts: int, hot: int) -> None:
        words = words.sort_values("part")
        ranks = unpack(block["ranks"])
        ids, counts = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
        ids[ranks], counts[ranks] = np.concatenate([unpack(x) for x in words["ids"]]) - 1, np.concatenate([unpack(x) for x in words["counts"]])
        tokens = unpack(block["tokens"])
        self.lengths, self.held = np.array(block["lengths"]), np.array(block["held"], bool)
        self.ends = np.cumsum(self.lengths)
        before = np.concatenate([[0], tokens[:-1]])
        before[self.ends[:-1]] = before[0] = tokens[-1]  # the first word of a text follows an end
        self.count, self.id, self.h_id, self.h_count = counts[tokens], ids[tokens], ids[before], counts[before]
        self.known = self.h_id >= 0  # the history; all unknown words after it are one
        n = len(ranks) + 1
        ids, counts = np.append(ids, -1), np.append(counts, 0)
        key, self.inverse = np.unique((before * n + np.where(self.id >= 0, tokens, n - 1))[self.known], return_inverse=True)
        h, w = key // n, key % n
        part = np.where(counts[h] > hot, (ids[h] * 31 + ids[w] * 1_000_003) % parts, ids[h] % parts)
        order = np.lexsort((ids[w], ids[h], part))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.inverse = place[self.inverse]
        self.part, self.h, self.w, self.w_count = part[order], ids[h[order]], ids[w[order]], counts[w[order]]
        train = np.repeat(~self.held, self.lengths)[self.known]
        self.train = np.bincount(self.inverse[train], minlength=len(order))
        self.cuts = np.searchsorted(self.part, np.arange(parts + 1))
        # histories of each part, in order
        new = np.ones(len(order), bool)
        new[1:] = (self.h[1:] != self.h[:-1]) | (self.part[1:] != self.part[:-1])
        self.history = np.cumsum(new) - 1
        self.histories = self.h[new]


def _ask_pairs(parts: int, hot: int):
    def run(blocks: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        columns = ["part", "block", "h", "w", "w_count", "train"]
        if blocks.empty:
            return pd.DataFrame([], columns=columns)
        x = Pairs(blocks.iloc[0], words, parts, hot)
        rows = []
        for p, (a, z) in enumerate(zip(x.cuts, x.cuts[1:], strict=False)):
            if z > a:
                rows.append((p, blocks["block"].iloc[0], pack(np.diff(x.h[a:z], prepend=0)), pack(x.w[a:z] + 1), pack(x.w_count[a:z]), pack(x.train[a:z])))
        return pd.DataFrame(rows, columns=columns)

    return run


PAIR_ANSWER = "part int, block string, counts binary, n_r array<binary>, big binary, big_types binary, seen binary, h binary, w binary, stats array<long>, kind string"


def _answer_pairs(words: Words, hot_ids: np.ndarray):
    columns = ["part", "block", "counts", "n_r", "big", "big_types", "seen", "h", "w", "stats", "kind"]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        part = int(g["part"].iloc[0])
        hs, ws = [np.cumsum(unpack(x)) for x in g["h"]], [unpack(x) for x in g["w"]]
        h, w = np.concatenate(hs), np.concatenate(ws)
        wide = int(w.max()) + 1
        if int(h.max()) > (2**63 - 1) // wide:
            raise OverflowError("word numbers do not fit a pair key")
        key, first, inverse = np.unique(h * wide + w, return_index=True, return_inverse=True)
        total = np.bincount(inverse, np.concatenate([unpack(x) for x in g["train"]]), len(key)).astype(np.int64)
        p = words.p(np.concatenate([unpack(x) for x in g["w_count"]])[first])
        histories, at = np.unique(key // wide, return_inverse=True)
        m = len(histories)
        n_r = [np.bincount(at[total == r], minlength=m) for r in range(1, K + 1)]
        large = total > K
        big = np.bincount(at[large], total[large], m).astype(np.int64)
        big_types = np.bincount(at[large], minlength=m)
        seen = np.bincount(at[total > 0], p[total > 0], m)
        rows, begin = [], 0
        for block, own in zip(g["block"], hs, strict=True):
            mine = inverse[begin : begin + len(own)]
            begin += len(own)
            u = np.searchsorted(histories, np.unique(own))
            rows.append((part, block, pack(total[mine]), [pack(x[u]) for x in n_r], pack(big[u]), pack(big_types[u]), pack(seen[u]), None, None, None, "answer"))
        stats = np.bincount(np.minimum(total[total > 0], K + 2), minlength=K + 3)[1 : K + 2].tolist()
        some = total > 0
        rows.append((part, None, pack(total[some]), None, None, None, None, pack(np.diff(key[some] // wide, prepend=0)), pack(key[some] % wide), stats, "model"))
        if (at_hot := np.flatnonzero(np.isin(histories, hot_ids))).size:
            rows.append((part, None, None, [pack(x[at_hot]) for x in n_r], pack(big[at_hot]), pack(big_types[at_hot]), pack(seen[at_hot]), pack(histories[at_hot]), None, None, "hot"))
        return pd.DataFrame(rows, columns=columns)

    return run


def _score(words: Words, parts: int, hot: int, d: np.ndarray, hot_sums: dict[int, tuple]):
    def run(blocks: pd.DataFrame, asked: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        block = blocks.iloc[0]
        x = Pairs(block, asked, parts, hot)
        answers = answers.sort_values("part")
        joined = lambda column, kind="i8": np.concatenate([unpack(a, kind) for a in column] or [np.empty(0, kind)])
        c = joined(answers["counts"])
        n_r = np.stack([joined([a[r] for a in answers["n_r"]]) for r in range(K)])
        big, big_types, seen = joined(answers["big"]), joined(answers["big_types"]), joined(answers["seen"], "f8")
        for i in np.flatnonzero(np.isin(x.histories, list(hot_sums))):
            n_r[:, i], big[i], big_types[i], seen[i] = hot_sums[int(x.histories[i])]
        r = np.arange(1, K + 1)[:, None]
        c_h = (r * n_r).sum(0) + big
        half = n_r.sum(0) == 0
        with np.errstate(divide="ignore", invalid="ignore"):
            left = np.where(half, 0.5 * big_types, ((1 - d[1:, None]) * r * n_r).sum(0)) / c_h
            alpha = np.where(c_h > 0, left / (1 - seen), 1.0)
            p_pair = np.where(half[x.history], c - 0.5, np.where(c <= K, d[np.minimum(c, K)], 1.0) * c) / c_h[x.history]
        value = np.log10(words.p(x.count))
        known, at = np.flatnonzero(x.known), x.inverse
        hit = c[at] > 0
        value[known[hit]] = np.log10(p_pair[at[hit]])
        value[known[~hit]] += np.log10(alpha[x.history[at[~hit]]])
        base = np.log10((x.count + 1) / (words.n + words.types + 1))
        starts = x.ends - x.lengths
        add = lambda a: np.add.reduceat(a, starts)
        return pd.DataFrame({"doc_id": list(block["ids"]), "held_out": x.held, "n_tokens": x.lengths, "n_known": add((x.count > 0).astype(np.int64)), "base_score": add(base), "score": add(value)})

    return run


@dataclass
class Counts:
    """What training leaves: texts by block, what words and bigrams were told, and the numbers that discounts need."""

    body: DataFrame
    told: DataFrame
    pairs: DataFrame
    words: Words
    d: np.ndarray
    parts: int
    hot: int


def _hot_sums(pairs: DataFrame) -> dict[int, tuple]:
    """Sums of the very frequent histories over all parts, added up by Spark: at most one row for each part."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for n_r, big, types, seen, h in zip(b["n_r"], b["big"], b["big_types"], b["seen"], b["h"], strict=True):
                yield pd.DataFrame({"h": unpack(h), **{f"n{r}": unpack(a) for r, a in enumerate(n_r)}, "big": unpack(big), "types": unpack(types), "seen": unpack(seen, "f8")})

    columns = [*(f"n{r}" for r in range(K)), "big", "types"]
    made = pairs.filter("kind = 'hot'").select("n_r", "big", "big_types", "seen", "h").mapInPandas(rows, f"h long, {', '.join(f'{c} long' for c in columns)}, seen double")
    found = made.groupBy("h").agg(*[F.sum(c).alias(c) for c in (*columns, "seen")]).collect()
    return {r["h"]: (np.array([r[f"n{i}"] for i in range(K)]), r["big"], r["types"], r["seen"]) for r in found}


def counted(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK, part: int = PART) -> Counts:
    """Steps A to D."""
    bounded(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").cast("string").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), (crc_mod(doc_id, 7) == 2).alias("held"))
    made = rows.mapInPandas(_blocks(block), "block string, n long, ids array<string>, held array<boolean>, lengths array<int>, vocab binary, ranks binary, train binary, tokens binary")
    blocks, _ = materialise(made, "blocks")
    tokens = blocks.agg(F.sum("n")).first()[0] or 0
    parts = max(48, -(-tokens // part))

    asks = blocks.select("block", "vocab", "train").mapInPandas(_ask_words(parts), "part int, block string, vocab binary, train binary")
    told, _ = materialise(asks.groupBy("part").applyInPandas(_answer_words(parts), ANSWER), "words", ["kind"])
    sums = [F.sum(F.get("stats", F.lit(i))) for i in range(K + 3)]
    n, types, *n_r = [int(v or 0) for v in told.filter("kind = 'model'").agg(*sums).first()]
    words = Words(n, types, [0, *n_r])
    hot = max(1000, n // parts)
    frequent = lambda batches: (pd.DataFrame({"id": (unpack(i) - 1)[unpack(c) > hot]}) for b in batches for i, c in zip(b["ids"], b["counts"], strict=True))
    # at most n / hot, that is one for each part
    hot_ids = np.array(sorted(r["id"] for r in told.filter("kind = 'model'").select("ids", "counts").mapInPandas(frequent, "id long").collect()), np.int64)

    body = blocks.select("block", "ids", "held", "lengths", "ranks", "tokens")
    answers = told.filter("kind = 'answer'").select("part", "block", "ids", "counts")
    asks = body.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_ask_pairs(parts, hot), "part int, block string, h binary, w binary, w_count binary, train binary")
    pairs, _ = materialise(asks.groupBy("part").applyInPandas(_answer_pairs(words, hot_ids), PAIR_ANSWER), "pairs", ["kind"])
    n_r = [int(v or 0) for v in pairs.filter("kind = 'model'").agg(*sums[: K + 1]).first()]
    d = discounts([0, *n_r])
    return Counts(body, told, pairs, words, d, parts, hot)


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK, part: int = PART) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    id_type = docs.schema[doc_id].dataType
    c = counted(docs, text, doc_id, block, part)
    told = c.told.filter("kind = 'answer'").select("part", "block", "ids", "counts")
    run = _score(c.words, c.parts, c.hot, c.d, _hot_sums(c.pairs))
    # three tables by block: what was asked and answered comes as one, told apart by its kind
    none = F.lit(None)
    both = told.select("block", "part", "ids", "counts", none.cast("array<binary>").alias("n_r"), *[none.cast("binary").alias(x) for x in ("big", "big_types", "seen")], F.lit(True).alias("word"))
    both = both.unionByName(c.pairs.filter("kind = 'answer'").select("block", "part", none.cast("binary").alias("ids"), "counts", "n_r", "big", "big_types", "seen", F.lit(False).alias("word")))

    def last(b: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        return run(b, t[t["word"]], t[~t["word"]])

    out = c.body.groupBy("block").cogroup(both.groupBy("block")).applyInPandas(last, "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("doc_id").cast(id_type).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(c.words.n).cast("long").alias("train_tokens"), "base_score", "score")


# --- the stored model ----------------------------------------------------------------------------------------------


def train(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK, part: int = PART) -> None:
    """Write the model of the training texts at path, as tables that score_stored() reads: words (hash, id, count, p),
    bigrams (h, w, count, p), histories (h, alpha), each in PARTITIONS folders by its key, and one row of numbers."""
    c, spark = counted(docs, text, doc_id, block, part), docs.sparkSession
    words, d = c.words, c.d

    def word_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for v, i, n in zip(b["vocab"], b["ids"], b["counts"], strict=True):
                n = unpack(n)
                yield pd.DataFrame({"hash": np.frombuffer(v, "<u8").view(np.int64), "id": unpack(i) - 1, "count": n, "p": words.p(n)})

    def pair_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for h, w, n in zip(b["h"], b["w"], b["counts"], strict=True):
                h = np.cumsum(unpack(h))
                yield pd.DataFrame({"h": h, "w": unpack(w) - 1, "count": unpack(n)})

    vocabulary = c.told.filter("kind = 'model'").select("vocab", "ids", "counts").mapInPandas(word_rows, "hash long, id long, count long, p double")
    _write(vocabulary, "hash", f"{path}/words")
    known = stored_words(spark, path)
    pairs = c.pairs.filter("kind = 'model'").select("h", "w", "counts").mapInPandas(pair_rows, "h long, w long, count long")
    lowered = F.when(F.col("count") > K, F.col("count").cast("double")).otherwise(F.try_element_at(F.array(*[F.lit(float(x)) for x in d]), (F.col("count") + 1).cast("int")) * F.col("count"))
    # sums by history: partial sums first, so that a frequent history moves as one row a task
    sums = pairs.join(known.select(F.col("id").alias("w"), F.col("p").alias("of_word")), "w").groupBy("h").agg(F.sum("count").alias("n"), F.min("count").alias("least"), F.count("*").alias("types"), F.sum(lowered).alias("kept"), F.sum("of_word").alias("seen"))
    half = F.col("least") > K
    kept = F.when(half, F.col("n") - 0.5 * F.col("types")).otherwise(F.col("kept"))
    sums = sums.select("h", "n", half.alias("half"), ((1 - kept / F.col("n")) / (1 - F.col("seen"))).alias("alpha"))
    _write(sums, "h", f"{path}/histories")
    histories = stored_histories(spark, path)
    p = F.when(F.col("half"), F.col("count") - 0.5).otherwise(lowered) / F.col("n")
    bigrams = pairs.join(histories.select("h", "n", "half"), "h").select("h", "w", "count", p.alias("p"))
    _write(bigrams, "h", f"{path}/bigrams")
    spark.createDataFrame([(float(words.p(np.zeros(1, np.int64))[0]), words.n, words.types)], "unknown double, n long, types long").write.mode("overwrite").parquet(f"{path}/numbers")


def _write(rows: DataFrame, key: str, path: str) -> None:
    """In PARTITIONS folders by the key; the key itself spreads a folder's rows over a few files."""
    dealt = rows.withColumn("part", F.pmod(F.col(key), F.lit(PARTITIONS)).cast("int"))
    dealt.repartition("part", F.pmod(F.xxhash64(*[c for c in rows.columns if c in ("hash", "h", "w")]), F.lit(4))).write.mode("overwrite").partitionBy("part").parquet(path)


def stored_words(spark, path: str) -> DataFrame:
    return spark.read.schema("hash long, id long, count long, p double, part int").parquet(f"{path}/words")


def stored_bigrams(spark, path: str) -> DataFrame:
    return spark.read.schema("h long, w long, count long, p double, part int").parquet(f"{path}/bigrams")


def stored_histories(spark, path: str) -> DataFrame:
    return spark.read.schema("h long, n long, half boolean, alpha double, part int").parquet(f"{path}/histories")


def score_stored(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, n_known and score of any texts by a stored model: equi-joins of the texts' distinct words, bigrams
    and histories with its tables, and the backoff of a token whose bigram is not there to its word."""
    import xxhash

    spark = bounded(docs.sparkSession)
    h = xxhash.xxh3_64_intdigest
    end = h(b" ")

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row, t in zip(b["row"], b["text"], strict=True):
                found = [h(w) for w in t.encode("utf-8", "surrogatepass").lower().split()]
                at = np.array([*found, end], np.uint64).view(np.int64)
                key, n = np.unique(np.stack([np.r_[np.uint64(end).view(np.int64), at[:-1]], at]), axis=1, return_counts=True)
                yield pd.DataFrame({"row": row, "before": key[0], "word": key[1], "times": n})

    rows, _ = materialise(docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")), "new")
    pairs, _ = materialise(rows.select("row", "text").mapInPandas(tokens, "row long, before long, word long, times long"), "asked")
    known = stored_words(spark, path)
    # frequent words meet the model once: distinct pairs are judged, not tokens
    asked = pairs.select("before", "word").distinct()
    asked = asked.join(known.select(F.col("hash").alias("word"), F.col("id").alias("w"), "p"), "word", "left").join(known.select(F.col("hash").alias("before"), F.col("id").alias("h")), "before", "left")
    asked = asked.join(stored_bigrams(spark, path).select("h", "w", F.col("p").alias("p_pair")), ["h", "w"], "left").join(stored_histories(spark, path).select("h", "alpha"), "h", "left")
    number = spark.read.parquet(f"{path}/numbers").first()
    backed = F.coalesce("alpha", F.lit(1.0)) * F.coalesce("p", F.lit(number["unknown"]))
    judged = asked.select("before", "word", F.log10(F.coalesce("p_pair", backed)).alias("v"), F.col("w").isNotNull().cast("long").alias("known"))
    total = pairs.join(judged, ["before", "word"]).groupBy("row").agg(F.sum("times").alias("n_tokens"), F.sum(F.col("times") * F.col("known")).alias("n_known"), F.sum(F.col("times") * F.col("v")).alias("score"))
    return rows.select("row", "doc_id").join(total, "row").select("doc_id", "n_tokens", "n_known", "score")


def op3(spark, sf_dir: str) -> DataFrame:
    from pelagia.llm.shared import table

    return score(table(spark, sf_dir, "documents"))
