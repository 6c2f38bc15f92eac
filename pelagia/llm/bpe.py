"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into chunks that overlap. Every chunk is pre-tokenised and its pieces encoded; the first pieces of a chunk may
be wrong, because it can start inside a pre-token. Two neighbours are stitched at the first position in their overlap at
which both start a pre-token: the pattern looks only forward, so from there on they agree. Where an overlap has no such
position (one pre-token covers it), the document is pre-tokenised as one. The chunks of a text of more than ``spread``
chunks are dealt out to tasks, and stitched in one, which then holds that text's ids; those of others are done where the
text is read. Decoding joins the tokens' raw bytes.

Defined cases: null text is the empty text (no tokens, the hashes of nothing); special-token strings in a text are
ordinary text (encode_added, for op7, takes them as tokens); equal rows give equal results, each once per row; an empty table gives an empty result; columns other
than the id and the text are not read; null ids are kept.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.llm.shared import bounded, table

CHUNK, OVERLAP, SPREAD = 1 << 14, 1 << 10, 4
#: Different pieces whose ids are remembered, of at most so many characters each.
KNOWN, SHORT = 1 << 17, 64
#: Chunks of a batch.
BATCH = 64
#: A match that ends closer than this to the end of a chunk may end elsewhere in the whole text ("'r" before "e").
MARGIN = 2


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids, from a .tiktoken rank file or from a byte-level tokenizers .json."""
    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(path) as f:
        model = json.load(f)
    special = {x["content"] for x in model["added_tokens"]}
    # the printable bytes stand for themselves, the others for the code points from 256 on
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return {bytes(back[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}


@lru_cache(maxsize=4)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def added(path: str) -> tuple[re.Pattern | None, dict[str, int]]:
    """The added tokens of a tokenizers .json, which that library matches in a text before all else, and a pattern for them."""
    with open(path) as f:
        found = json.load(f)["added_tokens"]
    if any(x[flag] for x in found for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"added tokens of {path} need more than a plain match")
    ids = {x["content"]: x["id"] for x in found}
    return re.compile("(" + "|".join(map(re.escape, sorted(ids, key=len, reverse=True))) + ")") if ids else None, ids


def encode_added(path: str, text: str) -> list[int]:
    """The ids that tokenizers gives with add_special_tokens=False: added tokens in the text are tokens, the rest is ordinary."""
    enc, (pattern, ids) = encoding(path), added(path)
    if pattern is None or not pattern.search(text):
        return enc.encode_ordinary(text)
    return [i for part in pattern.split(text) for i in ([ids[part]] if part in ids else enc.encode_ordinary(part))]


@lru_cache(maxsize=2)
def tokens(path: str) -> tuple[list[bytes], list[bytes]]:
    """By id: the token's raw bytes, and its id in decimal digits."""
    by_id = {i: b for b, i in ranks(path).items()}
    n = max(by_id) + 1
    return [by_id.get(i, b"") for i in range(n)], [b"%d" % i for i in range(n)]


@lru_cache(maxsize=1)
def pretokens():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def decode(path: str, ids: Iterable[int]) -> bytes:
    return b"".join(map(tokens(path)[0].__getitem__, ids))


def digest(path: str, ids: list[int]) -> tuple[int, str, str]:
    """n_tokens, ids_sha256 and decoded_sha256."""
    digits = b" ".join(map(tokens(path)[1].__getitem__, ids))
    return len(ids), hashlib.sha256(digits).hexdigest(), hashlib.sha256(decode(path, ids)).hexdigest()


class Known(dict):
    """Ids of the pieces met so far."""

    def __init__(self, path: str) -> None:
        enc = encoding(path)
        self.encode = enc.encode_single_piece if hasattr(enc, "encode_single_piece") else enc._encode_single_piece

    def __missing__(self, piece: str) -> list[int]:
        ids = self.encode(piece)
        if len(piece) <= SHORT:
            if len(self) >= KNOWN:
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def known(path: str) -> Known:
    return Known(path)


def pieces(path: str, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the pre-tokens of a chunk, the number of ids of each, and all ids. The last start is the chunk's length."""
    found = pretokens().findall(text)
    got = list(map(known(path).__getitem__, found))
    starts = np.zeros(len(found) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, found), np.int64, len(found)), out=starts[1:])
    counts = np.fromiter(map(len, got), np.int64, len(got))
    return starts, counts, np.fromiter(chain.from_iterable(got), np.int64, int(counts.sum()))


def encode_text(path: str, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """Ids of a text by its chunks; one chunk has nothing to stitch."""
    if len(text) <= chunk:
        return np.fromiter(chain.from_iterable(map(known(path).__getitem__, pretokens().findall(text))), np.int64)
    ids = stitch([pieces(path, text[i : i + chunk + overlap]) for i in range(0, len(text), chunk)], chunk)
    return pieces(path, text)[2] if ids is None else ids


def stitch(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], chunk: int) -> np.ndarray | None:
    """Ids of the document, from the pieces of its chunks in order; None where two chunks do not resynchronise."""
    out, begin = [], 0
    for i, (starts, counts, ids) in enumerate(parts):
        ends = np.concatenate([[0], np.cumsum(counts)])
        a = int(np.searchsorted(starts, begin))
        if i + 1 == len(parts):
            out.append(ids[ends[a] :])
            break
        safe = starts[: np.searchsorted(starts, starts[-1] - MARGIN, side="right")]
        meet = np.intersect1d(safe[safe >= max(chunk, begin)] - chunk, parts[i + 1][0][:-1], assume_unique=True)
        if not len(meet):
            return None
        b = int(np.searchsorted(starts, meet[0] + chunk))
        out.append(ids[ends[a] : ends[b]])
        begin = int(meet[0])
    return np.concatenate(out) if out else np.empty(0, np.int64)


def encode(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", chunk: int = CHUNK, overlap: int = OVERLAP, spread: int = SPREAD) -> DataFrame:
    """doc_id, ids (array<int>) of every text."""
    return _encoded(docs, path, text, doc_id, chunk, overlap, spread, lambda ids: list(map(int, ids)), "array<int>").select("doc_id", F.col("value").alias("ids"))


def _encoded(docs: DataFrame, path: str, text: str, doc_id: str, chunk: int, overlap: int, spread: int, finish, kind: str) -> DataFrame:
    bounded(docs.sparkSession)
    id_type = docs.schema[doc_id].dataType
    rows = docs.select(F.col(f"`{doc_id}`").cast("string").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    def here(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "value": [finish(encode_text(path, t, chunk, overlap).tolist()) for t in b["text"]]})

    def chunked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # each text is cut in one way through it, and a batch holds a bounded number of its chunks
        for b in batches:
            for i, k1, k2, t in zip(b["doc_id"], b["k1"], b["k2"], b["text"], strict=True):
                for a in range(0, len(t), chunk * BATCH):
                    numbers = range(a // chunk, min(a // chunk + BATCH, -(-len(t) // chunk)))
                    yield pd.DataFrame({"doc_id": i, "k1": k1, "k2": k2, "chunk_no": numbers, "chunk_text": [t[n * chunk : (n + 1) * chunk + overlap] for n in numbers]})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [pieces(path, t) for t in b["chunk_text"]]
            out = b.assign(**{c: [p[i].astype("<i4").tobytes() for p in got] for i, c in enumerate(("starts", "counts", "ids"))})
            yield out

    def join(group: pd.DataFrame) -> pd.DataFrame:
        once = group.sort_values("chunk_no", kind="stable")
        ids = stitch([tuple(np.frombuffer(r[c], "<i4").astype(np.int64) for c in ("starts", "counts", "ids")) for _, r in once.iterrows()], chunk)
        if ids is None:
            ids = pieces(path, "".join(t[:chunk] for t in once["chunk_text"]))[2]
        return pd.DataFrame({"k1": once["k1"].iloc[:1], "k2": once["k2"].iloc[:1], "doc_id": once["doc_id"].iloc[:1], "value": [finish(ids.tolist())]})

    schema = f"doc_id string, value {kind}"
    few = rows.filter(F.length("text") <= chunk * spread).mapInPandas(here, schema)
    long = rows.filter(F.length("text") > chunk * spread).withColumn("k1", F.xxhash64("doc_id", "text")).withColumn("k2", F.xxhash64(F.lit(7), "text", "doc_id"))
    # equal rows are encoded once and counted
    copies = long.groupBy("k1", "k2").agg(F.count("*").cast("int").alias("copies"))
    chunks = long.dropDuplicates(["k1", "k2"]).select("doc_id", "k1", "k2", "text").mapInPandas(chunked, "doc_id string, k1 long, k2 long, chunk_no int, chunk_text string")
    # chunks of one document go to different tasks: that is where the parallel work is
    chunks = chunks.repartition(F.xxhash64("k1", "chunk_no"))
    done = chunks.mapInPandas(cut, "doc_id string, k1 long, k2 long, chunk_no int, chunk_text string, starts binary, counts binary, ids binary")
    made = done.groupBy("k1", "k2").applyInPandas(join, f"k1 long, k2 long, {schema}").join(copies, ["k1", "k2"])
    made = made.select("doc_id", "value", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")
    out = few.unionByName(made)
    return out.withColumn("doc_id", F.col("doc_id").cast(id_type))


def op10(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    finish = lambda ids: dict(zip(("n_tokens", "ids_sha256", "decoded_sha256"), digest(path, ids), strict=True))
    out = _encoded(table(spark, sf_dir, "documents"), path, "text", "doc_id", CHUNK, OVERLAP, SPREAD, finish, "struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>")
    return out.select("doc_id", "value.*")
